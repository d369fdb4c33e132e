"""Command line: analyze a repository, or look something up in its indexes.

``filigree [PATH]`` analyzes; ``importers``, ``deps``, ``callers``, ``mcp`` and
``agents`` work on the indexes.  Exit codes: 0 for answers and clean misses, 2
without an index or for a bad path.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

COMMANDS = ("importers", "deps", "callers", "mcp", "agents")


def _analysis(root: Path | None) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="filigree", description="Analyze a repository, or look up its indexes.", epilog=f"Lookups: {', '.join(COMMANDS)}; a directory of such a name is analyzed as ./NAME.")
    p.add_argument("path", nargs="?", type=Path, default=root or Path("."), help="repository to analyze")
    p.add_argument("--map", action="store_true", help="also write the map and index.json")
    p.add_argument("-o", "--out", type=Path, help="where the map goes (default: CODEBASE.md in the repository)")
    p.add_argument("-b", "--budget", type=int, default=4000, help="tokens of the map")
    p.add_argument("--max-domains", type=int, default=12)
    p.add_argument("--seed", type=int, default=0x5EED)
    p.add_argument("--no-index", action="store_true", help="write no index.json")
    p.add_argument("--no-git", action="store_true", help="ignore the history")
    p.add_argument("--index-dir", type=Path, help="where the indexes go")
    p.add_argument("--unresolved", action="store_true", help="list imports that resolve to nothing")
    return p


def _lookup(name: str, root: Path | None) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"filigree {name}")
    if name in ("importers", "deps"):
        p.add_argument("file")
    if name == "importers":
        p.add_argument("--depth", type=int)
    if name == "callers":
        p.add_argument("view", nargs="?")
        p.add_argument("--path")
    if name == "agents":
        p.add_argument("--write", type=Path, help="file to merge the block into, below the repository")
    if name in ("importers", "deps", "callers"):
        p.add_argument("--json", action="store_true")
    if name != "agents":
        p.add_argument("--refresh", action="store_true", help="build the index first where it is not fresh")
    p.add_argument("--repo", type=Path, default=root or Path("."))
    p.add_argument("--index-dir", type=Path)
    return p


def _build(root: Path, state: Path | None, options: argparse.Namespace | None = None) -> dict:
    from filigree import pipeline, serve
    from filigree.session import local_session

    spark, start = local_session(), time.perf_counter()
    here = serve.state_dir(root.resolve(), state and state.resolve())
    ix = pipeline.build(spark, root, str(here / "store"))
    parsed = time.perf_counter()
    found = pipeline.write_indexes(ix, here)
    found["seconds"] = {"analysis": parsed - start, "indexes": time.perf_counter() - parsed}
    if options is not None and options.map:
        start = time.perf_counter()
        out = (options.out or ix.root / "CODEBASE.md").resolve()
        text = pipeline.write_map(ix, options.budget, options.max_domains, options.seed, here, out, not options.no_index, not options.no_git)
        found["seconds"]["map"] = time.perf_counter() - start
        found["map"] = (out, text)
    return found


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    root = None
    if argv[:1] == ["--root"] and len(argv) > 1:  # also accepted in front of a command
        root, argv = Path(argv[1]), argv[2:]
    if argv[:1] == ["build"]:
        argv = argv[1:]

    from filigree import serve
    from filigree.sinks import render

    if not argv or argv[0] not in COMMANDS:
        parser = _analysis(root)
        args = parser.parse_args(argv)
        if not args.map and (args.out or args.no_index or args.no_git):
            parser.error("--out, --no-index and --no-git need --map")
        found = _build(args.path, args.index_dir, args)
        print(f"{found['files']} files · {found['imports']} imports · resolution {found['rate'] * 100:.0f}% · {len(found['unresolved'])} unresolved · {len(found['links'])} views with callers")
        if "map" in found:
            out, text = found["map"]
            print(f"map: {out}, {render.count_tokens(text)} tokens")
        print("seconds: " + ", ".join(f"{k} {v:.1f}" for k, v in found["seconds"].items()))
        if args.unresolved:
            print("\n".join(f"{f}: {s}" for f, s in found["unresolved"]))
        return 0

    name = argv[0]
    parser = _lookup(name, root)
    args = parser.parse_args(argv[1:])
    state = args.index_dir
    if name == "agents":
        block = render.agents_block((serve.state_dir(args.repo, state) / "routes.md").is_file())
        if args.write is None:
            print(block)
        else:
            to = args.repo / args.write
            old = to.read_bytes().decode() if to.is_file() else None
            to.write_bytes(render.merge_block(old, block).encode())
        return 0
    build = lambda: _build(args.repo, state)
    if name == "mcp":
        serve.serve(args.repo, build if args.refresh else None, state)
        return 0
    try:
        if args.refresh and serve.freshness(args.repo, state)["state"] != "fresh":
            build()
        if name == "importers":
            if args.depth is not None and args.depth < 1:
                parser.error("--depth must be at least 1")
            out = serve.answer_importers(args.repo, args.file, args.depth, args.json, state)
        elif name == "deps":
            out = serve.answer_deps(args.repo, args.file, args.json, state)
        else:
            if (args.view is None) == (args.path is None):
                parser.error("name a view or --path")
            out = serve.answer_callers(args.repo, args.view, args.path, args.json, state)
    except serve.LookupError_ as e:
        print(e, file=sys.stderr)
        return 2
    print(out.rstrip("\n"))
    print(f"index {serve.freshness(args.repo, state)['state']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
