"""Single lookups on the written indexes: plain Python, one small file each."""

from __future__ import annotations

import json
import sys
from collections import deque
from collections.abc import Callable
from pathlib import Path

from filigree.sources import indexes, walk

INDEX_DIR = ".filigree"
# Protocol versions spoken, oldest first.
PROTOCOLS = ("2024-11-05", "2025-03-26", "2025-06-18", "2025-11-25")
SERVER = {"name": "filigree", "version": "0.1.0"}


class LookupError_(Exception):
    """A question that cannot be asked: no index, or a path outside the repository."""


def normalize_target(root: Path, raw: str) -> str:
    """A path of the question as a repository path."""
    raw = raw.replace("\\", "/")
    if raw.startswith("/"):
        try:
            raw = Path(raw).resolve().relative_to(root.resolve()).as_posix()
        except ValueError:
            raise LookupError_(f"{raw} is outside {root}") from None
    out: list[str] = []
    for s in raw.split("/"):
        if s == "..":
            if not out:
                raise LookupError_(f"{raw} leaves the repository")
            out.pop()
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


def state_dir(root: Path, state: Path | None = None) -> Path:
    """Where the indexes of a repository are: ``state``, by default a folder inside it."""
    return state if state is not None else root / INDEX_DIR


def index_text(root: Path, name: str, state: Path | None = None) -> str:
    try:
        return (state_dir(root, state) / name).read_text(encoding="utf-8")
    except OSError:
        raise LookupError_(f"no {name} in {state_dir(root, state)}; build the index first") from None


def freshness(root: Path, state: Path | None = None) -> dict:
    """State of the index against the files now: unknown, fresh or stale, with the first changes."""
    try:
        rows = [line.split("\t") for line in (state_dir(root, state) / "snapshot.tsv").read_text().splitlines() if line]
        was = {p: (int(m), int(s)) for p, m, s in rows}
    except (OSError, ValueError):
        was = {}
    if not was:
        return {"state": "unknown", "changed_count": 0, "changed": []}
    now = {p: (m, s) for p, m, s in walk.snapshot(root)}
    diff = sorted(p for p in was.keys() | now.keys() if was.get(p) != now.get(p))
    return {"state": "stale" if diff else "fresh", "changed_count": len(diff), "changed": diff[:5]}


def importers(index: dict[str, list[str]], target: str, depth: int | None = None) -> list[tuple[str, int]]:
    """Everything that imports the target with least hops, sorted by hops and path."""
    seen, queue = {target: 0}, deque([target])
    while queue:
        at = queue.popleft()
        if depth is not None and seen[at] >= depth:
            continue
        for x in index.get(at, ()):
            if x not in seen:
                seen[x] = seen[at] + 1
                queue.append(x)
    return sorted(((p, d) for p, d in seen.items() if d), key=lambda x: (x[1], x[0]))


def deps(index: dict[str, list[str]], file: str) -> list[str]:
    return sorted(t for t, xs in index.items() if file in xs)


def _suggest(names: list[str], query: str) -> list[str]:
    return [p for p in sorted(set(names)) if query and query.lower() in p.lower()][:5]


def _unknown(index: dict[str, list[str]], target: str) -> str | None:
    every = [*index, *(x for xs in index.values() for x in xs)]
    if target in every:
        return None
    near = _suggest(every, target)
    return f"'{target}' is not in the index" + (f"; similar indexed paths: {', '.join(near)}" if near else "")


def answer_importers(root: Path, file: str, depth: int | None, as_json: bool, state: Path | None = None) -> str:
    target, index, fresh = normalize_target(root, file), indexes.parse_imports(index_text(root, "imports.md", state)), freshness(root, state)
    hits = importers(index, target, depth)
    if as_json:
        return json.dumps({"target": target, "importers": [{"path": p, "depth": d} for p, d in hits], "freshness": fresh}, ensure_ascii=False)
    if hits:
        return "".join(f"{d}  {p}\n" for p, d in hits)
    stale = fresh["state"] != "fresh"
    why = "nothing imports it, it was not analyzed, or the index is stale" if stale else "nothing imports it, or it was not analyzed"
    return _unknown(index, target) or f"no importers for '{target}': {why}"


def answer_deps(root: Path, file: str, as_json: bool, state: Path | None = None) -> str:
    target, index = normalize_target(root, file), indexes.parse_imports(index_text(root, "imports.md", state))
    got = deps(index, target)
    if as_json:
        return json.dumps({"file": target, "deps": got, "freshness": freshness(root, state)}, ensure_ascii=False)
    return "".join(p + "\n" for p in got) or _unknown(index, target) or f"no dependencies for '{target}'"


def answer_callers(root: Path, view: str | None, path: str | None, as_json: bool, state: Path | None = None) -> str:
    """Callers of a view, or of all views with a route path."""
    sections = indexes.parse_routes(index_text(root, "routes.md", state))
    imports = indexes.parse_imports(index_text(root, "imports.md", state)) if (state_dir(root, state) / "imports.md").is_file() else {}
    route = (path or "").strip().strip("/")
    hit = [s for s in sections if (s["view"] == view if path is None else route in s["routes"])]
    by = lambda s: {c: sorted(imports[c]) for c in s["callers"] if imports.get(c)}
    if as_json:
        rows = [{k: s[k] for k in ("file", "routes", "callers")} | ({"importers": by(s)} if by(s) else {}) | ({"view": s["view"]} if path is not None else {}) for s in hit]
        return json.dumps({("view" if path is None else "path"): view if path is None else route, "matches": rows, "freshness": freshness(root, state)}, ensure_ascii=False)
    out = ""
    for s in hit:
        lead = s["file"] if path is None else f"{s['view']}  {s['file']}"
        out += f"{lead}  (routes: {', '.join(s['routes'])})\n"
        for c in s["callers"]:
            out += f"  {c}\n" + (f"    imported by: {', '.join(by(s)[c])}\n" if c in by(s) else "")
    if out:
        return out
    near = _suggest([s["view"] for s in sections], view or "")
    return f"no route in the index names this {'view' if path is None else 'path'} '{view if path is None else route}'" + (f"; similar indexed views: {', '.join(near)}" if near else "")


# Names and arguments of the tools.
TOOLS = [
    {
        "name": "importers",
        "description": "Lists the files that import a file, at depth 1 directly and deeper through others. Comes from static imports; couplings by strings or at run time are not seen.",
        "inputSchema": {"type": "object", "properties": {"path": {"type": "string", "description": "Path of the file in the repository."}, "depth": {"type": "integer", "description": "Most hops to follow; all without it."}}, "required": ["path"]},
    },
    {
        "name": "route_callers",
        "description": "Lists the frontend files that request a route of a backend view, and what imports each of them. Comes from static text; URLs put together at run time are not seen.",
        "inputSchema": {"type": "object", "properties": {"view": {"type": "string", "description": "Name of the view."}}, "required": ["view"]},
    },
]


def _call(root: Path, name: str, args: dict, state: Path | None, refresh: Callable[[], None] | None) -> str:
    """The text of a tool's answer: JSON with hits, a sentence and the state of the index without; raises for bad arguments."""
    key = "path" if name == "importers" else "view"
    if not isinstance(args.get(key), str):
        raise LookupError_(f"{name} needs a text argument '{key}'")
    depth = args.get("depth") if name == "importers" else None
    if depth is not None and (isinstance(depth, bool) or not isinstance(depth, int) or depth < 0):
        raise LookupError_("'depth' of importers must be a whole number from 0 on")
    if name == "importers":
        normalize_target(root, args[key])
    if refresh is not None and freshness(root, state)["state"] != "fresh":
        refresh()
    ask = (lambda as_json: answer_importers(root, args[key], depth, as_json, state)) if name == "importers" else (lambda as_json: answer_callers(root, args[key], None, as_json, state))
    found = json.loads(ask(True))
    if found["importers" if name == "importers" else "matches"]:
        return json.dumps(found, ensure_ascii=False)
    return f"{ask(False).rstrip()}\nindex {found['freshness']['state']}"


def handle(root: Path, line: str, refresh: Callable[[], None] | None = None, state: Path | None = None) -> str | None:
    """One JSON-RPC request line to its response line; notifications and lines without a method give None."""
    reply = lambda i, **x: json.dumps({"jsonrpc": "2.0", "id": i, **x}, ensure_ascii=False)
    try:
        msg = json.loads(line)
    except ValueError:
        return reply(None, error={"code": -32700, "message": "parse error"})
    if not isinstance(msg, dict) or not isinstance(msg.get("method"), str) or "id" not in msg or msg["method"].startswith("notifications/"):
        return None
    i, method = msg["id"], msg["method"]
    params = msg.get("params") if isinstance(msg.get("params"), dict) else {}
    if method == "initialize":
        wanted = params.get("protocolVersion")
        return reply(i, result={"protocolVersion": wanted if wanted in PROTOCOLS else PROTOCOLS[-1], "capabilities": {"tools": {}}, "serverInfo": SERVER})
    if method == "server/discover":
        return reply(i, result={"resultType": "complete", "supportedVersions": list(PROTOCOLS), "capabilities": {"tools": {}}, "_meta": {"io.modelcontextprotocol/serverInfo": SERVER}})
    if method in ("ping", "tools/list"):
        return reply(i, result={} if method == "ping" else {"tools": TOOLS})
    if method != "tools/call":
        return reply(i, error={"code": -32601, "message": f"unknown method {method}"})
    name, args = params.get("name"), params.get("arguments")
    if name not in [t["name"] for t in TOOLS]:
        return reply(i, error={"code": -32602, "message": f"unknown tool {name}"})
    try:
        text, bad = _call(root, name, args if isinstance(args, dict) else {}, state, refresh), False
    except (LookupError_, ValueError) as e:
        text, bad = str(e), True
    return reply(i, result={"content": [{"type": "text", "text": text}], "isError": bad})


def serve(root: Path, refresh: Callable[[], None] | None = None, state: Path | None = None) -> None:
    """Answer JSON-RPC lines from standard input until it ends; the index is read anew for each call."""
    for line in sys.stdin:
        if line.strip() and (out := handle(root, line, refresh, state)) is not None:
            print(out, flush=True)
