"""Text outputs: import and route index, map, JSON index, marked blocks."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from filigree.sources.indexes import ARROW

# Symbols and flows shown per domain, tried in turn until the map fits its budget.
LADDER = ((8, True), (8, False), (6, False), (5, False), (4, False), (3, False), (2, False), (1, False))
START, END = "<!-- filigree:start -->", "<!-- filigree:end -->"


def count_tokens(text: str) -> int:
    """An estimate that needs no vocabulary: a quarter of the characters, and one."""
    return len(text) // 4 + 1


def write_atomic(path: Path, text: str) -> None:
    """Write beside the target and rename over it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=".tmp-")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def imports_markdown(title: str, rows: list[tuple[str, str]], rate: float, unresolved: int) -> str:
    """The reverse import index; ``rows`` are (target, importers joined by ', ')."""
    n = sum(len(b.split(", ")) for _, b in rows)
    head = [
        f"# Reverse Import Index — {title}",
        "",
        "Generated by filigree. For each file, every analyzed file that imports it.",
        f"{n} imports into {len(rows)} files · import resolution {rate * 100:.0f}% · {unresolved} unresolved specifiers carry no edge.",
        "External packages are not listed. Files nothing imports are omitted.",
        "",
    ]
    return "\n".join([*head, *(f"{a}{ARROW}{b}" for a, b in sorted(rows))]) + "\n"


def routes_markdown(links: list[dict]) -> str:
    """The route index: a section per view with its routes and callers."""
    out = ["# Route callers", "", "Backend views and the frontend files whose request strings name every segment of the view's route (mount prefix such as `api/` dropped). Static evidence: string-built URLs can be missed or over-matched.", ""]
    for x in links:
        out += [f"## `{x['view']}` — `{x['file']}`", "", "Routes: " + ", ".join(f"`{r}`" for r in x["routes"]), "", *(f"- `{c}`" for c in x["callers"]), ""]
    return "\n".join(out).rstrip("\n") + "\n"


def relations(cochange: int | None, contracts: int, semantic: int) -> str:
    """Where the relationships of a map come from; ``cochange`` is None without a history."""
    parts = ["resolved imports"]
    if cochange is not None:
        parts.append(f"{cochange} git co-change pairs")
    for n, one in ((contracts, "API contract"), (semantic, "cross-language symbol contract")):
        if n:
            parts.append(f"{n} {one}" + "s" * (n > 1))
    text = ", ".join(parts) + " and directory structure"
    return "relationships come from " + text + (" only" if len(parts) == 1 else "")


def boundary(excluded: dict, unresolved: int) -> list[str]:
    """What a map leaves out."""
    out = [f"- Excluded files: {excluded['generated']} generated, {excluded['declarations']} type declarations, {excluded['config']} config", "- Vendor and build directories were not walked"]
    return out + [f"- {unresolved} import specifiers could not be resolved to a file and carry no edge in this map"] * bool(unresolved)


def map_markdown(title: str, facts: dict, symbols: int, with_flows: bool) -> str:
    """The map of a repository at one level of detail."""
    out = [f"# {title}", "", f"{facts['files']} files in {len(facts['domains'])} domains · import resolution {facts['rate'] * 100:.0f}% · confidence {facts['confidence']:.2f}", ""]
    if facts.get("frameworks"):
        out += ["Frameworks: " + ", ".join(facts["frameworks"]), ""]
    if facts["hubs"]:
        out += ["## Imports", "", "Most-imported files (number of analyzed files importing each):", "", *(f"- `{p}` — {n}" for p, n in facts["hubs"]), ""]
    for d in facts["domains"]:
        out += [f"## {d['name']}", "", d["summary"], "", f"Confidence: {d['band']}"]
        if d["dirs"]:
            out.append("Directories: " + ", ".join(f"`{x}`" for x in d["dirs"]))
        if d["symbols"]:
            out.append("Key symbols: " + ", ".join(d["symbols"][:symbols]))
        if d["entries"]:
            out.append("Entry points: " + ", ".join(d["entries"]))
        if d["depends_on"]:
            out.append("Depends on: " + ", ".join(d["depends_on"]))
        if with_flows:
            out += [f"Flow: {f['label']}: " + " → ".join(f"`{p}`" for p in f["path"]) + (f" (+{f['leaves']} leaves)" if f["leaves"] else "") for f in d["flows"]]
        out.append("")
    if "relations" in facts:
        out += ["## Boundary", "", f"- In this map {facts['relations']}", *facts["boundary"], ""]
    return "\n".join(out).rstrip("\n") + "\n"


def fitted_map(title: str, facts: dict, budget: int) -> tuple[str, bool]:
    """The first map of the ladder within the budget, and whether one fits; else the shortest."""
    text = ""
    for symbols, flows in LADDER:
        text = map_markdown(title, facts, symbols, flows)
        if count_tokens(text) <= budget:
            return text, True
    return text, False


# Terms and domain names shown per line of a root page, tried in turn until it fits its budget.
ROOT_LADDER = ((8, None), (4, None), (0, None), (0, 8), (0, 3), (0, 0))


def _root_page(title: str, files: int, units: list[dict], slugs: list[str], folder: str, terms: int, names: int | None) -> str:
    out = [f"# {title}", "", f"{files} files in {len(units)} units.", ""]
    for u, slug in zip(units, slugs, strict=True):
        every = [d["name"] for d in u["domains"]]
        said = every if names is None else every[:names] + [f"and {len(every) - names} more domains"] * (len(every) > names)
        tail = f". Terms: {', '.join(u['terms'][:terms])}" if u["terms"][:terms] else ""
        out.append(f"- [{u['label']}]({folder}/{slug}.md): {sum(len(d['files']) for d in u['domains'])} files; {'; '.join(said)}{tail}.")
    return "\n".join(out) + "\n"


def split_map(title: str, facts: dict, units: list[dict], slugs: list[str], budget: int | None = None, folder: str = "domains") -> tuple[str, dict[str, str]]:
    """A root page that points to one page per unit in ``folder``; a unit has ``label``, ``domains``, ``terms`` and ``budget``.

    The root page shows fewer terms, then fewer names, until it keeps to
    ``budget``; every unit keeps its line.  Where that cannot be kept at all,
    nothing is left out.
    A page keeps to its unit's budget by the ladder, and by dropping files from
    the end of its list, which it then says.
    """
    pages = {}
    for u, slug in zip(units, slugs, strict=True):
        files = [p for d in u["domains"] for p in d["files"]]
        for (symbols, flows), shown in zip(LADDER, (len(files), 60, 60, 30, 15, 8, 4, 4)):
            more = [f"- and {len(files) - shown} more"] * (len(files) > shown)
            pages[slug] = map_markdown(u["label"], {**{k: v for k, v in facts.items() if k != "relations"}, "files": len(files), "domains": u["domains"], "hubs": []}, symbols, flows) + "\nFiles:\n" + "\n".join([*(f"- `{p}`" for p in files[:shown]), *more]) + "\n"
            if count_tokens(pages[slug]) <= u["budget"]:
                break
    roots = [_root_page(title, facts["files"], units, slugs, folder, *rung) for rung in ROOT_LADDER]
    text = next((r for r in roots if budget is None or count_tokens(r) <= budget), roots[0])
    return text, pages


def index_json(root: str, facts: dict, map_tokens: int) -> str:
    clusters = [{"id": i, "name": d["name"], "summary": d["summary"], "files": d["files"], "depends_on": d["depends_on_ids"], "depended_on_by": d["depended_on_by_ids"], "confidence": d["confidence"], "flows": [{"entry": f["label"], "path": f["path"]} for f in d["flows"]]} for i, d in enumerate(facts["domains"])]
    return json.dumps({"version": 1, "root": root, "files": facts["files"], "resolution_rate": facts["rate"], "confidence": facts["confidence"], "map_tokens": map_tokens, "clusters": clusters}, indent=2, ensure_ascii=False)


def agents_block(has_routes: bool) -> str:
    lines = [START, "## Code lookups (filigree)", "", "This repository is indexed. Ask the index before changing a file:", "", "- `filigree importers <file> [--depth N] [--json]`: every file that imports `<file>`, directly or transitively.", "- `filigree deps <file>`: what the file imports."]
    if has_routes:
        lines.append("- `filigree callers <View>`: frontend files requesting that backend view's routes, with their importers.")
    return "\n".join([*lines, "", "Each answer says whether the index is fresh; if not, run `filigree` and ask again.", END])


def merge_block(existing: str | None, block: str) -> str:
    """The text with the marked block put in or replaced; line ends are kept, bad markers refused."""
    if existing is None:
        return block + "\n"
    eol = "\r\n" if "\r\n" in existing else "\n"
    block = block.replace("\n", eol)
    a, b = existing.count(START), existing.count(END)
    if a == b == 0:
        gap = "" if not existing else eol if existing.endswith("\n") else eol * 2
        return existing + gap + block + eol
    if a != 1 or b != 1 or existing.index(END) < existing.index(START):
        raise ValueError(f"{a} start and {b} end markers of the block; put it right by hand")
    before, rest = existing.split(START)
    return before + block + rest.split(END)[1]
