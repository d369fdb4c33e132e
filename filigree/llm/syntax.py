"""Source files that do not parse as the language their name stands for."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm import syntax_js, syntax_py

#: Extension: (language, types allowed, elements allowed).
LANGUAGES = {
    "ts": ("TypeScript", True, False),
    "mts": ("TypeScript", True, False),
    "cts": ("TypeScript", True, False),
    "tsx": ("TSX", True, True),
    "js": ("JavaScript", False, True),
    "mjs": ("JavaScript", False, True),
    "cjs": ("JavaScript", False, True),
    "jsx": ("JSX", False, True),
    "py": ("Python", False, False),
    "vue": ("Vue", True, False),
    "svelte": ("Svelte", True, False),
}
SCHEMA = "file long, repo string, rel string, language string, ok boolean, n_errors int, cause string, line int, message string, errors array<struct<line:int,message:string>>, accepted_by array<string>"

_COMMENT = re.compile(r"<!--[\s\S]*?-->")
_SCRIPT = re.compile(r"<script\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_SCRIPT_END = re.compile(r"</script\s*>", re.I)
_MARKER = re.compile(r"^(?:<{7}|\|{7}|={7}|>{7})(?:\s|$)", re.M)


def script_blocks(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(offset, body) of each script block of a component file, and (offset, message) of broken ones."""
    text = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    blocks, bad, at = [], [], 0
    while True:
        start, stop = _SCRIPT.search(text, at), _SCRIPT_END.search(text, at)
        if stop and (not start or stop.start() < start.start()):
            bad.append((stop.start(), "script block without a start"))
            at = stop.end()
        elif start:
            stop = _SCRIPT_END.search(text, start.end())
            if start.group(1).rstrip().endswith("/"):
                at = start.end()
            elif stop is None:
                bad.append((start.start(), "script block without an end"))
                return blocks, bad
            else:
                blocks.append((start.end(), text[start.end() : stop.start()]))
                at = stop.end()
        else:
            if (m := re.search(r"<script\b[^>]*\Z|<scrip?\Z|</script?\Z", text[at:])) and text.strip():
                bad.append((at + m.start(), "script block cut off"))
            return blocks, bad


def file_errors(text: str, ext: str) -> list[tuple[int, str]]:
    """Errors of a text as the language of an extension: (offset, message), empty if it parses."""
    if not text.strip():
        return []
    _, ts, jsx = LANGUAGES[ext]
    if ext == "py":
        if syntax_py.accepts(text):
            return []
        return syntax_py.errors(text) or [(0, "invalid syntax")]
    if ext in ("vue", "svelte"):
        blocks, bad = script_blocks(text)
        for at, body in blocks:
            if not syntax_js.quickly_accepts(body, ts, jsx):
                bad += [(at + o, e) for o, e in syntax_js.errors(body, ts, jsx)]
        return sorted(bad)
    return [] if syntax_js.quickly_accepts(text, ts, jsx) else syntax_js.errors(text, ts, jsx)


def accepted_by(text: str, ext: str) -> list[str]:
    """The other languages that a refused text is valid source of.

    Texts with elements are lexed exactly, others fast; a component needs a
    script block.
    """
    own = LANGUAGES[ext][0]
    elements = "</" in text or "/>" in text
    out = ["Python"] if own != "Python" and syntax_py.accepts(text) else []
    for e in ("js", "ts", "tsx"):
        name, ts, jsx = LANGUAGES[e]
        if name != own and (syntax_js.quickly_accepts(text, ts, jsx) or elements and jsx and syntax_js.accepts(text, ts, jsx)):
            out.append(name)
    if own not in ("Vue", "Svelte") and _SCRIPT.search(text) and not file_errors(text, "vue"):
        out.append("component")
    return out


def cause(text: str, errs: list[tuple[int, str]], others: list[str], ext: str) -> str:
    """The first cause of a text's errors.

    ``too-deep``: nesting beyond ``DEEPEST``, so not judged further;
    ``conflict``: a merge marker near the first error; ``other-language``:
    another language accepts the text; ``other-format``: the first error is in
    the first line, so it never was source of this language; ``cut-off``: an
    error at either end, or brackets left open; else ``syntax``.
    """
    if any(e == "nested too deeply" for _, e in errs):
        return "too-deep"
    first = errs[0][0]
    m = _MARKER.search(text)
    if m and m.start() - 400 <= first <= m.end() + 400:
        return "conflict"
    if others:
        return "other-language"
    start = len(text) - len(text.lstrip())
    indented = text[:1] in " \t" and errs[0][1] in ("unexpected }", "unexpected indent", "expected ;", "script block without a start", "expected a statement")
    if first <= start + 1 and not indented and "script block" not in errs[0][1]:
        return "other-format"
    end = len(text.rstrip())
    last = errs[-1][0]
    tail = text[last:end]
    open_ = sum(map(tail.count, "([{")) > sum(map(tail.count, ")]}"))
    if indented or last >= end - 1 or "\n" not in tail or open_ or "unclosed" in errs[-1][1] or "end" in errs[-1][1] or errs[0][1] in ("unexpected }", "script block without a start"):
        return "cut-off"
    return "syntax"


#: Calls that nesting may take, about six a level: texts nested some 160,000 deep are still parsed (about 1.5 KB of memory a level).
DEEPEST = 1_000_000
#: Verdicts on refused texts, by digest: copies of one broken file are judged once per worker.
_REFUSED: dict = {}
_REFUSED_MOST = 20_000


def judge(text: str, ext: str) -> tuple:
    """``(ok, n_errors, cause, line, message, errors, accepted_by)`` of one text."""
    key = (ext, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()) if len(text) > 400 else (ext, text)
    known = _REFUSED.get(key)
    if known is not None:
        return known
    errs = file_errors(text, ext)
    if not errs:
        return (True, 0, None, None, None, [], [])
    lines, at, n = [], 0, 1
    for o, m in errs:  # in order of place, so lines are counted once
        n += text.count("\n", at, o)
        at = max(at, o)
        lines.append({"line": n, "message": m})
    others = accepted_by(text, ext)
    out = (False, len(errs), cause(text, errs, others, ext), lines[0]["line"], lines[0]["message"], lines, others)
    if len(_REFUSED) >= _REFUSED_MOST:
        _REFUSED.clear()
    _REFUSED[key] = out
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file version whose extension names a language; columns as in ``SCHEMA``.

    ``ok`` says whether it parses.  For others ``errors`` holds all errors in
    order of place with their lines, ``line`` and ``message`` the first one,
    ``cause`` its class and ``accepted_by`` the languages that would accept
    the text.  Null and blank texts parse.  Files without a known extension
    are left out; copies of a row are one record.
    """
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    rows = files.select(F.col("id").alias("file"), "repo", "rel", ext.alias("ext"), "text").where(F.col("ext").isin(*LANGUAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(DEEPEST, sys.getrecursionlimit()))
        for b in batches:
            ids, repos, rels, exts, texts = (c.to_pylist() for c in b.columns)
            out: list[list] = [[] for _ in range(11)]
            for i, repo, rel, e, text in zip(ids, repos, rels, exts, texts):
                row = (i, repo, rel, LANGUAGES[e][0], *judge(text or "", e))
                for c, v in zip(out, row):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())])), pa.list_(pa.string())]
            names = ["file", "repo", "rel", "language", "ok", "n_errors", "cause", "line", "message", "errors", "accepted_by"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return rows.mapInArrow(run, SCHEMA)


def broken_files(files: DataFrame) -> DataFrame:
    """Files that do not parse, one row each."""
    return parse_files(files).where("NOT ok").dropDuplicates(["file"])


def parse_rates(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Files, broken files and their share per ``repo`` and ``language``.

    ``symbols`` and ``refs`` are the numbers of recorded symbols and references
    in the broken files: what a fault-tolerant parser saw of them.
    """
    p = parse_files(files).select("file", "repo", "language", "ok", "cause").distinct()
    n = p.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum((~F.col("ok")).cast("long")).alias("broken"), F.sum((F.col("cause") == "cut-off").cast("long")).alias("cut_off"), F.sum((F.col("cause") == "conflict").cast("long")).alias("conflicts"), F.sum((F.col("cause") == "other-language").cast("long")).alias("other_language"))
    bad = p.where("NOT ok").select("file", "repo", "language")

    def seen(t: DataFrame, key: list[str], name: str) -> DataFrame:
        per = t.select(*key).distinct().groupBy("file").agg(F.count("*").alias("n"))
        return bad.join(per, "file").groupBy("repo", "language").agg(F.sum("n").alias(name))

    out = n.join(seen(symbols, ["file", "line"], "symbols"), ["repo", "language"], "left").join(seen(refs, ["file", "pos"], "refs"), ["repo", "language"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("broken", "cut_off", "conflicts", "other_language", "symbols", "refs")]
    return out.select("repo", "language", "files", *zero, F.round(F.col("broken") / F.col("files"), 6).alias("rate"))
