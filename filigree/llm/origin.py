"""Files that nobody wrote by hand: generated, minified, vendored, or data kept as code.

Vendored copies are found by Merkle hashes over directory trees: a file's leaf
hash covers its code without comments and white space, a directory's hash the
hashes of its children whatever their names.  What is shared by repositories
that are not mirrors of each other is vendored.  Generated files, minified
files and data are found in the file itself, by header and layout rules.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.paths import dirname
from filigree.operators.salted import salted_join
from filigree.session import staged

#: Least code (characters without white space and comments) of a file or a directory whose sharing counts.
SHARED_CHARS = 240
#: Least share of the code of both, rare contents first, that forks of one repository have in common.
FORK_SHARE = 0.6
#: Least lines of a repeated layout, share of lines in at most four shapes, and share of lines in numbered runs.
LEAST_LINES, SHAPE_SHARE, RUN_SHARE = 6, 0.85, 0.6
#: Data: least share of the code in literal lines, and least literals.
DATA_SHARE, LEAST_LITERALS = 0.85, 24
#: Minified: least mean length of the long lines' share, and most white space in them.
LONG_LINE, LONG_SHARE, MOST_SPACE = 200, 0.6, 0.08

# What tools write at the head or foot of their output (a whole comment line, without its marks).
GENERATED_LINE = re.compile(
    r"^(?:!+ *)?(?:@generated\b.*|code generated (?:by|from|with)\b.*|<auto-generated\b.*|auto-?generated(?: (?:on|by|from|with)\b| ?\(|[.:!]?$).*"
    r"|this (?:file|module|code) (?:was|is|has been) (?:automatically |auto-?)generated\b.*|generated (?:by|from|with) .*do not (?:edit|modify).*"
    r"|(?:machine-(?:written|generated)) (?:output|code|file)\b.*|(?:produced|emitted|written) by .*(?:changes made here are lost|rebuild|regenerate|instead of).*"
    r"|source: \S+ +checksum: \S+.*)$",
    re.I,
)
# How copies of packages are marked.
VENDORED_LINE = re.compile(
    r"^(?:vendored (?:from|copy of) \S.*|copied (?:unchanged|verbatim) from (?:the )?\S+.*|\(c\) the \S+ authors\. released under the terms in \S+.*|@license\b.*|copyright the \S+ contributors.*)$",
    re.I,
)
_JS_COMMENT = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|//[^\n]*|/\*[\s\S]*?\*/")
_PY_COMMENT = re.compile(r"(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|#[^\n]*")
_HTML_COMMENT = re.compile(r"<!--[\s\S]*?-->")
_IMPORT = re.compile(r"^(?:import\b|from\s+\S+\s+import\b|export\s*(?:\{[^}]*\}|\*[^;]*)\s*from\b|(?:const|let|var)\s*(?:\{[^}]*\}|\w+)\s*=\s*(?:require|import)\s*\()")
_SHAPE = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"|[A-Za-z_$][\w$]*|\d[\w.]*")
_NUMBER = re.compile(r"\d+")
_LITERAL = r"(?:-?\d[\w.]*|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|true|false|null|None|True|False|undefined)"
_DATA_LINE = re.compile(rf"^[\[\](){{}}\s,]*+(?:(?:(?:[\w$]++|{_LITERAL})\s*+:\s*+)?[\[({{]*+\s*+{_LITERAL}[\])}}]*+\s*+(?:,\s*+|$))++[\[\](){{}};\s,]*+$")
_LITERALS = re.compile(_LITERAL)
_DATA_FRAME = re.compile(r"^(?:(?:export\s+)?(?:default\b|(?:const|let|var)\s+[\w$]+(?:\s*:\s*[^=]+)?\s*=|module\.exports\s*=|exports\.[\w$]+\s*=|[\w$]+\s*(?::\s*[^=]+)?=))?(?:[\[\](){};,\s]|(?:as const|frozenset|tuple|bytes\.fromhex|JSON\.parse|Object\.freeze)\b)*+$")
_BLOB = re.compile(r"['\"`]([A-Za-z0-9+/=_\\-]{40,})['\"`]")


def strip_comments(text: str, ext: str) -> str:
    if ext == "py":
        return _PY_COMMENT.sub(r"\1", text)
    if ext in ("vue", "svelte"):
        text = _HTML_COMMENT.sub("", text)
    return _JS_COMMENT.sub(r"\1", text)


def comment_lines(text: str, ext: str) -> list[str]:
    """The comment lines before the first code and after the last, without their marks."""
    lines = text.split("\n")
    out: list[str] = []
    for side in (lines, lines[::-1]):
        block = False
        for line in side:
            s = line.strip()
            if not s or s in ("<script>", '<script lang="ts">') or s.startswith("#!"):
                continue
            if s.startswith("#") if ext == "py" else s.startswith(("//", "/*", "*", "<!--")) or block or s.endswith("*/"):
                block = ext != "py" and (s.startswith("/*") or block) and "*/" not in s
                out.append(s.strip("/*#<!-> \t").strip())
            else:
                break
    return out


def shape(line: str) -> str:
    return _SHAPE.sub(lambda m: "0" if m.group()[0].isdigit() else "S" if m.group()[0] in "'\"" else "w", line)


def follows(a: str, b: str) -> bool:
    """Whether the digits ``b`` are the number after ``a``; of any length, in time linear in it."""
    if len(a) < 18 and len(b) < 18:
        return int(b) - int(a) == 1
    a, b = a.lstrip("0"), b.lstrip("0")
    kept = a.rstrip("9")
    up = kept[:-1] + str(int(kept[-1]) + 1) if kept else "1"
    return b == up + "0" * (len(a) - len(kept))


def repeated_layout(code: list[str]) -> bool:
    """Lines of a few shapes whose numbers count on: the layout of emitted tables and accessors."""
    if len(code) < LEAST_LINES:
        return False
    shapes = [shape(x) for x in code]
    top = [s for s, _ in Counter(shapes).most_common(4)]
    if sum(s in top for s in shapes) < SHAPE_SHARE * len(code):
        return False
    # numbers of the lines of one shape, by place: a counter goes up by one from line to line
    counted = 0
    for s in top:
        rows = [_NUMBER.findall(line) for line, t in zip(code, shapes) if t == s]
        if len(rows) < 3:
            continue
        width = min(map(len, rows))
        steps = max((sum(follows(a[j], b[j]) for a, b in zip(rows, rows[1:])) for j in range(width)), default=0)
        if steps >= 0.7 * (len(rows) - 1):
            counted += len(rows)
    return counted >= RUN_SHARE * len(code)


def is_minified(text: str) -> bool:
    """Most of the text is in long lines of code almost without white space."""
    if len(text) < LONG_LINE:
        return False
    long = [x for x in text.split("\n") if len(x) >= LONG_LINE]
    n = sum(map(len, long))
    if n < LONG_SHARE * len(text.rstrip()):
        return False
    spaces = sum(x.count(" ") + x.count("\t") for x in long)
    marks = sum(x.count(";") + x.count("{") + x.count("(") + x.count(",") for x in long)
    return spaces <= MOST_SPACE * n and marks >= 0.02 * n


def is_data(code: list[str]) -> bool:
    """Nearly all code is literals of one or few large containers, or one long encoded string."""
    body = "\n".join(code)
    if not body:
        return False
    blobs = [m for m in _BLOB.findall(body) if re.search(r"\d", m) and re.search(r"[A-Z]", m) and re.search(r"[a-z]", m)]
    if sum(map(len, blobs)) >= max(200, DATA_SHARE * len(body) - 80 - 8 * len(blobs)):
        return True
    data = literals = frames = 0
    for line in code:
        if _DATA_LINE.match(line):
            data += len(line)
            literals += len(_LITERALS.findall(line))
        elif _DATA_FRAME.match(line):
            frames += 1
            data += len(line)
    return literals >= LEAST_LITERALS and data >= DATA_SHARE * len(body) and literals >= 12 * max(1, frames // 2)


def sorts(text: str, ext: str) -> list[str]:
    """Which of generated, minified, vendored and data a text is by itself."""
    heads = comment_lines(text, ext)
    bare = strip_comments(text, ext)
    code = [s for x in bare.split("\n") if (s := x.strip()) and not _IMPORT.match(s) and s not in ("<script>", '<script lang="ts">', "</script>")]
    out = []
    if is_minified(text):
        out.append("minified")
    if repeated_layout(code) or any(GENERATED_LINE.match(h) for h in heads):
        out.append("generated")
    if is_data(code):
        out.append("data")
    if any(VENDORED_LINE.match(h) for h in heads):
        out.append("vendored")
    return out


def leaf_hash(text: str, ext: str) -> tuple[int, int]:
    """(signed 64-bit hash, length) of the code without comments and white space."""
    bare = "".join(strip_comments(text, ext).split())
    return int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), len(bare)


def leaves(files: DataFrame) -> DataFrame:
    """``file, repo, rel, hash, chars, sorts`` of every file version; null texts count as empty."""
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    rows = files.select(F.col("id").alias("file"), "repo", "rel", ext.alias("ext"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exts, texts = b.column(3).to_pylist(), b.column(4).to_pylist()
            got = [(leaf_hash(t or "", e or ""), sorts(t or "", e or "")) for e, t in zip(exts, texts)]
            arrays = [b.column(0), b.column(1), b.column(2), pa.array([g[0][0] for g in got], pa.int64()), pa.array([g[0][1] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["file", "repo", "rel", "hash", "chars", "sorts"])

    return rows.mapInArrow(run, "file long, repo string, rel string, hash long, chars long, sorts array<string>")


def merkle(leaf: DataFrame) -> DataFrame:
    """All nodes of the directory trees: ``repo, path, depth, hash, chars, files, leaf``.

    ``path`` of a file is its ``rel``, of a directory its path, '' for the
    root.  A directory's hash is made from the sum and the number of its
    children's hashes: it does not depend on names or order, and it is summed
    on the map side, so a directory with very many entries is no hot group.
    Levels are folded from the deepest up.
    """
    depth = F.size(F.split("rel", "/"))
    nodes = leaf.where(F.col("rel").isNotNull()).select("repo", F.col("rel").alias("path"), depth.alias("depth"), "hash", "chars", F.lit(1).cast("long").alias("files"), F.lit(True).alias("leaf")).distinct()
    nodes = staged(nodes, "leaves")
    top = nodes.agg(F.max("depth")).first()[0] or 0
    level, out = nodes.where(F.col("depth") == top), nodes
    for d in range(top - 1, -1, -1):
        dirs = level.groupBy("repo", dirname(F.col("path")).alias("path")).agg(F.sum(F.col("hash").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("files").alias("files"))
        dirs = dirs.select("repo", "path", F.lit(d).alias("depth"), F.when((F.col("n") == 1), F.xxhash64(F.col("s"))).otherwise(F.xxhash64("s", "n")).alias("hash"), "chars", "files", F.lit(False).alias("leaf"))
        dirs = staged(dirs, "level")
        out = out.unionByName(dirs)
        level = dirs.unionByName(nodes.where(F.col("depth") == d)) if d else dirs
    return out


def families(nodes: DataFrame) -> DataFrame:
    """Repositories that are forks or mirrors of one another: ``repo, family``, one row per repository.

    Every file content names the first repository that holds it; a repository
    joins the one that it shares most code with in this way, if that is at
    least ``FORK_SHARE`` of the code of both.  A content counts the less the
    more repositories hold it, so packages that many have relate nobody.  One
    row per (content, repository) is summed, whatever their numbers: no pairs
    of repositories are formed.  A repository names an earlier one, so chains
    end; they are followed by doubling.
    """
    holds = nodes.where(F.col("leaf") & (F.col("chars") > 0)).select("hash", "repo").distinct()
    n = holds.groupBy("hash").agg(F.count("*").alias("n"), F.min("repo").alias("to"))
    per = staged(salted_join(holds, n, ["hash"]).select("repo", "to", (1 / (1 + F.log("n"))).alias("w")).groupBy("repo", "to").agg(F.sum("w").alias("w")), "holds")
    whole = per.groupBy("repo").agg(F.sum("w").alias("whole"))
    links = per.where("repo <> to").join(whole, "repo").where(F.col("w") >= FORK_SHARE * F.col("whole"))
    links = links.join(whole.select(F.col("repo").alias("to"), F.col("whole").alias("other")), "to").where(F.col("w") >= FORK_SHARE * F.col("other"))
    links = staged(links.groupBy("repo").agg(F.max_by("to", F.struct("w", "to")).alias("to")), "forks")
    while True:
        on = links.alias("a").join(links.alias("b"), F.col("a.to") == F.col("b.repo"), "left")
        links = staged(on.select("a.repo", F.coalesce("b.to", "a.to").alias("to"), F.col("b.to").isNotNull().alias("far")), "forks")
        if links.where("far").isEmpty():
            break
        links = links.select("repo", "to")
    return whole.select("repo").join(links, "repo", "left").select("repo", F.coalesce("to", "repo").alias("family"))


def shared_subtrees(nodes: DataFrame) -> DataFrame:
    """Topmost paths ``repo, path`` whose hash occurs in several unrelated repositories.

    Forks and mirrors of one repository count once (``families``).  Roots
    themselves are never vendored; nodes with less than ``SHARED_CHARS`` of
    code say nothing.
    """
    big = nodes.where((F.col("depth") > 0) & (F.col("chars") >= SHARED_CHARS)).select("repo", "path", "hash")
    # one row per (hash, repository) before the count: a file copied within one repository is one occurrence
    seen = big.select("hash", "repo").distinct().join(families(nodes), "repo", "left").select("hash", F.coalesce("family", "repo").alias("family")).distinct()
    many = seen.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    return big.join(many, "hash", "left_semi").select("repo", "path").distinct()


def classify_origin(files: DataFrame) -> DataFrame:
    """``file, repo, rel, origin`` for every file version that is not hand-written.

    ``origin`` is the sorted array of its sorts.  Recorded class, name and
    directory are not used.  Empty texts are hand-written.  A file is vendored
    if it or a directory above it is a shared subtree.
    """
    leaf = staged(leaves(files).distinct(), "origin")
    shared = shared_subtrees(merkle(leaf))
    shared = staged(shared, "shared")
    # each file asks for itself and its directories: as many rows as its path has parts
    parts = F.split("rel", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = leaf.where(F.col("rel").isNotNull()).select("file", "repo", F.explode(paths).alias("path"))
    under = salted_join(asked, shared, ["repo", "path"], "left_semi").select("file").distinct()
    both = leaf.join(under.withColumn("copied", F.lit(True)), "file", "left")
    origin = F.array_sort(F.array_distinct(F.when(F.col("copied"), F.concat("sorts", F.array(F.lit("vendored")))).otherwise(F.col("sorts"))))
    return both.select("file", "repo", "rel", origin.alias("origin")).where(F.size("origin") > 0)
