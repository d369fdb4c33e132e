"""Reading a repository tree into the ``files`` table.

The walk over directory entries is driver work; contents are read by Spark's
``binaryFile`` source where the tree is on shared storage, or by the driver for
a checkout on its own disk.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import classify as C

# Directories of other people's or built files, the size cap in bytes, configuration files watched.
VENDOR_DIRS = frozenset("node_modules bower_components vendor dist build out coverage target .next .nuxt .svelte-kit .turbo .output storybook-static __snapshots__ __pycache__ .venv venv .tox site-packages".split())
SIZE_MOST = 512 * 1024
CONFIG_NAMES = frozenset(("package.json", "tsconfig.json", "jsconfig.json", "pnpm-workspace.yaml", "pyproject.toml"))
CODE = re.compile(r"\.(?:ts|mts|cts|tsx|js|mjs|cjs|jsx|py|vue|svelte)\Z")


def _glob(segment: str) -> str:
    """One segment of an ignore pattern as a regular expression."""
    out = re.sub(r"\\\[(!|\\\^)?(.+?)\\\]", lambda m: "[" + "^" * bool(m.group(1)) + m.group(2).replace("\\-", "-") + "]", re.escape(segment))
    return out.replace(r"\*", "[^/]*").replace(r"\?", "[^/]")


class Ignore:
    """The rules of the ignore files on the way to a directory; later rules win, ``!`` takes back."""

    def __init__(self, rules: list[tuple[str, re.Pattern, bool, bool]] | None = None):
        self.rules = rules or []

    def within(self, base: str, text: str) -> Ignore:
        out = list(self.rules)
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].lstrip("\\") if keep else line
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            parts = ["(?:.*/)?" if p == "**" else _glob(p) + "/" for p in line.split("/")]
            body = "".join(parts).removesuffix("/") if parts[-1] != "(?:.*/)?" else "".join(parts) + ".*"
            out.append((base, re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), only_dir, keep))
        return Ignore(out)

    def hit(self, rel: str, is_dir: bool) -> bool:
        ignored = False
        for base, pattern, only_dir, keep in self.rules:
            if only_dir and not is_dir or base and not rel.startswith(base + "/"):
                continue
            if pattern.match(rel[len(base) + 1 :] if base else rel):
                ignored = not keep
        return ignored


def walk(root: str | Path, covered: Callable[[str], bool] = lambda rel: False) -> list[tuple[str, int, int]]:
    """``(rel, size, mtime_ns)`` of all files, sorted.

    Hidden entries, ignored ones, vendor directories (unless ``covered`` by a
    workspace pattern; ``node_modules`` never is) and Python environments are
    not entered; links are not followed.
    """
    root, out = Path(root).resolve(), []

    def enter(rel: str, ignore: Ignore) -> None:
        here = root / rel
        for name in (".gitignore", ".ignore"):
            if (here / name).is_file():
                ignore = ignore.within(rel, (here / name).read_text(errors="replace"))
        for e in sorted(os.scandir(here), key=lambda e: e.name):
            path = f"{rel}/{e.name}" if rel else e.name
            if e.name.startswith(".") or e.is_symlink() or ignore.hit(path, e.is_dir()):
                continue
            if e.is_dir():
                if e.name in VENDOR_DIRS and (e.name == "node_modules" or not covered(path)):
                    continue
                if (Path(e.path) / "pyvenv.cfg").is_file() or (Path(e.path) / "conda-meta").is_dir():
                    continue
                enter(path, ignore)
            elif e.is_file():
                s = e.stat()
                out.append((path, s.st_size, s.st_mtime_ns))

    enter("", Ignore())
    return sorted(out)


def snapshot(root: str | Path, covered: Callable[[str], bool] = lambda rel: False) -> list[tuple[str, int, int]]:
    """``(path, mtime_ns, size)`` of the sources, the watched configuration files and what those extend."""
    from filigree.sources.manifests import extended_configs

    root = Path(root).resolve()
    out = {r: (m, s) for r, s, m in walk(root, covered) if CODE.search(r) and s <= SIZE_MOST or r.rsplit("/", 1)[-1] in CONFIG_NAMES}
    for r in extended_configs(root):
        st = (root / r).stat()
        out[r] = (st.st_mtime_ns, st.st_size)
    return [(r, m, s) for r, (m, s) in sorted(out.items())]


def files(spark: SparkSession, root: str | Path, repo: str | None = None, covered: Callable[[str], bool] = lambda rel: False, known: dict[str, list] | None = None) -> DataFrame:
    """The ``files`` table of a checkout: ``repo, id, rel, language, bytes, loc, class, mtime_ns, hash, text``.

    Ids count from 0 in path order, which many tie-breaks rely on.  Files whose
    time stamp and size are as in ``known`` (see ``inventory``) are not read:
    they take over hash, lines and class, and have a null ``text``.
    """
    root = Path(root).resolve()
    repo = repo or root.name
    rows = []
    for rel, size, mtime in walk(root, covered):
        if CODE.search(rel) and size <= SIZE_MOST:
            was = (known or {}).get(rel)
            if was and was[:2] == [mtime, size]:
                rows.append((repo, len(rows), rel, size, mtime, was[2], None, was[3], was[4]))
                continue
            text = (root / rel).read_bytes().decode("utf-8", "replace")
            rows.append((repo, len(rows), rel, size, mtime, hashlib.sha256(text.encode()).hexdigest(), text, None, None))
    df = spark.createDataFrame(rows, "repo string, id long, rel string, bytes long, mtime_ns long, hash string, text string, known_loc long, known_class string")
    new = classified(df)
    return new.withColumns({"loc": F.coalesce("known_loc", "loc"), "class": F.coalesce("known_class", "class")}).withColumn("test", F.col("class") == "test").drop("known_loc", "known_class")


def inventory(files: DataFrame) -> dict[str, list]:
    """``rel`` to time stamp, size, hash, lines and class: what the next walk need not read again."""
    return {r.rel: [r.mtime_ns, r.bytes, r.hash, r.loc, r["class"]] for r in files.select("rel", "mtime_ns", "bytes", "hash", "loc", "class").collect()}


def classified(df: DataFrame) -> DataFrame:
    """Adds language, class, loc and the flags that the operators read."""
    rel, text = F.col("rel"), F.coalesce("text", F.lit(""))
    lang = C.language(rel)
    return df.withColumns({"language": lang, "class": C.file_class(rel, text), "loc": C.loc(text), "python": lang == "python"}).withColumn("test", F.col("class") == "test")


def binary_files(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """The same table from shared storage, read by the executors.

    Vendor and hidden directories are pruned by path, ignore files are not
    read.  Ids are hashes of the path: a dense number would need a global sort.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    skip = "(^|/)(" + "|".join(re.escape(d) for d in sorted(VENDOR_DIRS)) + r"|\.[^/]+)(/|$)"
    f = raw.where(F.col("length") <= SIZE_MOST).withColumn("rel", rel).where(F.col("rel").rlike(r"\.(ts|mts|cts|tsx|js|mjs|cjs|jsx|py|vue|svelte)$") & ~F.col("rel").rlike(skip))
    f = f.select(F.lit(repo).alias("repo"), F.xxhash64(F.lit(repo), "rel").alias("id"), "rel", F.col("length").alias("bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))
    return classified(f)
