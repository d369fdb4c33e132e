"""Commits from the version control log."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commits read at most; the co-change window makes older ones worthless.
LOG_ENTRIES = 2000


def read_log(root: str | Path) -> str:
    """Raw log text: NUL, epoch seconds, then one path per line; '' without a repository."""
    cmd = ["git", "-C", str(root), "log", "--no-merges", "--name-only", f"-n{LOG_ENTRIES}", "--pretty=%x00%H %ct"]
    try:
        r = subprocess.run(cmd, capture_output=True, text=True, errors="replace", timeout=300)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return r.stdout if r.returncode == 0 else ""


def head(root: str | Path) -> str | None:
    try:
        r = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return r.stdout.strip() if r.returncode == 0 else None


def parse_log(logs: DataFrame) -> DataFrame:
    """``repo, commit_id, seconds, files`` of log texts ``repo, log``; malformed and empty commits are dropped."""
    c = logs.select("repo", F.explode(F.split("log", "\\x00")).alias("c"))
    lines = F.split("c", "\n")
    first = lines[0]
    paths = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), F.trim), lambda x: x != "")
    sec = F.expr("try_cast(regexp_extract(split(c, '\\n')[0], '(\\\\d+)\\\\s*$', 1) AS BIGINT)")
    return c.select("repo", F.regexp_extract(first, r"^(\S+)\s+\d+\s*$", 1).alias("commit_id"), sec.alias("seconds"), paths.alias("files")).where("seconds IS NOT NULL AND size(files) > 0")


def commits(spark: SparkSession, root: str | Path, repo: str) -> DataFrame:
    return parse_log(spark.createDataFrame([(repo, read_log(root))], "repo string, log string"))
