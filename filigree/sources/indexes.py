"""Reading the text indexes back into tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARROW = " ← "


def imports_table(spark: SparkSession, path: str) -> DataFrame:
    """``target, importer`` of an import index; lines that are no entries are skipped."""
    t = spark.read.text(path).where(F.col("value").contains(ARROW))
    p = F.split("value", ARROW, 2)
    return t.select(p[0].alias("target"), F.explode(F.split(p[1], ", ")).alias("importer")).where("target <> '' AND importer <> ''")


def routes_table(spark: SparkSession, path: str) -> DataFrame:
    """``view, file, route, caller`` of a route index, one row per combination.

    The heading of a section is carried forward to its lines by their order in
    the file, which is one small file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^## `([^`]*)` — `([^`]*)`", 1)
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.select("n", "line", F.last(F.when(head != "", F.struct(head.alias("view"), F.regexp_extract("line", r"^## `[^`]*` — `([^`]*)`", 1).alias("file"))), ignorenulls=True).over(w).alias("s")).where("s IS NOT NULL")
    routes = s.where("line LIKE 'Routes: %'").select("s.view", "s.file", F.explode(F.regexp_extract_all("line", F.lit("`([^`]*)`"), F.lit(1))).alias("route"))
    callers = s.where("line LIKE '- `%'").select("s.view", "s.file", F.regexp_extract("line", "^- `([^`]*)`", 1).alias("caller"))
    return routes.join(callers, ["view", "file"])


def parse_imports(text: str) -> dict[str, list[str]]:
    """The import index as a mapping; for single lookups without a session."""
    rows = (line.split(ARROW, 1) for line in text.splitlines() if ARROW in line)
    return {a: b.split(", ") for a, b in rows if a and b}


def parse_routes(text: str) -> list[dict]:
    """Sections of the route index: ``view, file, routes, callers``."""
    out: list[dict] = []
    for line in text.splitlines():
        if m := re.match(r"## `([^`]*)` — `([^`]*)`", line):
            out.append({"view": m.group(1), "file": m.group(2), "routes": [], "callers": []})
        elif out and line.startswith("Routes: "):
            out[-1]["routes"] = re.findall(r"`([^`]*)`", line)
        elif out and (m := re.match(r"- `([^`]*)`", line)):
            out[-1]["callers"].append(m.group(1))
    return out
