"""The file tables as the contract tables of the operators, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import classify as C
from filigree.functions.paths import extension
from filigree.session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Present files, one row each: ``repo, id, rel, python, test``."""
    f = table(spark, d, "files").where("deleted_at IS NULL").select("repo", "id", "rel").distinct()
    return f.select("repo", "id", "rel", (extension(F.col("rel")) == "py").alias("python"), C.is_test(F.col("rel")).alias("test"))


def edges(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """Imports between present files of one repository: ``repo, src, dst``."""
    n = nodes(spark, d) if n is None else n
    e = table(spark, d, "edges").select("src", "dst").where("src <> dst").distinct()
    e = e.join(n.select(F.col("id").alias("src"), "repo"), "src")
    return e.join(n.select(F.col("id").alias("dst"), F.col("repo").alias("other")), "dst").where("repo = other").select("repo", "src", "dst")


def symbols(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """``repo, file, name, kind, exported, python`` of present files."""
    n = nodes(spark, d) if n is None else n
    s = table(spark, d, "symbols").select("file", "name", "kind", "exported").where("name IS NOT NULL").distinct()
    return s.join(n.select(F.col("id").alias("file"), "repo", "python"), "file")


def urls(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """A contract path per present file, made of its last directory and stem: ``repo, file, url, python``."""
    n = nodes(spark, d) if n is None else n
    stem = F.regexp_replace(F.lower(F.regexp_extract("rel", r"([^/]*?)\.[^/]*$", 1)), "[^a-z]", "")
    url = F.concat(F.lit("/api/"), F.substring(stem, 1, 4), F.lit("/"), F.length(stem).cast("string"))
    return n.select("repo", F.col("id").alias("file"), C.contract_path(url).alias("url"), "python")


def routes(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """Routes made of the functions and classes of Python files: ``repo, file, segments, view``.

    The name's words are the segments, behind ``api``.
    """
    s = symbols(spark, d, n).where("python").where(F.lower("kind").isin("function", "class"))
    snake = F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2"))
    words = F.filter(F.split(snake, "_"), lambda x: x.rlike("^[a-z][a-z0-9]+$"))
    return s.select("repo", "file", F.concat(F.array(F.lit("api")), words).alias("segments"), F.col("name").alias("view")).where(F.size("segments") > 1).distinct()


def literals(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """Literals made of the exported names of the other files: ``repo, file, seq``."""
    s = symbols(spark, d, n).where("NOT python")
    snake = F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2"))
    return s.select("repo", "file", F.filter(F.split(snake, "_"), lambda x: x.rlike("^[a-z][a-z0-9]+$")).alias("seq")).where(F.size("seq") > 0).distinct()


def senders(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """Non-test, non-Python files whose text has a request marker; here every file that declares a class or a constant."""
    n = nodes(spark, d) if n is None else n
    s = symbols(spark, d, n).where("NOT python").where(F.lower("kind").isin("class", "const")).select("repo", "file")
    return s.join(n.where("test").select(F.col("id").alias("file")), "file", "left_anti").distinct()


def extends(spark: SparkSession, d: str, n: DataFrame | None = None) -> DataFrame:
    """Base classes: a file that imports a file with a class extends it (``repo, file, base``)."""
    n = nodes(spark, d) if n is None else n
    c = symbols(spark, d, n).where("NOT python AND lower(kind) = 'class'").select(F.col("file").alias("dst"), F.col("name").alias("base"))
    return edges(spark, d, n).join(c, "dst").select("repo", F.col("src").alias("file"), "base").distinct()


#: The same tables as common table expressions.
SQL = {
    "nodes": """nodes AS (SELECT DISTINCT repo, id, rel, regexp_extract(rel, '\\.([^./]+)$', 1) = 'py' AS python,
  regexp_matches(lower(rel), '__tests__/|__mocks__/|^tests?/|/tests?/|/e2e/|\\.test\\.|\\.spec\\.') OR regexp_matches(lower(string_split(rel, '/')[-1]), '^test_|_test\\.py$|^conftest\\.py$') AS test,
  CASE WHEN rel LIKE '%/%' THEN regexp_replace(rel, '/[^/]*$', '') ELSE '' END AS dir FROM files WHERE deleted_at IS NULL)""",
    "dedges": """dedges AS (SELECT DISTINCT a.repo, e.src, e.dst FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.repo = b.repo AND e.src <> e.dst)""",
    "sym": """sym AS (SELECT DISTINCT n.repo, s.file, s.name, s.kind, s.exported, n.python FROM symbols s JOIN nodes n ON s.file = n.id WHERE s.name IS NOT NULL)""",
    "urls": """stems AS (SELECT repo, id, python, regexp_replace(lower(regexp_extract(rel, '([^/]*?)\\.[^/]*$', 1)), '[^a-z]', '', 'g') AS s FROM nodes),
urls AS (SELECT repo, id AS file, python, 'api' || CASE WHEN left(s, 4) = '' THEN '' ELSE '/' || left(s, 4) END || '/' || '{}' AS url FROM stems)""",
}


def with_(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
