"""One form for texts that look the same (DuckDB inside Arrow partitions).

Order of the steps, all of them SQL expressions of an embedded DuckDB:

1. invisible characters are removed (``regexp_replace``);
2. full- and half-width forms and one-character spaces are mapped (``translate``);
3. combining accents are composed (``nfc_normalize``);
4. Greek and Cyrillic letters with a Latin shape become Latin, others with a
   shape in common become Cyrillic (``translate``);
5. accents that now stand on Latin letters are composed (``nfc_normalize``).

Compatibility normalisation is not used: it would merge raised digits,
ligatures and other characters that look different.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.salted import hot_keys, salted_join
from filigree.session import staged

# Look-alike letters, each pair of strings aligned by position.
CYRILLIC_FROM, CYRILLIC_TO = "АВЕЅІЈКМНОРСТХҮԚԜаеорсухіјѕһԁԛԝӏ", "ABESIJKMHOPCTXYQWaeopcyxijshdqwl"
GREEK_FROM, GREEK_TO = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ", "ABEZHIKMNOPTYXCjoc"
SHARED_FROM, SHARED_TO = "ΓΠΦκ", "ГПФк"
# Characters without width, and spaces of one character.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿"
SPACES = "               　"


def _width_forms() -> tuple[str, str]:
    """Full- and half-width characters and what they stand for, from the character database."""
    pairs = [(chr(c), unicodedata.decomposition(chr(c)).split()) for c in range(0xFF01, 0xFFEF)]
    pairs = [(c, chr(int(d[1], 16))) for c, d in pairs if len(d) == 2 and d[0] in ("<wide>", "<narrow>")]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def _lookalikes() -> tuple[str, str]:
    """The tables above, and every accented letter on one of their bases that has a composed Latin form."""
    base = dict(zip(CYRILLIC_FROM + GREEK_FROM + SHARED_FROM, CYRILLIC_TO + GREEK_TO + SHARED_TO, strict=True))
    table = dict(base)
    for c in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0] in base:
            to = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
            if len(to) == 1:
                table[chr(c)] = to
    return "".join(table), "".join(table.values())


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(col: str) -> str:
    """The canonical form of a text column as a DuckDB expression."""
    wide_from, wide_to = _width_forms()
    like_from, like_to = _lookalikes()
    seen = f"regexp_replace({col}, {_quote('[' + INVISIBLE + ']')}, '', 'g')"
    flat = f"translate({seen}, {_quote(wide_from + SPACES)}, {_quote(wide_to + ' ' * len(SPACES))})"
    return f"nfc_normalize(translate(nfc_normalize({flat}), {_quote(like_from)}, {_quote(like_to)}))"


def duckdb_map(df: DataFrame, select: str, schema: str, prelude: str = "") -> DataFrame:
    """Run a DuckDB ``SELECT ... FROM batch`` over every Arrow batch of ``df``.

    ``prelude`` is SQL run once per task.  One thread and a fixed memory limit
    per task keep it inside what the executor leaves for Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # never spills to the worker's folder
        if prelude:
            con.execute(prelude)
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                out = con.sql(select).to_arrow_table()
                con.unregister("batch")
                yield from out.to_batches()
        con.close()

    return df.mapInArrow(run, schema)


def canonical(documents: DataFrame) -> DataFrame:
    """``doc_id, text, canon``: the canonical form of every text; null stays null, '' stays ''."""
    return duckdb_map(documents.select("doc_id", "text"), f"SELECT doc_id, text, {canonical_sql('text')} AS canon FROM batch", "doc_id long, text string, canon string")


def form_hashes(documents: DataFrame) -> DataFrame:
    """``doc_id, form, raw``: SHA-256 of canonical form and of the characters; blank texts are left out."""
    sql = f"""WITH c AS (SELECT doc_id, text, {canonical_sql('text')} AS canon FROM batch WHERE text IS NOT NULL)
SELECT doc_id, sha256(canon) AS form, sha256(text) AS raw FROM c WHERE regexp_matches(canon, '\\S')"""
    return duckdb_map(documents.select("doc_id", "text"), sql, "doc_id long, form string, raw string").distinct()


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """One row per document whose form is written in several ways: ``doc_id, form, raw, spellings, documents, links``.

    Texts with the same characters are one spelling.  ``links`` is the number
    of rows (id and spelling) of the class that look the same but have other
    characters; with it a class stands for all its pairs.  Rows are counted
    per spelling first, so copies do not meet in one task.
    """
    h = staged(form_hashes(documents), "forms")
    per = h.groupBy("form", "raw").agg(F.count("*").alias("copies"))
    of = per.groupBy("form").agg(F.count("*").alias("spellings"), F.sum("copies").alias("documents")).where("spellings > 1")
    counted = per.join(of, "form").select("form", "raw", "spellings", "documents", (F.col("documents") - F.col("copies")).alias("links"))
    return salted_join(h, counted, ["form", "raw"])


def lookalike_links(documents: DataFrame) -> DataFrame:
    """The links between spellings as ``doc_id, links_to``: the least document of a spelling to that of its class's first spelling.

    With ``lookalike_classes`` as membership nothing is lost, and there are
    fewer rows than spellings, whatever the number of copies.
    """
    c = lookalike_classes(documents)
    reps = staged(c.groupBy("form", "raw").agg(F.min("doc_id").alias("doc_id")), "reps")
    head = reps.groupBy("form").agg(F.min(F.struct("doc_id", "raw")).alias("h"))
    other = F.col("raw") != F.col("h.raw")
    return salted_join(reps, head, ["form"]).where(other).select("doc_id", F.col("h.doc_id").alias("links_to"))


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """Pairs ``doc_a < doc_b`` whose texts differ in characters but have one canonical form.

    Null, empty and blank texts are in no pair, nor are exact copies with each
    other.  The work grows with the pairs that come out, however many copies a
    spelling has.
    """
    c = staged(lookalike_classes(documents), "classes")
    # spellings are paired first, then given their documents: copies of one spelling never meet each other
    reps = c.select("form", "raw").distinct()
    two = reps.withColumnRenamed("raw", "raw_a").join(reps.withColumnRenamed("raw", "raw_b"), "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    a, b = c.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("x")), c.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("y"))
    # both are staged or small against the pairs: hot spellings are counted on the classes alone
    hot = staged(hot_keys(c.select(F.col("raw").alias("k")), ["k"]), "hot")
    left = salted_join(a, two, ["raw_a"], hot=hot.withColumnRenamed("k", "raw_a"))
    pairs = salted_join(left, b, ["raw_b"], hot=hot.withColumnRenamed("k", "raw_b"))
    return pairs.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
