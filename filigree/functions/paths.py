"""Path expressions on columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source extensions in order of precedence.
CODE_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "vue", "svelte", "py")
# Script endings a specifier may carry though the file has another.
SCRIPT_SUFFIX = r"\.(js|jsx|mjs|cjs)$"


def extension(rel: Column) -> Column:
    """Text after the last dot of the basename, '' without one."""
    return F.regexp_extract(rel, r"\.([^./]+)$", 1)


def dirname(rel: Column) -> Column:
    """Everything before the last slash, '' at the root."""
    return F.when(rel.contains("/"), F.regexp_replace(rel, r"/[^/]*$", "")).otherwise(F.when(rel.isNotNull(), F.lit("")))


def basename(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def stem(rel: Column) -> Column:
    """Basename before its first dot."""
    return F.substring_index(basename(rel), ".", 1)


def join_relative(base: Column, tail: Column) -> Column:
    """``tail`` seen from directory ``base``; ``.`` folds, ``..`` at the root stays there."""
    parts = F.split(F.concat_ws("/", base, tail), "/")
    none = F.array().cast("array<string>")
    return F.array_join(
        F.aggregate(
            parts,
            none,
            lambda acc, x: F.when((x == ".") | (x == ""), acc)
            .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(x))),
        ),
        "/",
    )


def lexical_rel(path: Column) -> Column:
    """Repository-relative form of a path, null where it leaves the root.

    Backslashes become slashes, ``.`` and empty segments fold, ``..`` pops.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    none = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    folded = F.aggregate(
        parts,
        none,
        lambda acc, x: F.when((x == ".") | (x == ""), acc)
        .when(x == "..", F.struct(F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["ok"] & (F.size(acc["p"]) > 0)).alias("ok")))
        .otherwise(F.struct(F.concat(acc["p"], F.array(x)).alias("p"), acc["ok"].alias("ok"))),
    )
    return F.when(folded["ok"], F.array_join(folded["p"], "/"))


def served_keys(rel: Column) -> Column:
    """The specifier paths a file answers to, without duplicates.

    Its own path; the path without a code extension; and the directory, when
    the file is its ``index`` or ``__init__``.
    """
    ext = rf"\.({'|'.join(CODE_EXTENSIONS)})$"
    bare = F.when(rel.rlike(ext), F.regexp_replace(rel, ext, ""))
    is_pkg = bare.rlike(r"(^|/)(index|__init__)$")
    return F.array_distinct(F.array_compact(F.array(rel, bare, F.when(is_pkg, dirname(bare)))))


def python_relative(base: Column, spec: Column) -> Column:
    """Path of a dotted relative import, null above the root.

    The first dot is the importer's directory, each further one its parent.
    """
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    up = F.when(base == "", F.array().cast("array<string>")).otherwise(F.split(base, "/"))
    kept = F.slice(up, F.lit(1), F.greatest(F.size(up) - (dots - 1), F.lit(0)))
    tail = F.replace(F.substr(spec, dots + 1), F.lit("."), F.lit("/"))
    path = F.concat_ws("/", F.array_join(kept, "/"), tail)
    # concat_ws keeps empty strings, so outer slashes of an empty base or tail go
    return F.when(F.size(up) >= dots - 1, F.regexp_replace(path, r"^/|/$", ""))
