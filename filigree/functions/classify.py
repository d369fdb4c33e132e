"""Row-wise classification of files, texts, specifiers and URLs; JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.paths import basename, extension

# Markers of generated files, looked for in the first 4,096 characters.
GENERATED_MARKERS = ("@generated", "Code generated by", "DO NOT EDIT", "do not edit", "auto-generated", "autogenerated", "This file was automatically generated", "Generated by Django")
# A line longer than this many bytes, among the first 200, marks minified text.
LINE_BYTES, LINES_READ, HEAD_CHARS = 2000, 200, 4096
# Extensions of files that are imported but hold no code.
ASSET_EXTENSIONS = ("css", "scss", "sass", "less", "styl", "json", "json5", "svg", "png", "jpg", "jpeg", "gif", "webp", "avif", "ico", "woff", "woff2", "ttf", "otf", "html", "md", "mdx", "txt", "yaml", "yml", "graphql", "gql", "wasm")
# Modules that the runtime brings, and prefixes of package protocols.
RUNTIME_MODULES = ("assert", "buffer", "child_process", "cluster", "console", "crypto", "dgram", "dns", "events", "fs", "http", "http2", "https", "net", "os", "path", "perf_hooks", "process", "querystring", "readline", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib")
PROTOCOLS = ("node:", "bun:", "npm:", "jsr:")
# Salience of symbol kinds.
SALIENCE = {"function": 5, "class": 5, "interface": 4, "enum": 3, "type_alias": 3, "method": 2, "const": 1}


def language(rel: Column) -> Column:
    """Language named by the extension, null for others."""
    e = extension(rel)
    out = F.when(e.isin("ts", "mts", "cts"), "ts").when(e == "tsx", "tsx").when(e.isin("js", "mjs", "cjs"), "js")
    return out.when(e == "jsx", "jsx").when(e == "py", "python").when(e == "vue", "vue").when(e == "svelte", "svelte")


def is_test(rel: Column) -> Column:
    low = F.lower(rel)
    base = F.lower(basename(rel))
    return low.rlike(r"__tests__/|__mocks__/|^tests?/|/tests?/|/e2e/|\.test\.|\.spec\.") | base.rlike(r"^test_|_test\.py$|^conftest\.py$")


def is_config(rel: Column) -> Column:
    base = F.lower(basename(rel))
    return base.rlike(r"\.config\.|^\.eslintrc|^\.prettierrc") | base.isin("next-env.d.ts", "commitlint.config.js")


def lines(text: Column) -> Column:
    """Lines of a text: no empty one after a final line end, none in an empty text, no carriage return at the end."""
    parts = F.split(text, "\n", -1)
    kept = F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.when(x.endswith("\r"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def is_generated(text: Column) -> Column:
    head = F.substring(text, 1, HEAD_CHARS)
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked = marked | head.contains(m)
    return marked | F.exists(F.slice(lines(text), 1, LINES_READ), lambda x: F.octet_length(x) > LINE_BYTES)


def file_class(rel: Column, text: Column) -> Column:
    """Class of a file: declarations, generated, test, config, or source, in this order."""
    return F.when(rel.endswith(".d.ts"), "vendored").when(is_generated(text), "generated").when(is_test(rel), "test").when(is_config(rel), "config").otherwise("source")


def is_analyzed(cls: Column) -> Column:
    return cls.isin("source", "test", "config")


def loc(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def token_estimate(text: Column) -> Column:
    """Rough token count: a quarter of the characters, and one."""
    return F.floor(F.length(text) / 4).cast("long") + 1


def stem_key(name: Column) -> Column:
    """Lower case without underscores; one plural ``s`` off names longer than three letters."""
    low = F.lower(F.replace(name, F.lit("_"), F.lit("")))
    plural = (F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss")
    return F.when(plural, F.substr(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def is_asset(spec: Column) -> Column:
    tail = F.regexp_replace(F.substring_index(spec, "/", -1), r"[?#].*$", "")
    return F.lower(F.regexp_extract(tail, r"\.([^.]*)$", 1)).isin(*ASSET_EXTENSIONS)


def looks_like_package(spec: Column) -> Column:
    return F.substring_index(spec, "/", 1).rlike(r"^[a-z0-9._-]+$")


def is_external(spec: Column) -> Column:
    proto = F.lit(False)
    for p in PROTOCOLS:
        proto = proto | spec.startswith(p)
    plain = ~spec.startswith("@") & ~spec.startswith("~") & looks_like_package(spec)
    return ~spec.startswith(".") & (proto | spec.isin(*RUNTIME_MODULES) | plain)


def package_name(spec: Column) -> Column:
    """The package of a bare specifier: two parts where scoped, else one; protocol off except ``bun:``."""
    bare = F.regexp_replace(spec, r"^(node:|npm:|jsr:)", "")
    parts = F.split(bare, "/")
    return F.when(bare.startswith("@") & (F.size(parts) >= 2), F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0])


def route_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), r"^/+|/+$", "")


def contract_path(url: Column) -> Column:
    """A URL path as both sides of a contract write it; null with fewer than two segments.

    Query and fragment go, empty segments go, parameters become ``{}``.
    """
    segs = F.filter(F.split(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/"), lambda x: x != "")
    segs = F.transform(segs, lambda x: F.when(x.rlike(r"^(:.*|<.*>|[0-9]+)$"), "{}").otherwise(x))
    return F.when(F.size(segs) >= 2, F.array_join(segs, "/"))


def flat_route_segments(raw: Column) -> Column:
    """Static segments of a route without nested brackets of one kind (``names.route_segments`` takes all)."""
    flat = F.regexp_replace(raw, r"\([^()]*\)|<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|\\.", "/")
    return F.filter(F.split(flat, r"[^A-Za-z0-9_-]+"), lambda x: x.rlike(r"^[A-Za-z].+$"))
