"""A repository from its files to its indexes and its map."""

from __future__ import annotations

import itertools
import json
import os
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.names import assign_slugs
from filigree.operators import cluster, cochange, contracts, graph, resolve, summary
from filigree.session import cut
from filigree.sinks import render
from filigree.sources import extract, gitlog, manifests, walk
from filigree.sources.store import FactStore

INDEX_DIR = ".filigree"


@dataclass
class Index:
    """The tables of one repository."""

    repo: str
    root: Path
    profile: manifests.Profile
    files: DataFrame
    nodes: DataFrame
    tables: dict[str, DataFrame]
    outcomes: DataFrame
    edges: DataFrame
    links: DataFrame
    store: str | None = None


def build(spark: SparkSession, root: str | Path, store: str | None = None) -> Index:
    """Inventory, parsing, resolution and contracts of a checkout.

    With a ``store`` folder only files whose time stamp or size changed are
    read, and only those whose content changed are parsed.
    """
    root = Path(root).resolve()
    repo = root.name
    prof = manifests.read(root)
    patterns = manifests.workspace_patterns(root)
    seen = Path(store) / "inventory.json" if store else None
    facts = FactStore(spark, store) if store else None
    known = facts.trusted(repo, json.loads(seen.read_text())) if seen and seen.is_file() else None
    files = cut(walk.files(spark, root, repo, lambda rel: any(manifests.pattern_covers(p, rel) for p in patterns), known))
    if files.isEmpty():
        raise ValueError(f"no source files under {root}")
    nodes = files.where(F.col("class").isin("source", "test", "config")).select("repo", "id", "rel", "python", "test", "class", "language")
    sources = files.join(nodes.select("id"), "id", "left_semi")
    parsed = cut(facts.parse(sources) if facts else extract.parse(sources))
    if seen:
        # files that are not parsed have no stored facts and are read again
        render.write_atomic(seen, json.dumps(walk.inventory(files)))
    t = extract.child_tables(parsed)
    alias = spark.createDataFrame([(repo, *r) for r in manifests.alias_rows(prof)] or [(repo, "", "\0", "\0", 0, False)], "repo string, scope string, pattern string, target string, place int, stop boolean")
    local = spark.createDataFrame([(repo, w["name"]) for w in prof.packages] or [(repo, "\0")], "repo string, package string")
    on_disk = spark.createDataFrame([(repo, r) for r, _, _ in walk.walk(root)] or [(repo, "\0")], "repo string, path string")
    roots = spark.createDataFrame([(repo, d) for d in prof.package_dirs if any(p.suffix == ".py" for p in (root / d).rglob("*.py"))] or [(repo, "")], "repo string, root string")
    # an include is looked up like an absolute import; members count when they are modules, and never otherwise
    refs = t["refs"].withColumn("specifier", F.regexp_replace("specifier", "^" + extract.INCLUDE_MARK, "")).select("file", "pos", "specifier")
    out = cut(resolve.outcomes(refs, nodes, local, alias, on_disk, root_base=False, extra_roots=roots))
    members = t["members"].select("file", F.col("pos").alias("pos"), "specifier")
    extra = resolve.resolved_edges(resolve.outcomes(members, nodes, None, None, None, root_base=False, extra_roots=roots))
    edges = cut(resolve.resolved_edges(out).unionByName(extra).distinct())
    sym = t["symbols"].join(nodes.select(F.col("id").alias("file"), "python", "test"), "file")
    keys = resolve.file_keys(nodes)
    inc = t["includes"].withColumn("key", F.replace("module", F.lit("."), F.lit("/"))).join(keys, ["repo", "key"]).select("repo", "file", "segments", F.col("id").alias("target"))
    routes = contracts.stitch(t["routes"], inc)
    front = sym.where("NOT test")
    http = contracts.http_files(t["http"].join(nodes.where("NOT test AND NOT python").select(F.col("id").alias("file")), "file", "left_semi"), t["extends"], front)
    links = cut(contracts.route_links(routes, sym, t["literals"], http))
    return Index(repo, root, prof, files, nodes, t, out, edges, links, store)


def write_indexes(ix: Index, state: Path | None = None) -> dict:
    """Write the import and the route index into ``state``; returns what the run found.

    The indexes are files for single lookups, so their rows pass the driver
    here, in order and one partition at a time.
    """
    pairs = graph.import_pairs(ix.nodes, ix.edges).orderBy("target", "importer").toLocalIterator()
    rows = [(t, ", ".join(r.importer for r in g)) for t, g in itertools.groupby(pairs, lambda r: r.target)]
    rate = resolve.rates(ix.outcomes).first()
    miss = [(r.rel, r.specifier) for r in ix.outcomes.where("outcome = 'unresolved'").join(ix.nodes.select(F.col("id").alias("file"), "rel"), "file").select("rel", "specifier").orderBy("rel", "specifier").collect()]
    here = state or ix.root / INDEX_DIR
    value = rate.rate if rate else 1.0
    render.write_atomic(here / "imports.md", render.imports_markdown(ix.profile.name or ix.repo, rows, value, len(miss)))
    links = link_rows(ix)
    if links:
        render.write_atomic(here / "routes.md", render.routes_markdown(links))
    else:
        (here / "routes.md").unlink(missing_ok=True)
    stats = "\n".join(f"{p}\t{m}\t{s}" for p, m, s in walk.snapshot(ix.root))
    render.write_atomic(here / "snapshot.tsv", stats + "\n")
    return {"files": ix.nodes.count(), "imports": sum(len(b.split(", ")) for _, b in rows), "rate": value, "unresolved": miss, "links": links}


def link_rows(ix: Index) -> list[dict]:
    """Route links with paths, by defining file and view."""
    rel = ix.nodes.select("id", "rel")
    v = ix.links.join(rel.select(F.col("id").alias("view_file"), F.col("rel").alias("file")), "view_file")
    c = v.select("view", "file", "routes", F.explode("callers").alias("id")).join(rel, "id").groupBy("view", "file", "routes").agg(F.array_sort(F.collect_set("rel")).alias("callers"))
    return [{"view": r.view, "file": r.file, "routes": list(r.routes), "callers": list(r.callers)} for r in c.orderBy("file", "view").collect()]


def history(ix: Index, git: bool = True) -> tuple[DataFrame, DataFrame, bool]:
    """Churn ``repo, id, n``, pairs ``repo, lo, hi, w, commits``, and whether there is a log.

    With a store both are kept by path under the HEAD they were read at; while
    it has not moved the log is not read, and paths that are no file any more
    drop out.
    """
    spark, n = ix.files.sparkSession, ix.nodes
    head = gitlog.head(ix.root) if git else None
    memo = Path(ix.store) / "git" / head if ix.store and head else None
    ids = n.select("repo", "id", "rel")
    if memo and all((memo / t / "_SUCCESS").is_file() for t in ("churn", "pairs")):
        churn = spark.read.parquet(str(memo / "churn")).join(ids, ["repo", "rel"]).select("repo", "id", "n")
        p = spark.read.parquet(str(memo / "pairs")).join(ids.select("repo", F.col("rel").alias("a"), F.col("id").alias("x")), ["repo", "a"]).join(ids.select("repo", F.col("rel").alias("b"), F.col("id").alias("y")), ["repo", "b"])
        return cut(churn), cut(p.select("repo", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "w", "commits")), True
    commits = gitlog.commits(spark, ix.root, ix.repo)
    commits = commits if git else commits.limit(0)
    touch = cut(cochange.touched(commits, n))
    churn, pairs = cochange.churn(touch), cut(cochange.pairs(touch, n))
    has_log = not commits.isEmpty()
    if memo and has_log:
        shutil.rmtree(memo.parent, True)
        churn.join(ids, ["repo", "id"]).select("repo", "rel", "n").write.parquet(str(memo / "churn"))
        named = pairs.join(ids.select("repo", F.col("rel").alias("a"), F.col("id").alias("lo")), ["repo", "lo"]).join(ids.select("repo", F.col("rel").alias("b"), F.col("id").alias("hi")), ["repo", "hi"])
        named.select("repo", "a", "b", "w", "commits").write.parquet(str(memo / "pairs"))
    return churn, pairs, has_log


def map_facts(ix: Index, max_domains: int = cluster.MAX_DOMAINS, seed: int = cluster.SEED, git: bool = True) -> dict:
    """All that the map shows: clusters with names, symbols, confidence and flows, most important first.

    Without ``git`` the history is not read: no co-change and no churn.
    """
    spark, n, e = ix.files.sparkSession, ix.nodes, ix.edges
    churn, pairs, has_log = history(ix, git)
    url = contracts.url_pairs(ix.tables["urls"].join(n.select(F.col("id").alias("file"), "python"), "file"))
    sym = ix.tables["symbols"].join(n.select(F.col("id").alias("file"), "python"), "file")
    sem = contracts.semantic_pairs(sym, url)
    fused = cut(graph.fuse(e, cochange.normalised(pairs), url, sem, graph.directory_pairs(n)))
    arcs = cut(graph.directed(e, url, sem))
    labels = manifests.entry_labels(ix.profile, [r.rel for r in n.select("rel").orderBy("rel").collect()])
    entries = spark.createDataFrame(labels or [("\0", "")], "rel string, label string").join(n.select("id", "rel"), "rel").select("id", "rel", "label")
    fan = n.select("id").join(arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")), "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    scores = cut(graph.importance(graph.pagerank(n, arcs), fan, churn, entries))
    c = cut(cluster.clusters(n, fused, max_domains, seed))
    m, stab = c.select("repo", "id", "cluster"), c.select("id", "stability")
    conf = {r.cluster: r for r in summary.confidence(m, e, ix.outcomes.where("outcome = 'unresolved'"), stab, pairs if has_log else None, resolve.rates(ix.outcomes)).collect()}
    dirs, syms = cut(summary.dominant_dirs(m, n, scores)), cut(summary.pick_symbols(m, sym, scores))
    ext = summary.cluster_externals(m, ix.outcomes.where("outcome = 'external'").select("file", "package"))
    ranked = cut(summary.ranked_clusters(m, scores))
    names = summary.labels(ranked, dirs, syms, ext).orderBy("place").collect()
    place = {r.cluster: i for i, r in enumerate(names)}
    deps = [(r.cluster, r.depends_on) for r in graph.cluster_edges(m, arcs).collect()]
    rel = {r.id: r.rel for r in n.select("id", "rel").collect()}
    members: dict[int, list] = {}
    for r in m.join(scores.select("id", "score"), "id").collect():
        members.setdefault(r.cluster, []).append((-r.score, rel[r.id], r.id))
    by = lambda df, col: {k: [x for _, x in sorted(v)] for k, v in _group(df, col).items()}
    d_of, s_of, t_of = by(dirs, "dir"), by(syms, "name"), by(summary.routing_terms(m, n), "term")
    budget = {r.cluster: r.budget for r in summary.budgets(m, churn).collect()}
    label_of: dict[int, list[str]] = {}
    for r in entries.collect():
        label_of.setdefault(r.id, []).append(r.label)
    high = spark.createDataFrame([(ix.repo, k) for k, v in conf.items() if v.band == "high"] or [(ix.repo, -1)], "repo string, cluster long")
    flow_of: dict[int, list[dict]] = {}
    for r in summary.flows(m.join(high, ["repo", "cluster"], "left_semi"), n, scores, arcs, entries.select("id", "label")).collect():
        flow_of.setdefault(r.cluster, []).append({"label": r.label, "path": [rel[i] for i in r.path], "leaves": r.leaves})
    domains = []
    for r in names:
        k = r.cluster
        files = sorted(members.get(k, []))
        q = conf[k]
        on, back = sorted(place[b] for a, b in deps if a == k), sorted(place[a] for a, b in deps if b == k)
        domains.append({
            "name": r.name, "summary": r.summary, "files": [p for _, p, _ in files], "dirs": d_of.get(k, []), "symbols": s_of.get(k, []), "terms": t_of.get(k, []),
            "entries": [x for _, _, i in files for x in label_of.get(i, [])][: summary.ENTRIES], "band": q.band, "budget": budget.get(k, summary.BUDGET_LEAST), "flows": flow_of.get(k, []),
            "confidence": {"score": q.score, "band": q.band, "resolution": q.resolution, "stability": q.stability, "agreement": q.agreement},
            "depends_on": [names[i].name for i in on], "depends_on_ids": on, "depended_on_by_ids": back,
        })
    total = sum(len(d["files"]) for d in domains)
    hubs = [(r.rel, r.importers) for r in graph.hubs(n, e).orderBy("rank").collect()]
    rate = resolve.rates(ix.outcomes).first()
    cls = {r[0]: r[1] for r in ix.files.groupBy("class").count().collect()}
    out_of = {"generated": cls.get("generated", 0), "declarations": cls.get("vendored", 0), "config": cls.get("config", 0)}
    said = {"relations": render.relations(pairs.count() if has_log else None, url.count(), sem.count()), "boundary": render.boundary(out_of, ix.outcomes.where("outcome = 'unresolved'").count())}
    for d, r in zip(domains, names):
        d["cluster"] = r.cluster
    return said | {"tables": (n, fused, m)} | {"files": total, "rate": rate.rate if rate else 1.0, "confidence": sum(d["confidence"]["score"] * len(d["files"]) for d in domains) / max(1, total), "frameworks": ix.profile.frameworks(), "hubs": hubs, "domains": domains}


def _group(df: DataFrame, col: str) -> dict[int, list[tuple[int, str]]]:
    out: dict[int, list[tuple[int, str]]] = {}
    for r in df.select("cluster", "rank", col).collect():
        out.setdefault(r[0], []).append((r[1], r[2]))
    return out


def coarse_pages(facts: dict, seed: int) -> list[dict]:
    """The units of a split map: coarse clusters with outside links, and buckets by top directory, each with its domains."""
    n, fused, m = facts["tables"]
    coarse = cluster.clusters(n, fused, most=1 << 30, seed=seed, ladder=(cluster.COARSE_GAMMA,), runs=0).select("repo", "id", "cluster")
    parent = {r.cluster: (r.kind, r.unit) for r in summary.nest(m, summary.coarse_units(coarse, n, fused)).collect()}
    units: dict[tuple[str, str], dict] = {}
    for d in facts["domains"]:
        kind, unit = parent[d["cluster"]]
        u = units.setdefault((kind, unit), {"label": d["name"] if kind == "full" else f"Files in {unit}", "domains": [], "terms": [], "budget": 0})
        u["domains"].append(d)
        u["terms"] = (u["terms"] + d["terms"])[:8]
        u["budget"] = min(summary.BUDGET_MOST, u["budget"] + d["budget"])
    return list(units.values())


def write_map(ix: Index, budget: int = 4000, max_domains: int = cluster.MAX_DOMAINS, seed: int = cluster.SEED, state: Path | None = None, out: Path | None = None, index: bool = True, git: bool = True) -> str:
    """Write the map to ``out`` (split into pages of ``state`` if it does not fit) and ``index.json``; returns the root page."""
    facts = map_facts(ix, max_domains, seed, git)
    text, fits = render.fitted_map(ix.profile.name or ix.repo, facts, budget)
    here = state or ix.root / INDEX_DIR
    out = out or here / "CODEBASE.md"
    if not fits:
        units = coarse_pages(facts, seed)
        folder = Path(os.path.relpath(here / "domains", out.parent)).as_posix()
        text, pages = render.split_map(ix.profile.name or ix.repo, facts, units, assign_slugs([u["label"] for u in units]), budget, folder)
        for slug, page in pages.items():
            render.write_atomic(here / "domains" / f"{slug}.md", page)
    render.write_atomic(out, text)
    if index:
        render.write_atomic(here / "index.json", render.index_json(str(ix.root), facts, render.count_tokens(text)))
    return text
