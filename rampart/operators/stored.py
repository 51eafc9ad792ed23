"""The graph in buckets: a commit rewrites the buckets of its files, and what it changes of reach and chains.

Nodes and edges are kept by the file that owns them: an edge belongs to the file that it starts in. Calls are kept twice
more, by either end, what endpoints reach by the function that is reached, and what they add to chains by endpoint. So a
commit reads and writes the buckets of its files, functions and endpoints. Its tables become visible all at once.

Contextual severity looks at all open findings: it reads the maintained reach and chains, but the walk around stores of
personal data, three calls long, is made anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.buckets import Buckets, Draft
from rampart.functions import columns as C
from rampart.operators import history, maintain, rules, scope, severity
from rampart.operators.expand import reach
from rampart.plans.projection import Graph
from rampart.storage import discard, few, written

#: Relations by owner file: the key of nodes, the end of edges that decides, and the relation that knows its file.
NODES = {"functions": "fn", "endpoints": "ep", "findings": "f"}
EDGES = {"calls": ("src", "functions"), "access": ("fn", "functions"), "uses": ("fn", "functions"), "handled_by": ("ep", "endpoints"), "belongs_to": ("ep", "endpoints"), "in_zone": ("ep", "endpoints"), "affects": ("f", "findings"), "affects_dep": ("f", "findings")}
OTHERS = {"stores": "ds", "dependencies": "dep", "zones": "zone", "services": "service"}
#: Edges that end in a function of any file, and go with it.
INTO_FUNCTIONS = ("handled_by", "affects")
KEYS = dict.fromkeys([*NODES, *EDGES], "owner") | OTHERS | {"imports": "owner", "by_src": "src", "by_dst": "dst", "reach": "node", "support": "ep", "snapshots": "commit_sha"}
SNAPSHOT = "commit_sha string, ts string, repo string, score double, chain_count int, change string, counts map<string,bigint>"
Rebuild = Callable[[DataFrame], "tuple[Graph, DataFrame]"]


class _Stored(maintain.Table):
    """A table of a draft that is read by buckets; tables: which copy is kept by which column."""

    def __init__(self, at: Draft | Buckets, store: Buckets, tables: dict[str, str]):
        self.read_from, self.store, self.tables = at, store, tables

    def at(self, column: str, values: DataFrame) -> DataFrame:
        return self.read_from.read(self.tables[column], self.store.touched(values, column))


def _owned(g: Graph) -> dict[str, DataFrame]:
    """The relations that files own, with the column `owner`; nodes are written, as every edge asks them for its owner."""
    out = {name: written(getattr(g, name).withColumn("owner", F.col("file"))) for name in NODES}
    for name, (end, of) in EDGES.items():
        if (df := getattr(g, name)) is not None:
            out[name] = df.distinct().join(out[of].select(F.col(NODES[of]).alias(end), "owner").distinct(), end)
    return out


def _owned_imports(imports: DataFrame) -> DataFrame:
    return imports.select("path", "module", F.col("path").alias("owner"))


def graph_of(at: Draft | Buckets, version: dict) -> Graph:
    """The graph of a store or a draft; what has been maintained stands in its memo."""
    names = [f.name for f in fields(Graph) if f.name != "memo" and f.name in version]
    g = Graph(**{name: at.read(name).drop("owner") for name in names})
    g.memo["reach", rules.MOST_HOPS] = at.read("reach").select(F.col("start").alias("ep"), F.col("node").alias("fn"), "depth")
    g.memo["support"] = at.read("support")
    return g


def load(store: Buckets) -> Graph:
    """The graph as the newest commit left it."""
    return graph_of(store, store.manifest().schemas)


def open_store(spark: SparkSession, folder: str, buckets: int = 64) -> Buckets:
    return Buckets(spark, folder, KEYS, buckets)


def begin(store: Buckets, g: Graph, imports: DataFrame) -> None:
    """Put a whole graph and imports(path, module) into an empty store, with its reach and chains."""
    draft = store.draft()
    for name, df in _owned(g).items():
        draft.put(name, df)
    for name in OTHERS:
        if getattr(g, name) is not None:
            draft.put(name, getattr(g, name))
    draft.put("imports", _owned_imports(imports))
    calls = draft.read("calls").select("src", "dst").distinct()
    draft.put("by_src", calls)
    draft.put("by_dst", calls)
    draft.put("reach", reach(draft.read("handled_by").select(F.col("ep").alias("start"), F.col("fn").alias("node")), draft.read("by_src"), rules.MOST_HOPS))
    draft.put("support", maintain.chain_support(_plain(draft), draft.read("reach")))
    draft.put("snapshots", store.spark.createDataFrame([], SNAPSHOT))
    draft.publish()


def _plain(draft: Draft) -> Graph:
    names = [f.name for f in fields(Graph) if f.name in draft.manifest.schemas]
    return Graph(**{name: draft.read(name).drop("owner") for name in names})


def _files_of(store: Buckets, draft: Draft, files: DataFrame, rebuilt: Graph) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Put the rebuilt files in place of their old rows; (old, new) rows of the files by relation."""
    both: dict[str, tuple[DataFrame, DataFrame]] = {}
    known = store.manifest().schemas
    for name, rows in _owned(rebuilt).items():
        new = rows if name in NODES else written(rows)
        if name not in known:
            draft.put(name, new)
            continue
        buckets = store.touched(files.select(F.col("file").alias("owner")).union(new.select("owner")), "owner")
        here = store.read(name, buckets)
        old = written(here.join(few(files.select(F.col("file").alias("owner"))), "owner", "left_semi"))
        kept = here.join(few(files.select(F.col("file").alias("owner"))), "owner", "left_anti")
        if name in NODES:
            kept = kept.join(few(new.select(NODES[name])), NODES[name], "left_anti")
        draft.put(name, kept.unionByName(new, allowMissingColumns=True).select(*here.columns), buckets)
        both[name] = old, new
    for name, key in OTHERS.items():
        if (rows := getattr(rebuilt, name)) is not None:
            buckets = store.touched(rows, key)
            here = store.read(name, buckets) if name in known else rows.limit(0)
            draft.put(name, here.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True), buckets)
    return both


def _without_ends(store: Buckets, draft: Draft, gone: DataFrame) -> list[DataFrame]:
    """Take edges of other files out that end in functions(fn) which are gone; the rows that went, for each relation."""
    out = []
    for name in INTO_FUNCTIONS:
        lost = written(draft.read(name).join(few(gone), "fn", "left_semi"))
        buckets = store.touched(lost, "owner")
        if buckets:
            draft.put(name, written(draft.read(name, buckets).join(few(gone), "fn", "left_anti")), buckets)
        out.append(lost)
    return out


def commit(store: Buckets, sha: str, ts: str, repo: str, changed: DataFrame, rebuild: Rebuild, tag: int | None = None) -> DataFrame | None:
    """Analyse a commit that changed(path) files: the diff, one row as `history.summary` gives it, or None if it affects no
    file or has been analysed under this tag.

    rebuild(paths) gives the graph and the imports of the affected files, importers of changed modules among them, as they
    are after the commit. Imports that it brings count from the next commit on.
    """
    spark = store.spark
    draft = store.draft(tag)
    if draft is None:
        return None
    paths = written(scope.affected(changed, scope.importers(store.read("imports").select("path", "module"), changed)).select("path"))
    if paths.isEmpty():
        return None
    files = paths.select(F.col("path").alias("file")).distinct()
    before = load(store)
    score_before = severity.scores(severity.rated(before)).select("score_exp").first()[0]
    rebuilt, imports = rebuild(paths)
    both = _files_of(store, draft, files, rebuilt)
    own = written(_owned_imports(imports))
    owners = files.select(F.col("file").alias("owner")).union(own.select("owner")).distinct()
    buckets = store.touched(owners, "owner")
    draft.put("imports", store.read("imports", buckets).join(few(owners), "owner", "left_anti").unionByName(own), buckets)

    gone = written(both["functions"][0].select("fn").join(both["functions"][1].select("fn"), "fn", "left_anti").distinct())
    lost_handled, lost_affects = _without_ends(store, draft, gone)
    pairs = lambda name, a, b: tuple(x.select(F.col(a[0]).alias(b[0]), F.col(a[1]).alias(b[1])).distinct() for x in both[name])
    added, removed = maintain.difference(*pairs("calls", ("src", "dst"), ("src", "dst")))
    for name, end in (("by_src", "src"), ("by_dst", "dst")):
        own = store.touched(added.select(end).union(removed.select(end)), end)
        draft.put(name, store.read(name, own).join(few(removed), ["src", "dst"], "left_anti").union(added).distinct(), own)
    old_starts, new_starts = pairs("handled_by", ("ep", "fn"), ("start", "node"))
    begun, ended = maintain.difference(old_starts.union(lost_handled.select(F.col("ep").alias("start"), F.col("fn").alias("node"))), new_starts)
    begun = begun.join(few(gone.select(F.col("fn").alias("node"))), "node", "left_anti").select("start", "node")
    reached = _Stored(store, store, {"node": "reach"})
    change = maintain.maintain(reached, _Stored(draft, store, {"src": "by_src", "dst": "by_dst"}), added, removed, begun, ended, rules.MOST_HOPS)
    own = store.touched(change.gone.select("node").union(change.now.select("node")), "node")
    draft.put("reach", change.of(store.read("reach", own)), own)

    touched = gone.select("fn")
    for name in ("functions", "access", "affects"):
        old, new = both[name]
        columns = [c for c in old.columns if c in new.columns]
        a, b = maintain.difference(old.select(*columns), new.select(*columns))
        touched = touched.union(a.select("fn")).union(b.select("fn"))
    a, b = maintain.difference(*(x.select("f", "cwe_id", "rule_id", "title", "description") for x in both["findings"]))
    moved_findings = few(written(a.select("f").union(b.select("f")).distinct()))
    touched = touched.union(draft.read("affects").join(moved_findings, "f", "left_semi").select("fn")).union(lost_affects.select("fn"))
    touched = written(touched.union(added.select("src")).union(added.select("dst")).union(removed.select("src")).union(removed.select("dst")).toDF("fn").distinct())
    at = touched.select(F.col("fn").alias("node"))
    ends = maintain.ends_of(reached.at("node", at), touched).union(maintain.ends_of(draft.read("reach", store.touched(at, "node")), touched))
    ends = ends.union(change.gone.select("start")).union(change.now.select("start"))
    ends = written(ends.union(both["endpoints"][0].select("ep")).union(both["endpoints"][1].select("ep")).toDF("start").distinct())
    own = store.touched(ends.select(F.col("start").alias("ep")), "ep")
    support, moved = maintain.maintain_chains(store.read("support", own), _plain(draft), draft.read("reach"), ends)
    draft.put("support", support, own)

    after = graph_of(draft, draft.manifest.schemas)
    key = ["rule", "f", "ds"]
    moved = few(written(moved))
    had, has = (x.join(moved, key, "left_semi").select(*key).distinct() for x in (store.read("support"), draft.read("support")))
    chains, broken = has.join(had, key, "left_anti").count(), had.join(has, key, "left_anti").count()
    uids = [_uids(x) for x in zip(*(both[name] for name in NODES), strict=True)]
    new, removed_uids = uids[1].join(uids[0], "uid", "left_anti"), uids[0].join(uids[1], "uid", "left_anti")
    score = severity.scores(severity.rated(after)).select("score_exp").first()[0]
    delta = round(score_before - score, 1)
    counts = new.agg(F.collect_list("type").alias("types")).crossJoin(removed_uids.agg(F.count("*").alias("n_removed")))  # one row each
    diff = history.summary(counts.withColumns({"n_chains": F.lit(chains), "n_broken": F.lit(broken), "delta": F.lit(float(delta)), "score": F.lit(float(score)), "commit_sha": F.lit(sha)}))
    total = maintain.chains_of(draft.read("support")).count()
    rows = spark.createDataFrame([(sha, ts, repo, float(score), total, delta)], "commit_sha string, ts string, repo string, score double, chain_count int, delta double")
    rows = rows.withColumn("change", C.change_label(F.col("delta"))).drop("delta")
    snapshot = history.snapshot(severity.rated(after).select(F.col("contextual_severity").alias("severity")), rows)
    own = store.touched(snapshot, "commit_sha")
    draft.put("snapshots", history.record(store.read("snapshots", own), snapshot), own)
    out = written(diff)
    draft.publish()
    discard(paths, gone, lost_handled, lost_affects, touched, ends, change.gone, change.now, *(x for pair in both.values() for x in pair))
    return out


def _uids(relations: tuple[DataFrame, ...]) -> DataFrame:
    """uid, type of the nodes of functions, endpoints and findings; only findings have a type."""
    none = F.lit(None).cast("string")
    out = None
    for df, key, kind in zip(relations, NODES.values(), (none, none, F.col("type")), strict=True):
        own = df.select(F.col(key).cast("string").alias("uid"), kind.alias("type"))
        out = own if out is None else out.union(own)
    return out
