"""What a commit changes: the graph without its changed files' old parts, a diff of both, and the snapshot that is kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators import build, history, rules, scope, severity
from rampart.plans.projection import Graph
from rampart.storage import written

#: Relations whose rows belong to a file, with their keys.
_OWNED = (("functions", "fn"), ("endpoints", "ep"), ("findings", "f"))
#: Edges and the ends that must be there: (relation, column, relation of the end, its key).
_EDGES = (
    ("calls", "src", "functions", "fn"), ("handled_by", "ep", "endpoints", "ep"), ("handled_by", "fn", "functions", "fn"), ("access", "fn", "functions", "fn"), ("affects", "f", "findings", "f"),
    ("affects", "fn", "functions", "fn"), ("uses", "fn", "functions", "fn"), ("affects_dep", "f", "findings", "f"), ("belongs_to", "ep", "endpoints", "ep"), ("in_zone", "ep", "endpoints", "ep"),
)


def _files(paths: DataFrame) -> DataFrame:
    return paths.select(F.col("path").alias("file")).distinct()


def owned(g: Graph, changed: DataFrame) -> DataFrame:
    """uid, label, raw, contextual: the nodes of changed(path) files; severities are null for nodes that aren't findings."""
    files, none = _files(changed), F.lit(None).cast("string")
    out = None
    for name, key in _OWNED:
        own = getattr(g, name).join(files, "file", "left_semi")
        raw = F.col("raw_severity") if name == "findings" else none
        own = own.select(F.col(key).cast("string").alias("uid"), F.lit(name).alias("label"), (F.col("type") if name == "findings" else none).alias("type"), raw.alias("raw"))
        out = own if out is None else out.union(own)
    return out


def update(g: Graph, changed: DataFrame, rebuilt: Graph) -> Graph:
    """The graph after changed(path) files were built anew: copy on write, relation by relation.

    Nodes of changed files go unless they were rebuilt; edges go with an end that is gone, and edges that start in a changed
    file are taken from the rebuild alone. Stores, dependencies, zones and services of both stay.
    """
    files = _files(changed)
    made: dict[str, DataFrame] = {}
    for name, key in _OWNED:
        new = getattr(rebuilt, name)
        old = getattr(g, name).join(files, "file", "left_anti").join(new.select(key), key, "left_anti")
        made[name] = written(old.unionByName(new, allowMissingColumns=True))
    gone = g.functions.join(files, "file", "left_semi").select("fn")
    starts = {"calls": "src", "access": "fn", "uses": "fn"}
    for name in ("calls", "handled_by", "access", "affects", "uses", "affects_dep", "belongs_to", "in_zone"):
        old, new = getattr(g, name), getattr(rebuilt, name)
        if old is None or new is None:
            made[name] = old if new is None else new
            continue
        if name in starts:
            old = old.join(gone, old[starts[name]] == gone["fn"], "left_anti")
        both = old.unionByName(new).distinct()
        for relation, column, of, key in _EDGES:
            if relation == name and not (name == "calls" and column == "dst"):
                both = both.join(made[of].select(F.col(key).alias(column)).distinct(), column, "left_semi")
        made[name] = written(both.select(*old.columns))
    for name, keys in (("stores", ["ds"]), ("dependencies", ["dep"]), ("zones", ["zone"]), ("services", ["service"])):
        old, new = getattr(g, name), getattr(rebuilt, name)
        made[name] = new if old is None else old if new is None else written(old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))
    return replace(g, **made, memo={})


def analyse(g: Graph, commit: dict, changed: DataFrame, imports: DataFrame, rebuild: Callable[[DataFrame], Graph], snapshots: DataFrame | None = None) -> tuple[Graph, DataFrame, DataFrame] | None:
    """(graph, diff, snapshots) after a commit{sha, ts, repo} that changed(path) files; None if it affects no file.

    Importers of changed modules, of imports(path, module), are built anew too; rebuild(paths) gives the graph of the
    affected files as they are after the commit, built with the functions of g as `known`. The diff has one row: delta (positive is worse), counts and a line of
    text. Snapshots are kept by commit, so that analysing a commit twice leaves one.
    """
    paths = written(scope.affected(changed, scope.importers(imports, changed)).select("path"))
    if paths.isEmpty():
        return None
    before = severity.scores(severity.rated(g)).select("score_exp").first()[0]
    old_uids = written(owned(g, paths))
    after = update(g, paths, rebuild(paths))
    new_uids = written(owned(after, paths))
    new = new_uids.join(old_uids, "uid", "left_anti")
    removed = old_uids.join(new_uids, "uid", "left_anti")
    edges = rules.chain_edges(after).select(F.col("f").cast("string").alias("src"), F.col("target").cast("string").alias("dst"), "evidence", "confidence")
    chains = history.diff_chains(edges, new, removed).where("change = 'new'").count()
    score = severity.scores(severity.rated(after)).select("score_exp").first()[0]
    counts = new.agg(F.collect_list("type").alias("types")).crossJoin(removed.agg(F.count("*").alias("n_removed")))  # one row each
    delta = round(before - score, 1)
    diff = history.summary(counts.withColumns({"n_chains": F.lit(chains), "delta": F.lit(float(delta)), "score": F.lit(float(score)), "commit_sha": F.lit(commit["sha"])}))
    rows = g.findings.sparkSession.createDataFrame([(commit["sha"], commit["ts"], commit.get("repo", ""), float(score), chains, delta)], "commit_sha string, ts string, repo string, score double, chain_count int, delta double")
    rows = rows.withColumn("change", C.change_label(F.col("delta"))).drop("delta")
    own = history.snapshot(severity.rated(after).select(F.col("contextual_severity").alias("severity")), rows)
    return after, diff, own if snapshots is None else history.record(snapshots, own)


def self_summary(g: Graph) -> DataFrame:
    """measure, n: how many nodes of each label, public endpoints, chains and open findings by severity a graph has."""
    labels = build.nodes(g).groupBy(F.col("label").alias("measure")).agg(F.count("*").alias("n"))
    public = g.endpoints.where("is_public").agg(F.lit("public endpoints").alias("measure"), F.count("*").alias("n")).select("measure", "n")
    chains = rules.chain_counts(g).select(F.concat(F.lit("chains: "), "rule").alias("measure"), "n")
    severities = severity.severity_distribution(severity.rated(g)).select(F.concat(F.lit("open: "), "severity").alias("measure"), "n")
    return labels.union(public).union(chains).union(severities)
