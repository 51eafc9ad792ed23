"""Upserts, stale deletes, diffs of generations, snapshots over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bytes by the plan's estimate, of columnar files that grow some twentyfold when sorted, that a task may take.
TASK_BYTES = 4 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as its size asks for, so that no task's part grows with it; to those of shuffles at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-size // TASK_BYTES)) if size < 1 << 50 else least, *keys)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both by key, all columns of the last generation; in `new`, the row last in `order` wins, nulls first, ties by the other columns."""
    rest = [c for c in new.columns if c not in keys]
    sortable = [c for c in rest if new.schema[c].dataType.typeName() not in ("map", "variant")]
    latest = dealt(new, *keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), order, *sortable)).alias("r")).select(*keys, "r.*")
    return old.join(latest, keys, "left_anti").unionByName(latest)


def upsert_edges(old: DataFrame, new: DataFrame, order: str, key: str | None = None) -> DataFrame:
    """Edges of both by (src, dst), and by the property `key` where edges are told apart by one; the last properties win."""
    return upsert(old, new, ["src", "dst", *([key] if key else [])], order)


def set_properties(nodes: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """nodes with the columns of more(key, ...) set where it has the key and a value; nodes without keep what they had."""
    names = [c for c in more.columns if c != key]
    joined = nodes.join(more.select(key, *(F.col(c).alias(f"_new_{c}") for c in names)), key, "left")
    for c in names:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c) if c in nodes.columns else F.col(f"_new_{c}"))
    return joined.drop(*(f"_new_{c}" for c in names))


def delete_stale(nodes: DataFrame, edges: DataFrame, changed: DataFrame, rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what changed files held and the rebuild didn't bring back.

    nodes(uid, file), edges(src, dst), changed(file), rebuilt(uid).
    """
    gone = nodes.join(changed, "file", "left_semi").join(rebuilt, "uid", "left_anti").select("uid")
    kept = edges.join(gone, F.col("src") == F.col("uid"), "left_anti").join(gone, F.col("dst") == F.col("uid"), "left_anti")
    return nodes.join(gone, "uid", "left_anti"), kept


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """uid, change: new, removed, or changed where the severity in context left the raw one, of (uid, raw, contextual)."""
    new = after.join(before, "uid", "left_anti").select("uid", F.lit("new").alias("change"))
    removed = before.join(after, "uid", "left_anti").select("uid", F.lit("removed").alias("change"))
    both = after.join(before, "uid", "left_semi").where("contextual <> raw").select("uid", F.lit("changed").alias("change"))
    return new.union(removed).union(both)


def diff_chains(chains: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """change, src, dst, evidence, confidence: chains(src, dst, ...) with an end among new(uid), and a broken one for each removed(uid)."""
    uids = new.select("uid").distinct()
    touched = chains.join(uids, F.col("src") == F.col("uid"), "left_semi").union(chains.join(uids, F.col("dst") == F.col("uid"), "left_semi")).distinct()
    none = F.lit(None)
    broken = removed.select(F.lit("broken").alias("change"), F.col("uid").alias("src"), none.cast("string").alias("dst"), F.lit("node_removed").alias("evidence"), none.cast("double").alias("confidence"))
    return touched.select(F.lit("new").alias("change"), F.col("src").cast("string"), F.col("dst").cast("string"), "evidence", "confidence").union(broken.withColumn("src", F.col("src").cast("string")))


#: Types of nodes that count as findings in a summary.
FINDING_TYPES = ("sast", "dependency", "config", "chain")


def summary(diffs: DataFrame) -> DataFrame:
    """diffs(types of new nodes, n_removed, n_chains, delta, score) with a line of text on each; a positive delta is worse.

    Fixed text: the wording is what readers of summaries expect.
    """
    found = F.size(F.filter("types", lambda t: t.isin(*FINDING_TYPES)))
    points = F.format_string("%.1f", F.abs("delta"))
    way = F.when(F.col("delta") > 0, F.concat(F.lit("DEGRADED by "), points, F.lit(" points"))).when(F.col("delta") < 0, F.concat(F.lit("IMPROVED by "), points, F.lit(" points"))).otherwise("NEUTRAL")
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(text))) for n, text in ((found, " new finding(s)"), (F.col("n_removed"), " node(s) removed"), (F.col("n_chains"), " new vulnerability chain(s)"))]
    more = F.concat_ws(", ", *parts)
    head = F.concat(F.lit("Posture "), way, F.lit(" (score: "), F.format_string("%.1f", "score"), F.lit("/100)."))
    return diffs.withColumn("summary", F.concat(head, F.when(more != "", F.concat(F.lit(" "), more, F.lit("."))).otherwise("")))


def by_commit(findings: DataFrame) -> DataFrame:
    """sha, introduced, resolved: findings(uid, introduced_in, resolved_in) by the commits that brought and ended them, sorted."""
    one = lambda c, name: findings.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("sha")).agg(F.sort_array(F.collect_list("uid")).alias(name))
    return one("introduced_in", "introduced").join(one("resolved_in", "resolved"), "sha", "full")


#: Counts of a snapshot by severity, in a map.
COUNTED = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def snapshot(findings: DataFrame, commits: DataFrame) -> DataFrame:
    """commits(commit_sha, ts, repo, score, chain_count, change) with counts, a map of open findings(severity) for COUNTED; 0 where there are none."""
    own = findings.groupBy().pivot("severity", list(COUNTED)).agg(F.count(F.lit(1)))
    counts = F.create_map(*(x for s in COUNTED for x in (F.lit(s), F.coalesce(F.col(s), F.lit(0)).cast("long"))))
    return commits.crossJoin(own.select(counts.alias("counts")))  # one row of counts


def record(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots by commit: a commit that is analysed again replaces its snapshot."""
    return upsert(old, new, ["commit_sha"], "ts")


def newest(snapshots: DataFrame, n: int) -> DataFrame:
    """Each repository's n newest snapshots, newest first by column r."""
    order = W.partitionBy("repo").orderBy(F.desc("day"), "commit_sha")
    return snapshots.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)


def trend(snapshots: DataFrame, n: int, repos: DataFrame | None = None) -> DataFrame:
    """repo, newest, oldest, delta, direction over the n newest snapshots: two points either way count as stable.

    An oldest score of 0 counts as missing, and the newest stands for it. repos(repo): those without snapshots are unknown.
    """
    t = newest(snapshots, n).groupBy("repo").agg(F.min_by("score", "r").alias("newest"), F.max_by("score", "r").alias("oldest"))
    t = t.withColumn("oldest", F.coalesce(F.nullif("oldest", F.lit(0.0)), "newest"))
    t = repos.select("repo").distinct().join(t, "repo", "left") if repos is not None else t
    delta = F.round(F.col("newest") - F.col("oldest"), 1)
    direction = F.when(delta > 2, "improving").when(delta < -2, "degrading").when(delta.isNotNull(), "stable").otherwise("unknown")
    return t.withColumn("delta", delta).withColumn("direction", direction)
