"""Context of findings, severity in context, and posture scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators import history
from rampart.operators.expand import reach, reverse
from rampart.operators.rules import all_chains, chained_findings, endpoint_reach, once, reachable_findings
from rampart.plans.projection import Graph
from rampart.storage import written


def finding_context(g: Graph) -> DataFrame:
    """f, raw_severity, is_public, auth_level, pii, in_chain of every open finding, all in one plan.

    auth_level is the least over the endpoints that reach the function: 2 for zones 2 and 3, else the zone; 0 if none.
    """
    levels = g.endpoints.select("ep", "is_public", F.least("zone_level", F.lit(2)).alias("level"))
    by_fn = endpoint_reach(g, 5).join(levels, "ep").groupBy("fn").agg(F.max("is_public").alias("is_public"), F.min("level").alias("auth_level"))
    touching = once(g, "personal_access").select(F.lit(0).alias("start"), F.col("fn").alias("node")).distinct()
    if "near" not in g.memo:
        g.memo["near"] = reach(touching, once(g, "calls"), 3).union(reach(touching, reverse(once(g, "calls")), 3)).select(F.col("node").alias("fn")).distinct()
    near = g.memo["near"]
    chained = chained_findings(g)
    open_ = g.findings.where("status = 'open'").join(once(g, "affects"), "f", "left")
    yes = F.lit(True)
    return (
        open_.join(by_fn, "fn", "left")
        .join(near.withColumn("pii", yes), "fn", "left")
        .join(chained.withColumn("in_chain", yes), "f", "left")
        .select(
            "f",
            "raw_severity",
            F.coalesce("is_public", F.lit(False)).alias("is_public"),
            F.coalesce("auth_level", F.lit(0)).cast("int").alias("auth_level"),
            F.coalesce("pii", F.lit(False)).alias("pii"),
            F.coalesce("in_chain", F.lit(False)).alias("in_chain"),
        )
    )


def contextual_severity(g: Graph) -> DataFrame:
    """finding_context with the severity that its rules give; the scale holds after each step."""
    c = finding_context(g)
    exposed = F.col("is_public") & (F.col("auth_level") == 0)
    step = F.when(exposed & F.col("pii"), 2).when(exposed, 1).when((F.col("auth_level") >= 2) & ~F.col("is_public"), -1).otherwise(0)
    index = C.moved(C.severity_index(F.col("raw_severity")), step)
    index = C.moved(index, F.col("in_chain").cast("int"))
    return c.withColumn("contextual_severity", C.severity_name(index))


def rated(g: Graph) -> DataFrame:
    """The open findings with their severity in context: what scores, counts and ranks go by. Written once for a graph."""
    if "rated" not in g.memo:
        own = contextual_severity(g).select("f", "contextual_severity")
        g.memo["rated"] = written(g.findings.where("status = 'open'").join(own, "f"))
    return g.memo["rated"]


def severity_distribution(findings: DataFrame, column: str = "contextual_severity") -> DataFrame:
    return findings.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("severity")).agg(F.count("*").alias("n"))


def scores(findings: DataFrame, column: str = "contextual_severity") -> DataFrame:
    """n_open, total weight, both scores and the reading of the first, over open findings: one row."""
    w = findings.where("status = 'open'").agg(F.count("*").alias("n_open"), F.coalesce(F.sum(C.weight(F.col(column))), F.lit(0)).cast("long").alias("total"))
    w = w.withColumn("score_exp", C.score_exp(F.col("total").cast("double"), F.col("n_open")))
    return w.withColumn("score_linear", C.score_linear(F.col("total"))).withColumn("reading", C.interpretation(F.col("score_exp")))


def top_risks(g: Graph, n: int = 10) -> DataFrame:
    """The n worst open findings by severity in context, with the sorted paths of the endpoints that their functions handle.

    Of one severity, findings that no rule has met from a public endpoint come first, as their mark is null; then by f.
    """
    rank = F.when(F.col("contextual_severity").isin(*C.WEIGHTS), C.severity_index(F.col("contextual_severity"))).otherwise(0)
    marked = rated(g).join(reachable_findings(g).withColumn("reachable", F.lit(True)), "f", "left")
    ranked = marked.orderBy(rank.desc(), F.desc_nulls_first("reachable"), "f").limit(n)
    paths = once(g, "affects").join(once(g, "handled_by"), "fn").join(g.endpoints, "ep").join(F.broadcast(ranked.select("f")), "f").groupBy("f")  # n rows
    paths = paths.agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("endpoints"))
    return ranked.join(paths, "f", "left").select("f", "contextual_severity", "cwe_id", "reachable", F.coalesce("endpoints", F.lit("")).alias("endpoints"))


def dashboard(g: Graph, snapshots: DataFrame, window: int = 10, risks: int = 5) -> DataFrame:
    """One row: score and its reading, open findings by severity, the trend of the newest snapshots of all repositories, the
    worst findings, chains and endpoints. Without snapshots the direction is unknown and the score stands for the newest one.
    """
    own = scores(rated(g)).select(F.col("score_exp").alias("score"), "reading", "n_open")
    counts = rated(g).agg(*(F.count_if(F.col("contextual_severity") == s).alias(s.lower()) for s in history.COUNTED))
    last = snapshots.orderBy(F.desc("day"), "commit_sha").limit(window).withColumn("repo", F.lit("all"))
    all_ = g.findings.sparkSession.createDataFrame([("all",)], "repo string")
    trend = history.trend(last, window, all_).select("direction", F.coalesce("delta", F.lit(0.0)).alias("delta"), F.col("newest").alias("current_score"), F.col("oldest").alias("previous_score"))
    worst = top_risks(g, risks).agg(F.array_join(F.sort_array(F.collect_list(F.col("f").cast("string"))), ",").alias("top_risks"))
    chains = all_chains(g).agg(F.count("*").alias("chain_count"))
    ends = g.endpoints.agg(F.count_if("is_public").alias("public_endpoints"), F.count("*").alias("endpoints"))
    row = own
    for other in (counts, trend, worst, chains, ends):
        row = row.crossJoin(other)  # one row each
    return row.withColumn("current_score", F.coalesce("current_score", "score"))
