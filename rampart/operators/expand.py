"""Bounded traversal of edge tables: reachability by hops, and trails that keep their path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.storage import discard, few, written


def reach(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """start, node, depth: what each of starts(start, node) reaches over edges(src, dst), at its least depth.

    Only the frontier, the pairs met first in the hop before, is joined with the edges; pairs met already are left out. The edges
    and every hop are written, so neither is computed twice, and the walk ends early where nothing new is met. Runs at once.
    """
    steps = written(edges.select("src", "dst").where("src <> dst").distinct())
    now = written(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)))
    seen = now
    for hop in range(1, hops + 1):
        met = now.join(steps, now["node"] == steps["src"]).select("start", F.col("dst").alias("node")).distinct()
        now = written(met.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(hop)))
        if now.isEmpty():
            break
        seen = seen.union(now)
    discard(steps)
    return seen


def paths(edges: DataFrame, hops: int) -> DataFrame:
    """start, node, nodes, evidence, first, length: every trail of one edge to `hops` edges over edges(src, dst, evidence).

    nodes lists all nodes from the first on, evidence the evidence of each edge, first the first edge's. Which edges a trail has
    used is read from its nodes, and a caller that leaves evidence or first out doesn't carry it.
    """
    step = edges.select("src", "dst", "evidence").distinct()
    now = step.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("nodes"), F.array("evidence").alias("evidence"), F.col("evidence").alias("first"), F.lit(1).alias("length"))
    out = now
    more = step.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("evidence").alias("why"))
    for length in range(1, hops):
        used = F.lit(False)
        for i in range(length):
            used = used | ((F.col("nodes")[i] == F.col("node")) & F.col("nodes")[i + 1].eqNullSafe(F.col("to")))
        now = now.join(more, "node").where(~used).select(
            "start", F.col("to").alias("node"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("evidence", F.array("why")).alias("evidence"), "first", F.lit(length + 1).alias("length")
        )
        out = out.union(now)
    return out


def trails(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """start, node, path: every trail of at most `hops` edges; no edge twice, nodes may be met again.

    path lists the nodes from the first on. Bind the starts before: trails are many.
    """
    now = starts.select("start", "node", F.array("node").alias("path"), F.array().cast("array<string>").alias("used"))
    out = now
    steps = edges.select("src", "dst").distinct().withColumn("edge", F.concat_ws(">", "src", "dst"))
    for _ in range(hops):
        now = (
            now.join(steps, now["node"] == steps["src"])
            .where(~F.array_contains("used", F.col("edge")))
            .select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array("edge")).alias("used"))
        )
        out = out.union(now)
    return out.select("start", "node", "path")


def nearest_trails(starts: DataFrame, edges: DataFrame, goals: DataFrame, hops: int, k: int) -> DataFrame:
    """start, node, path: each start's trails to goals(node) as `trails` makes them, up to the length of its k-th shortest.

    All of that length are there, so a caller can rank ties by what it likes; a start with fewer than k trails has them all. The
    distance to the goals is walked first, backwards. A trail goes on only while its length and the distance left are within
    `hops` and within the length by which its start is sure of k trails: those that have arrived, and those sure to. A trail is
    sure to arrive if the way ahead can't meet an edge that it has used. On that way each edge leads one step nearer, from no
    farther than where the trail stands, so it is enough that every edge of the trail that led one step nearer did so from farther
    away: `nearest` holds the least distance of their first nodes. Every length is written, so none is computed twice. Runs at once.
    """
    ahead = written(reach(goals.select(F.lit(0).alias("start"), "node"), reverse(edges), hops).select("node", F.col("depth").alias("ahead")))
    steps = written(edges.select("src", "dst").distinct().join(few(ahead.withColumnRenamed("node", "dst")), "dst"))
    kind = steps.schema["src"].dataType.simpleString()
    used = f"array<struct<src:{kind},dst:{kind}>>"
    now = starts.select("start", "node").distinct().join(few(ahead), "node")
    now = now.select("start", "node", F.array("node").alias("path"), F.array().cast(used).alias("used"), "ahead", F.lit(hops + 1).alias("nearest"))
    found, sure = None, None
    for length in range(hops + 1):
        now = written(now)
        arrived = now.where("ahead = 0").select("start", "node", "path")
        found = arrived if found is None else found.union(arrived)
        if length == hops or now.isEmpty():
            break
        # trails by start and the length at which they arrive; those that arrived before keep their numbers
        counts = now.where("ahead = 0 or nearest > ahead").groupBy("start", (F.lit(length) + F.col("ahead")).alias("length")).agg(F.count("*").alias("n"))
        past = None if sure is None else sure.where(F.col("length") < length)
        before, sure = sure, written(counts if past is None else counts.union(past))
        discard(before)
        so_far = F.sum("n").over(W.partitionBy("start").orderBy("length"))  # a start has hops + 1 rows at most
        bound = sure.withColumn("so_far", so_far).where(F.col("so_far") >= k).groupBy("start").agg(F.min("length").alias("bound"))
        open_ = now.join(few(bound), "start", "left").withColumn("bound", F.coalesce("bound", F.lit(hops))).where(F.col("bound") > length)
        edge = F.struct(F.col("node").alias("src"), F.col("dst").alias("dst"))
        now = (
            open_.withColumnRenamed("ahead", "behind")
            .join(steps, F.col("node") == F.col("src"))
            .where((F.col("ahead") + length + 1 <= F.col("bound")) & ~F.array_contains("used", edge))
            .select(
                "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array(edge)).alias("used"), "ahead",
                F.when(F.col("ahead") == F.col("behind") - 1, F.least("nearest", "behind")).otherwise(F.col("nearest")).alias("nearest"),
            )
        )
    discard(ahead, steps, sure)
    return found


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node: the nodes and all that one edge of either direction joins them with."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return nodes.select("node").union(nodes.join(both, nodes["node"] == both["src"]).select("dst")).distinct()
