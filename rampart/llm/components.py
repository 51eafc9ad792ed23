"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import discard, written


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no edge's smaller end: then the smaller ends are the labels."""
    ends = edges.selectExpr("u as node", "1 as large", "0 as small").union(edges.selectExpr("v", "0", "1"))
    return ends.groupBy("node").agg(F.sum("large").alias("large"), F.max("small").alias("small")).where("large > 1 or large = 1 and small = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of links(a, b): label is the smallest node that can be reached.

    Null ends, loops and repeated links are ignored. Each round links every node's neighbours to the smallest of
    them, first the larger ones, then the smaller ones, until only stars remain. A round is written before the next
    reads it.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges)
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("e"))
        before, edges = edges, written(small.select("e.u", "e.v").where("u != v").distinct())
        discard(before)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(edges.select("v", "v").distinct())
