"""Views kept up to date: what endpoints reach, and the chains that follow, under edges that come and go.

Distances up to a number of hops are kept by deleting and deriving again. Level by level, a pair (start, node) falls if it
has lost an edge on a shortest path, or a predecessor that fell, and nothing else one level up still leads to it. Then new
starts, new edges and the fallen pairs' other neighbours seed a walk, level by level again, that only follows pairs which
have become nearer. Both walks join the few pairs concerned with the tables; unconcerned pairs aren't touched. A level is
written before the next one reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.operators import rules
from rampart.operators.expand import reach
from rampart.plans.projection import Graph
from rampart.storage import discard, few, written


class Table:
    """Rows that are asked for by the values of a column; this one holds them as one DataFrame."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def at(self, column: str, values: DataFrame) -> DataFrame:
        """At least the rows whose column has one of values(column)."""
        return self.rows


@dataclass
class Change:
    """What became of a reach table: pairs that are gone, and pairs that are new or have another depth."""

    gone: DataFrame  # start, node
    now: DataFrame  # start, node, depth

    def of(self, reached: DataFrame) -> DataFrame:
        """The reach table after the change."""
        pairs = few(self.gone.union(self.now.select("start", "node")))
        return reached.join(pairs, ["start", "node"], "left_anti").unionByName(self.now)


def difference(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) rows of two tables with the same columns."""
    a, b = before.distinct(), after.select(*before.columns).distinct()
    return written(b.exceptAll(a)), written(a.exceptAll(b))


def _fallen(reached: Table, edges: Table, removed: DataFrame, ended: DataFrame, hops: int) -> list[DataFrame]:
    """Pairs (start, node, depth), a table for each level, whose depth no path has any more."""
    pair = ["start", "node"]
    ended, lost = ended.select(*pair).distinct(), removed.select("src", F.col("dst").alias("to")).distinct()
    levels = [written(reached.at("node", ended).where("depth = 0").join(few(ended), pair, "left_semi"))]
    suspects = written(reached.at("node", lost.select(F.col("src").alias("node"))).join(few(lost), F.col("node") == F.col("src")).select("start", F.col("to").alias("node"), (F.col("depth") + 1).alias("depth")))
    last = suspects.agg(F.max("depth")).first()[0] or 0  # of the levels that have lost edges of their own
    for depth in range(1, hops + 1):
        before = levels[-1]
        if before.isEmpty() and depth > last:
            break
        over = before.select("start", F.col("node").alias("src"))
        after = few(over).join(edges.at("src", over), "src").select("start", F.col("dst").alias("node"))
        asked = written(suspects.where(F.col("depth") == depth).select(*pair).union(after).distinct())
        asked = written(reached.at("node", asked).where(F.col("depth") == depth).join(few(asked), pair, "left_semi").select(*pair))
        into = edges.at("dst", asked.select(F.col("node").alias("dst")))
        around = written(into.join(few(asked), into["dst"] == asked["node"]).select("start", "node", F.col("src").alias("over")))
        up = reached.at("node", around.select(F.col("over").alias("node"))).where(F.col("depth") == depth - 1)
        up = up.join(few(before.select(*pair)), pair, "left_anti").select("start", F.col("node").alias("over"))
        held = up.join(few(around), ["start", "over"]).select(*pair).distinct()
        levels.append(written(asked.join(held, pair, "left_anti").withColumn("depth", F.lit(depth))))
        discard(around)
    discard(suspects)
    return levels


def maintain(reached: Table | DataFrame, edges: Table | DataFrame, added: DataFrame, removed: DataFrame, begun: DataFrame, ended: DataFrame, hops: int) -> Change:
    """What becomes of reached(start, node, depth), as `expand.reach` gave it, when edges and starts have changed.

    edges(src, dst): all edges as they are now; added, removed: the edges that came and went; begun, ended(start, node): the
    starts that did. Loops are left out, as in `reach`. reached is asked by node, edges by src and dst, so tables that are
    kept in buckets read those of the change alone.
    """
    reached, edges = (x if isinstance(x, Table) else Table(x) for x in (reached, edges))
    pair = ["start", "node"]
    added, removed = (x.select("src", "dst").where("src <> dst").distinct() for x in (added, removed))
    fallen = _fallen(reached, edges, removed, ended, hops)
    fell = fallen[0]
    for level in fallen[1:]:
        fell = fell.union(level)
    fell = written(fell.select(*pair))
    gone_pairs = few(fell)
    left = lambda values: reached.at("node", values).join(gone_pairs, pair, "left_anti")
    into = edges.at("dst", fell.select(F.col("node").alias("dst")))
    around = written(into.where("src <> dst").join(few(fell), into["dst"] == fell["node"]).select("start", "node", F.col("src").alias("over")))
    again = left(around.select(F.col("over").alias("node"))).withColumnRenamed("node", "over").join(few(around), ["start", "over"]).select("start", "node", F.col("depth") + 1)
    new = left(added.select(F.col("src").alias("node"))).join(few(added), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.col("depth") + 1)
    seeds = written(begun.select(*pair).withColumn("depth", F.lit(0)).union(again).union(new).toDF("start", "node", "depth").where(F.col("depth") <= hops).distinct())
    last = seeds.agg(F.max("depth")).first()[0]
    found: list[DataFrame] = []
    for depth in range(hops + 1 if last is not None else 0):
        if depth > last and found[-1].isEmpty():
            break
        asked = seeds.where(F.col("depth") == depth).select(*pair)
        if found:
            over = found[-1].select("start", F.col("node").alias("src"))
            asked = asked.union(few(over).join(edges.at("src", over).where("src <> dst"), "src").select("start", F.col("dst").alias("node")))
        asked = written(asked.distinct())
        known = left(asked).where(F.col("depth") <= depth).join(few(asked), pair, "left_semi").select(*pair)
        for level in found:
            known = known.union(level.select(*pair))
        found.append(written(asked.join(known, pair, "left_anti").withColumn("depth", F.lit(depth))))
    now = fell.withColumn("depth", F.lit(0)).limit(0)
    for level in found:
        now = now.union(level)
    now = written(now)
    same = written(reached.at("node", now).join(few(now), [*pair, "depth"], "left_semi").select(*pair))  # fell, and came back by way of new pairs
    gone = written(fell.join(now, pair, "left_anti"))
    out = Change(gone, written(now.join(few(same), pair, "left_anti")))
    discard(seeds, around, same, fell, now, *fallen, *found)
    return out


def ends_of(reached: DataFrame, functions: DataFrame) -> DataFrame:
    """start: what reaches one of functions(fn)."""
    return reached.join(few(functions.select(F.col("fn").alias("node")).distinct()), "node", "left_semi").select("start").distinct()


def chain_support(g: Graph, reached: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """rule, ep, f, ds, path, taint: what each public endpoint adds to the chains, for all endpoints or those of ends(start).

    reached(start, node, depth) is the maintained table; a chain is a group of these rows by rule, finding and store.
    """
    own = reached if ends is None else reached.join(few(ends), "start", "left_semi")
    handled = g.handled_by if ends is None else g.handled_by.join(few(ends.select(F.col("start").alias("ep"))), "ep", "left_semi")
    taint = reach(handled.select(F.col("ep").alias("start"), F.col("fn").alias("node")), rules.taint_edges(g), 3)
    tainted = taint.join(g.functions.where("tainted"), F.col("node") == F.col("fn"), "left_semi").select(F.col("start").alias("ep")).distinct()
    there = own.select(F.col("start").alias("ep"), F.col("node").alias("fn"), "depth")
    return rules.support(g, there, handled, tainted)


def chains_of(support: DataFrame) -> DataFrame:
    """The chains of support rows, as `rules.all_chains` has them."""
    return rules.chains_of(support)


def maintain_chains(support: DataFrame, g: Graph, reached: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(support, chains that may have changed: rule, f, ds) after the graph changed to g and reached to what it is now.

    ends(start): endpoints whose functions, reach, findings or stores changed; only theirs is computed anew.
    """
    here = few(ends.select(F.col("start").alias("ep")))
    old = support.join(here, "ep", "left_semi")
    new = written(chain_support(g, reached, ends))
    moved = old.select("rule", "f", "ds").union(new.select("rule", "f", "ds")).distinct()
    return support.join(here, "ep", "left_anti").unionByName(new), moved
