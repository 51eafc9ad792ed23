"""Approximate nearest neighbours by inner product: stable projections, a kd-tree over them, a chi-square stop.

A vector gets one more component, so that the largest inner product is the least distance: sqrt(M - |x|^2), M the largest
squared length. Gaussian projections to DIMS dimensions are 2-stable: a projected squared distance over the true one
follows a chi-square law with DIMS degrees of freedom.

1. Equal vectors are one class, searched once; of a class its k + 1 smallest ids can be answers.
2. The upper levels of the kd-tree are fitted on the projections of a bounded sample (SAMPLE rows); every class is placed
   in a block, a leaf of these levels, and every block knows the box that its projections fill.
3. Every block has its own kd-tree below. A query first searches the FIRST blocks nearest to its projection; the k-th best
   found there bounds the blocks, and the leaves within them, that may still hold a neighbour: those whose projected
   distance lies below the chi-square point of SURE times the bound. It then searches just these.
4. In a block, leaves are visited by their projected distance, and the vectors in them verified; a query stops when a
   vector nearer than its k-th would, with probability SURE, have been met by now.

A task holds one block (BLOCK rows on average) and QUERIES queries on average; a block asked by more is dealt to more
tasks. The driver sees the sample, and a box for each block.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.common import discard, written

DIMS, LEAF, SURE, BLOCK, QUERIES, STEP = 10, 64, 0.95, 16_384, 2048, 16
SAMPLE, FIRST = 65_536, 2


def chi_square_point(dims: int, sure: float) -> float:
    """Where the chi-square law with an even number of degrees of freedom reaches a probability."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        x = (low + high) / 2
        term, tail = exp(-x / 2), 0.0
        for i in range(dims // 2):
            tail += term
            term *= x / 2 / (i + 1)
        low, high = (x, high) if 1 - tail < sure else (low, x)
    return high


def kd_leaves(points: np.ndarray, most: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which leaves stand together, and the leaves' bounds in it."""
    order, bounds, stack = np.arange(len(points)), [0], [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= most:
            bounds.append(b)
            continue
        own = points[order[a:b]]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
        stack += [(a + half, b), (a, a + half)]
    return order, np.array(bounds)


def _gaps(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each point (rows) to each box (columns)."""
    away = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - points[:, None, j], points[:, None, j] - high[None, :, j]), 0.0)
        away += gap * gap
    return away


def stable_matrix(d: int, dims: int) -> np.ndarray:
    return np.random.default_rng(64).standard_normal((d + 1, dims))


def projected(rows: np.ndarray, largest: float, dims: int) -> np.ndarray:
    """Projections of rows with their further component."""
    up = np.sqrt(np.maximum(0.0, largest - (rows * rows).sum(axis=1)))
    return np.hstack([rows, up[:, None]]) @ stable_matrix(rows.shape[1], dims)


def search(
    rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, largest: float, dims: int = DIMS, sure: float = SURE, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Places in rows of the k best found for each query, best first, ties by the smaller of ids, and -1 where there are
    fewer; and how many leaves each query visited. known: a score that each query has k of elsewhere, else -inf."""
    d = rows.shape[1]
    k = min(k, len(rows))
    known = np.full(len(queries), -np.inf) if known is None else known
    points, asked = projected(rows, largest, dims), queries @ stable_matrix(d, dims)[:d]
    order, bounds = kd_leaves(points)
    leaves = len(bounds) - 1
    own, own_ids, sizes = rows[order], ids[order], np.diff(bounds)
    low = np.stack([points[order[a:b]].min(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    high = np.stack([points[order[a:b]].max(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    away = _gaps(low, high, asked)
    turn = np.argsort(away, axis=1, kind="stable")
    stop = chi_square_point(dims, sure)
    best = np.full((len(queries), k), -np.inf)
    place = np.full((len(queries), k), -1)
    length = (queries * queries).sum(axis=1)
    visited = np.zeros(len(queries), int)
    open_ = np.arange(len(queries))
    for at in range(0, leaves, STEP):
        kth = np.maximum(length[open_] + largest - 2 * np.maximum(best[open_].min(axis=1), known[open_]), 0.0)
        beyond = away[open_, turn[open_, at]]
        open_ = open_[~((beyond >= stop * kth) & (beyond > 0))]
        if not len(open_):
            break
        now = turn[open_, at : at + STEP]
        visited[open_] += now.shape[1]
        found = np.full((len(open_), now.shape[1] * sizes.max()), -np.inf)
        where = np.full(found.shape, -1)
        flat = np.argsort(now, axis=None, kind="stable")
        cuts = np.searchsorted(now.ravel()[flat], np.arange(leaves + 1))
        for leaf in np.flatnonzero(np.diff(cuts)):
            who, slot = np.divmod(flat[cuts[leaf] : cuts[leaf + 1]], now.shape[1])
            a, b = bounds[leaf], bounds[leaf + 1]
            to = slot[:, None] * sizes.max() + np.arange(b - a)
            found[who[:, None], to] = queries[open_[who]] @ own[a:b].T
            where[who[:, None], to] = np.arange(a, b)
        found, where = np.hstack([best[open_], found]), np.hstack([place[open_], where])
        top = np.argpartition(-found, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(found, top, 1).min(axis=1)
        for i in np.flatnonzero((found >= edge[:, None]).sum(axis=1) > k):  # ties at the edge
            some = np.flatnonzero(found[i] >= edge[i])
            top[i] = some[np.lexsort((np.where(where[i, some] >= 0, own_ids[where[i, some]], np.iinfo(np.int64).max), -found[i, some]))[:k]]
        best[open_], place[open_] = np.take_along_axis(found, top, 1), np.take_along_axis(where, top, 1)
    tied = np.where(place >= 0, own_ids[place], np.iinfo(np.int64).max)
    out = np.take_along_axis(place, np.lexsort((tied, -best), axis=1), 1)
    return np.where(out >= 0, order[np.maximum(out, 0)], -1), visited


class Tree:
    """The upper levels of the kd-tree: cuts at medians of a sample, down to about `most` leaves."""

    def __init__(self, points: np.ndarray, most: int):
        self.axes, self.cuts, self.blocks = {}, {}, 1
        stack = [(0, np.arange(len(points)), most)]
        while stack:
            node, own, parts = stack.pop()
            spread = np.ptp(points[own], axis=0) if len(own) > 1 else np.zeros(1)
            if parts < 2 or not spread.max() > 0:
                continue
            axis = int(np.argmax(spread))
            cut = float(np.median(points[own, axis]))
            left = points[own, axis] < cut
            if not left.any():
                continue
            self.axes[node], self.cuts[node] = axis, cut
            self.blocks += 1
            stack += [(2 * node + 1, own[left], parts // 2), (2 * node + 2, own[~left], parts - parts // 2)]

    def place(self, points: np.ndarray) -> np.ndarray:
        """The block of each point: the number of the leaf that it falls in."""
        out, stack = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while stack:
            node, own = stack.pop()
            if node not in self.axes:
                out[own] = node
                continue
            left = points[own, self.axes[node]] < self.cuts[node]
            stack += [(2 * node + 1, own[left]), (2 * node + 2, own[~left])]
        return out


def usable(vector: Column) -> Column:
    """Not null, no component null or not finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def _classes(own: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(cls, v, members) of the different vectors of own(vec_id, v), members their k + 1 smallest ids, and (vec_id, cls).

    A class is named by its smallest id. Members are cut to k + 1 before rows are dealt out, so a vector that very many
    rows have doesn't meet itself in one task.
    """
    key = F.struct(F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64("v", F.lit(2)).alias("k2"))
    keyed = written(own.withColumn("key", key))
    order = Window.partitionBy("key").orderBy("vec_id")
    few = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    classes = few.groupBy("key").agg(F.min("vec_id").alias("cls"), F.min_by("v", "vec_id").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = written(classes)
    return classes, keyed.select("vec_id", "key")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, block: int = BLOCK, per_block: int = QUERIES, dims: int = DIMS, sure: float = SURE, sample: int = SAMPLE, first: int = FIRST
) -> DataFrame:
    """query_id, rank, vec_id, score of vectors(vec_id, embedding): the k nearest found to each id divisible by `every`.

    Unusable vectors, and rows without an id, take no part; rows that repeat an id count once, as does -0.0 as 0.0; other
    columns are left out. Shorter vectors count as if filled with zeros. Ties go to the smaller vec_id. Scores are inner
    products of the original vectors in double. Without queries or vectors there are no rows.
    """
    own = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    number = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    classes, keyed = _classes(own, k)
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, d, largest = classes.agg(F.count("*"), F.max(F.size("v")), F.max(squared)).first()
    asks = keyed.where(F.col("vec_id") % every == 0).join(classes.select("key", "cls"), "key").select(F.col("vec_id").alias("query_id"), "cls")
    asks = written(asks)
    asked = asks.select("cls").distinct()
    d, largest = d or 1, largest or 0.0
    share = F.lit(min(1.0, sample / max(1, n)))
    drawn = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow()
    tree = Tree(projected(_matrix(drawn["v"], d), largest, dims), -(-max(1, n) // block))
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def to_block(batches):
        for batch in batches:
            points = projected(_matrix(batch.column("v"), d), largest, dims)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.value.place(points)), *(batch.column(c) for c in ("cls", "v", "members")), pa.array(list(points), pa.list_(pa.float64()))], names=["b", "cls", "v", "members", "p"]
            )

    rows = written(classes.select("cls", "v", "members").mapInArrow(to_block, "b long, cls long, v array<double>, members array<long>, p array<double>"))
    sides = [f(F.col("p")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(dims)]
    found = rows.groupBy("b").agg(*sides).toPandas().sort_values("b")
    names, low, high = found["b"].to_numpy(), found[[f"low{j}" for j in range(dims)]].to_numpy(), found[[f"high{j}" for j in range(dims)]].to_numpy()
    boxes = vectors.sparkSession.sparkContext.broadcast((names, low, high))
    queries = written(rows.join(asked, "cls").select("cls", "v"))
    stop = chi_square_point(dims, sure)

    def route(kth_known: bool):
        """(b, cls, v, known) of the blocks that each query searches: the nearest, or the others within its bound."""

        def run(batches):
            names, low, high = boxes.value
            for batch in batches:
                q = _matrix(batch.column("v"), d)
                away = _gaps(low, high, q @ stable_matrix(d, dims)[:d])
                near = np.argsort(away, axis=1, kind="stable")[:, :first]
                if kth_known:
                    known = batch.column("known").to_numpy(zero_copy_only=False)
                    bound = np.maximum((q * q).sum(axis=1) + largest - 2 * known, 0.0)
                    want = ~((away >= stop * bound[:, None]) & (away > 0))
                    np.put_along_axis(want, near, False, 1)
                else:
                    known = np.full(len(q), -np.inf)
                    want = np.zeros(away.shape, bool)
                    np.put_along_axis(want, near, True, 1)
                who, to = np.nonzero(want)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(names[to], pa.int64()), batch.column("cls").take(take), batch.column("v").take(take), pa.array(known[who])], names=["b", "cls", "v", "known"])

        return run

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["v"], d), _matrix(right["v"], d)
            ids, members = left["cls"].to_numpy(), left["members"].to_pylist()
            places, _ = search(x, ids, q, k + 1, largest, dims, sure, right["known"].to_numpy())
            for cls, vector, at in zip(right["cls"].to_pylist(), q, places, strict=True):
                at = at[at >= 0]
                for score, p in zip((x[at] * vector).sum(axis=1).tolist(), at.tolist(), strict=True):
                    out[0].append(cls)
                    out[1].append(members[p])
                    out[2].append(score)
        return pa.table({"cls": pa.array(out[0], pa.int64()), "members": pa.array(out[1], pa.list_(pa.int64())), "score": pa.array(out[2], pa.float64())})

    def searched(asks_of: DataFrame) -> DataFrame:
        """cls, members, score found in the blocks of asks_of(b, cls, v, known); a block asked by many is dealt out."""
        parts = asks_of.groupBy("b").agg(F.ceil(F.count("*") / per_block).cast("int").alias("parts"))
        dealt = asks_of.join(F.broadcast(parts), "b").withColumn("c", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")  # a row for each block
        held = rows.join(F.broadcast(parts), "b").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("b", "c", "cls", "v", "members")
        return written(held.groupBy("b", "c").cogroup(dealt.groupBy("b", "c")).applyInArrow(run, "cls long, members array<long>, score double"))

    best_first = Window.partitionBy("cls").orderBy(F.desc("score"), F.col("members")[0])
    near = searched(written(queries.mapInArrow(route(False), _ROUTED)))
    kth = near.withColumn("r", F.row_number().over(best_first)).groupBy("cls").agg(F.min(F.when(F.col("r") == k + 1, F.col("score"))).alias("kth"))
    bounded = queries.join(kth, "cls", "left").select("cls", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("known"))
    far = searched(written(bounded.mapInArrow(route(True), _ROUTED)))
    top = near.union(far).withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= k + 1)
    top = written(top.select("cls", "score", F.explode("members").alias("vec_id")))
    discard(classes, queries, rows, near, far)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = asks.join(top, "cls").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_ROUTED = "b long, cls long, v array<double>, known double"
