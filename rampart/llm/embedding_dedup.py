"""Embedding near-dedup: a navigable small-world graph for each shard, audited range queries, exact cosines, components.

1. Equal vectors are one class, searched once and counted as often as they stand.
2. Classes are dealt to shards by a hash, SHARD in each. A shard's graph has levels: each level holds a sixteenth of the one
   below, the last one has all. Points join a level in batches that double it: they search the points before them from
   where the level above leads, look at their own batch, and link to neighbours that are nearer to them than to each other.
   Links also run back, and full lists are thinned by the same rule.
3. Every class queries every shard. A query keeps a beam of its nearest so far, and its beam widens until the farthest in
   it lies beyond the threshold, so a group of thousands of near copies is followed to its end.
4. Each task compares some of its queries with its whole shard, block by block. If they have missed a link, all its queries
   run again with twice the beam, up to the shard's size, where nothing can be missed.
5. Cosines of what is found are computed in double from the original vectors. A task sends each class's count of links, and
   of the links themselves a spanning forest, so a group of n near copies sends n links, not n x n. Components are united
   by stars over these.

A task holds one graph (SHARD x about 700 bytes) and PART queries. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.ann_projection import _matrix, usable
from rampart.llm.common import discard, small_side, written
from rampart.llm.components import components

LIKE, SHARD, PART = 0.9, 65_536, 4096
#: Links of a new point, most links of a point on a level, beam when building, first beam of queries, share of a level in the one above.
LINKS, FULL, BUILD, BEAM, RATIO = 12, 28, 32, 48, 16
#: Points that are scanned without a graph, points added at once, queries that walk at once, audited queries of a task.
SCAN, BATCH, WALK, AUDIT = 128, 1024, 128, 256
#: Cosines in single precision are trusted this far; walks go on this far below the threshold.
BLUR, SLACK = 1e-4, 0.03


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by a power of two, so that squares neither overflow nor vanish, and their lengths."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, initial=0))
    scaled = np.ldexp(rows, -exponent[:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def _best(ids: np.ndarray, sims: np.ndarray, done: np.ndarray, width: int):
    """The `width` most similar of each row, in falling order."""
    if sims.shape[1] > 2 * width:
        top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims, done = (np.take_along_axis(x, top, 1) for x in (ids, sims, done))
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, sims, done))


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the `width` best of x[: len(links)] that each query meets over the links from its entries, best
    first, -1 and -inf where it meets fewer. Every entry of the beam has been expanded at the end."""
    n, q = len(links), len(queries)
    entries = np.sort(entries, axis=1)
    entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = -1
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no neighbour
    at_once = max(8, width // 4)
    ids = np.where(entries < 0, n, entries)
    sims = np.where(entries < 0, -np.inf, np.einsum("qed,qd->qe", x[np.minimum(ids, n - 1)], queries)).astype(np.float32)
    seen[np.arange(q)[:, None], ids] = True
    ids, sims = (np.hstack([y, np.full((q, max(0, width - y.shape[1])), fill, y.dtype)]) for y, fill in ((ids, n), (sims, -np.inf)))
    ids, sims, done = _best(ids, sims, np.isinf(sims), width)
    open_ = np.arange(q)
    while len(open_):
        own_ids, own_sims, own_done = ids[open_], sims[open_], done[open_]
        turn = np.argsort(own_done, axis=1, kind="stable")[:, :at_once]
        fresh = ~np.take_along_axis(own_done, turn, 1)
        from_ = np.where(fresh, np.take_along_axis(own_ids, turn, 1), n)
        np.put_along_axis(own_done, turn, True, 1)
        to = np.where((from_ < n)[:, :, None], links[np.minimum(from_, n - 1)], -1).reshape(len(open_), -1)
        to = np.sort(np.where(to < 0, n, to), axis=1)
        new = ~seen[open_[:, None], to] & (to < n)
        new[:, 1:] &= to[:, 1:] != to[:, :-1]
        r, c = np.nonzero(new)
        target = to[r, c]
        seen[open_[r], target] = True
        more = np.full(to.shape, -np.inf, np.float32)
        more[r, c] = np.einsum("nd,nd->n", x[target], queries[open_[r]])
        joined = np.hstack([own_ids, to]), np.hstack([own_sims, more]), np.hstack([own_done, ~new])
        own_ids, own_sims, own_done = _best(*joined, width)
        own_done |= np.isinf(own_sims)
        ids[open_], sims[open_], done[open_] = own_ids, own_sims, own_done
        open_ = open_[~own_done.all(axis=1)]
    return np.where(np.isinf(sims), -1, ids), sims


def _padded(ids: np.ndarray, width: int) -> np.ndarray:
    return ids if ids.shape[1] >= width else np.hstack([ids, np.full((len(ids), width - ids.shape[1]), -1, ids.dtype)])


def spread(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of each point's candidates (-1: none), nearest first, those nearer to the point than to any taken before, `most` at most,
    filled up with the nearest of the others."""
    sims = np.where(candidates < 0, -np.inf, np.einsum("pcd,pd->pc", x[np.maximum(candidates, 0)], points)).astype(np.float32)
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    double = np.zeros(candidates.shape, bool)
    double[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    vectors = x[np.maximum(candidates, 0)]
    among = np.matmul(vectors, vectors.transpose(0, 2, 1))
    taken = np.zeros(candidates.shape, bool)
    closest = np.full(candidates.shape, -np.inf, np.float32)  # to any taken
    for k in range(candidates.shape[1]):
        take = (candidates[:, k] >= 0) & ~double[:, k] & (sims[:, k] > closest[:, k]) & (taken.sum(axis=1) < most)
        taken[:, k] = take
        np.maximum(closest, np.where(take[:, None], among[:, :, k], -np.inf), out=closest)
    left = (candidates >= 0) & ~double & ~taken
    rank = np.argsort(np.where(taken, 0, np.where(left, 1, 2)), axis=1, kind="stable")[:, :most]
    keep = np.take_along_axis(taken | left, rank, 1)
    return _padded(np.where(keep, np.take_along_axis(candidates, rank, 1), -1), most)


class Graph:
    """The levels of a shard's graph over unit vectors x; level k holds the first len(levels[k]) of them."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray] | None = None):
        self.x, self.levels = x, levels or []
        if levels is None:
            sizes = [len(x)]
            while sizes[0] > SCAN:
                sizes.insert(0, sizes[0] // RATIO)
            for size in sizes:
                self._level(size)

    def entries(self, queries: np.ndarray, levels: int, width: int = 6) -> np.ndarray:
        """Where the first `levels` levels lead."""
        top = self.levels[0]
        sims = queries @ self.x[: len(top)].T
        found = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        for level in self.levels[1:levels]:
            found, _ = beam(self.x, level, queries, found, 2 * width)
            found = found[:, :width]
        return found

    def _level(self, size: int) -> None:
        links = np.full((size, FULL), -1, np.int32)
        above = len(self.levels)
        at = 0
        while at < size:
            stop = min(size, max(SCAN, 2 * at), at + BATCH)
            own = self.x[at:stop]
            near = np.argsort(-(own @ own.T), axis=1, kind="stable")[:, 1 : BUILD // 2 + 1].astype(np.int64) + at
            if at:
                start = self.entries(own, above) if above else np.zeros((len(own), 1), np.int64)
                start = np.where(start < at, start, 0)
                found = np.vstack([beam(self.x, links[:at], own[k : k + WALK], start[k : k + WALK], BUILD)[0] for k in range(0, len(own), WALK)])
                near = np.hstack([found, near])
            for k in range(0, len(own), WALK):
                links[at + k : min(stop, at + k + WALK), :LINKS] = spread(self.x, own[k : k + WALK], near[k : k + WALK], LINKS)
            self._back(links, at, stop)
            at = stop
        self.levels.append(links)

    def _back(self, links: np.ndarray, at: int, stop: int) -> None:
        """Links back to the points at..stop; lists that they overfill are thinned."""
        from_ = np.repeat(np.arange(at, stop), LINKS)
        to = links[at:stop, :LINKS].ravel()
        from_, to = from_[to >= 0], to[to >= 0]
        sims = np.einsum("nd,nd->n", self.x[from_], self.x[to])
        order = np.lexsort((-sims, to))
        from_, to = from_[order], to[order]
        ends, first, many = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(first, many)
        keep = nth < FULL  # of those of one batch, the nearest
        incoming = np.full((len(ends), FULL), -1, np.int32)
        incoming[np.repeat(np.arange(len(ends)), many)[keep], nth[keep]] = from_[keep]
        used = (links[ends] >= 0).sum(axis=1)
        fits = used + np.minimum(many, FULL) <= FULL
        for e, u, row in zip(ends[fits], used[fits], incoming[fits], strict=True):
            row = row[row >= 0]
            links[e, u : u + len(row)] = row
        over = np.flatnonzero(~fits)
        for k in range(0, len(over), WALK):
            e = ends[over[k : k + WALK]]
            both = np.hstack([links[e], incoming[over[k : k + WALK]]])
            links[e] = _padded(spread(self.x, self.x[e], both, FULL - 4), FULL)

    def within(self, queries: np.ndarray, like: float, width: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of what is found at a similarity of `like` or more: beams of a width that doubles for the queries whose
        beam has nothing beyond the threshold. own: the place of a query that is a point itself, else -1; it starts there too."""
        n, out, open_ = len(self.x), [], np.arange(len(queries))
        start = np.hstack([self.entries(queries, len(self.levels) - 1), own[:, None]])
        while len(open_):
            width, wider = min(width, n), []
            rows = max(1, min(WALK, (1 << 22) // (n + 40 * width)))
            for k in range(0, len(open_), rows):
                who = open_[k : k + rows]
                ids, sims = beam(self.x, self.levels[-1], queries[who], start[who], width)
                full = (sims[:, -1] >= like - SLACK) & (width < n)
                wider.append(who[full])
                r, c = np.nonzero((sims >= like) & ~full[:, None])
                out.append((who[r], ids[r, c]))
            open_ = np.concatenate(wider)
            width *= 2
        return np.concatenate([a for a, _ in out] or [np.empty(0, np.int64)]), np.concatenate([b for _, b in out] or [np.empty(0, np.int64)])


def audited(graph: Graph, queries: np.ndarray, like: float, width: int, audit: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all queries, with beams as wide as evenly drawn queries need to miss none of theirs."""
    drawn = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    want = np.zeros(len(queries), np.int64)
    for k in range(0, len(graph.x), 1 << 14):
        want[drawn] += (queries[drawn] @ graph.x[k : k + (1 << 14)].T >= like).sum(axis=1)
    while True:
        who, place = graph.within(queries, like, width, own)
        got = np.bincount(who, minlength=len(queries))
        if width >= len(graph.x) or (got[drawn] >= want[drawn]).all():
            return who, place
        width *= 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) between numbered nodes: (node, its root), roots left out."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = both[: len(a)], both[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


_EMPTY = np.empty(0, np.int64)
_FOUND = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def near_copies(vectors: DataFrame, like: float = LIKE, shard: int = SHARD, part: int = PART, width: int = BEAM, audit: int = AUDIT) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Equal vectors link with each other;
    rows that repeat an id count as rows of their own. A row without an id counts as a link and joins components, but gives
    none its name, and is kept only as none (kept is false). Shorter vectors count as filled with zeros. Lengths of any size
    are scaled first. Without rows there are none; other columns are left out.
    """
    told = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = F.transform("v", lambda x: x + F.lit(0.0))
    key = F.when(usable(F.col("v")), F.concat(F.hex(F.xxhash64(F.lit(1), v)), F.lit("-"), F.hex(F.xxhash64(v, F.lit(2)))))
    told = written(told.select("vec_id", v.alias("v"), key.alias("cls")))
    classes = told.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = written(classes)
    n, d = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    d, shards, parts = d or 1, max(1, ceil(n / shard)), max(1, ceil(n / part))

    def build(group: pa.Table) -> pa.Table:
        scaled, length = unit(_matrix(group["v"], d))
        graph = Graph((scaled / length[:, None]).astype(np.float32))
        own = group.append_column("i", pa.array(np.arange(group.num_rows)))
        flat = np.full((group.num_rows, FULL * len(graph.levels)), -2, np.int32)  # -2: not on this level
        for k, level in enumerate(graph.levels):
            flat[: len(level), k * FULL : (k + 1) * FULL] = level
        return own.append_column("links", pa.array(list(flat), pa.list_(pa.int32()))).select(["s", "i", "cls", "size", "v", "links"])

    dealt = classes.select(F.pmod(F.xxhash64("cls", F.lit(11)), F.lit(shards)).cast("int").alias("s"), "cls", "size", "v")
    graphs = written(dealt.groupBy("s").applyInArrow(build, "s int, i long, cls string, size long, v array<double>, links array<int>"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, count = [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by("i")
            flat = np.stack(left["links"].to_numpy())
            levels = [flat[flat[:, k] > -2, k : k + FULL] for k in range(0, flat.shape[1], FULL)]
            scaled, length = unit(_matrix(left["v"], d))
            asked, asked_length = unit(_matrix(right["v"], d))
            graph = Graph((scaled / length[:, None]).astype(np.float32), levels)
            names, own, sizes = left["cls"].to_numpy(), right["cls"].to_numpy(), left["size"].to_numpy()
            at = {c: k for k, c in enumerate(names)}
            itself = np.array([at.get(c, -1) for c in own])
            who, place = audited(graph, (asked / asked_length[:, None]).astype(np.float32), like - BLUR, width, audit, itself)
            fine = np.zeros(len(who), bool)
            for k in range(0, len(who), 1 << 14):
                w, p = who[k : k + (1 << 14)], place[k : k + (1 << 14)]
                fine[k : k + (1 << 14)] = np.einsum("nd,nd->n", asked[w], scaled[p]) / (asked_length[w] * length[p]) >= like
            fine &= names[place] != own[who]
            who, place = who[fine], place[fine]
            number = {c: k for k, c in enumerate(dict.fromkeys([*own, *names]))}
            every = list(number)
            u = np.fromiter((number[c] for c in own[who]), np.int64, len(who))
            to = np.fromiter((number[c] for c in names[place]), np.int64, len(who))
            x, root = _forest(u, to) if len(u) else (_EMPTY, _EMPTY)
            totals = np.bincount(who, weights=sizes[place], minlength=len(own)).astype(np.int64) if len(who) else np.zeros(len(own), np.int64)
            linked = np.flatnonzero(totals)
            a = [every[k] for k in x] + [own[k] for k in linked]
            b = [every[k] for k in root] + [None] * len(linked)
            count = [0] * len(x) + totals[linked].tolist()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((a, b, count), _FOUND, strict=True)], schema=_FOUND)

    every_part, every_shard = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asks = classes.select("cls", "v", F.pmod(F.xxhash64("cls", F.lit(12)), F.lit(parts)).cast("int").alias("part")).select(every_shard.alias("s"), "part", "cls", "v")
    found = graphs.withColumn("part", every_part).groupBy("s", "part").cogroup(asks.groupBy("s", "part")).applyInArrow(search, "a string, b string, n long")
    found = written(found)
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    labels = written(components(found.where("b is not null").select("a", "b")))
    named = classes.select("cls", "size", "least").join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    named = written(named.select("cls", "size", "least", F.coalesce("label", "cls").alias("label"), F.coalesce("n", F.lit(0)).alias("n")))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    of = named.where("n > 0 or size > 1").join(least, "label").select("cls", (F.col("n") + F.col("size") - 1).alias("links"), "component")
    of = small_side(written(of))
    discard(classes, graphs, found, labels, named)
    component = F.coalesce("component", "vec_id")
    out = told.join(of, "cls", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
