"""Vector code compression: integer product codes, nearest entries found by Orchard's search.

Components become integers, vectors are cut into PARTS consecutive parts, and each part position has a codebook of at most
ENTRIES entries. A part's code is its nearest entry. Orchard's search keeps, for every entry, the list of all entries
sorted by their distance from it. It walks down the current entry's list, marks what it has compared, and jumps to the
list of an entry that is nearer as soon as it meets one. By the triangle inequality nothing beyond twice the current
distance can be nearer or as near, so it stops there, and the answer is exact.

Codebooks hold ENTRIES x dimensions numbers at most; they alone are broadcast. A task adds up its own parts by entry, so
PARTS x ENTRIES rows leave it in a round, and the driver sees as many sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import discard, small_side, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within these bounds, so that squared distances of 1,000 components fit 64 bits.
BOUND = 1 << 25


def finite(vector: Column) -> Column:
    """Not null, no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale x) of each component, held within BOUND."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int"))


class Book:
    """The codebook of one part position, with every entry's neighbours sorted by distance, ties by index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.near = np.argsort(self.apart, axis=1, kind="stable")

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each point, ties to the lower index, its squared distance, and how many were compared."""
        n, k = len(points), len(self.entries)
        best_at = np.zeros(n, np.int64)
        best = ((points - self.entries[0]) ** 2).sum(axis=1)
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        along = np.zeros(n, np.int64)
        open_, compared = np.arange(n), n
        while len(open_):
            current = best_at[open_]
            other = self.near[current, along[open_]]
            within = self.apart[current, other] <= 4 * best[open_]
            open_, other = open_[within], other[within]
            along[open_] += 1
            fresh = ~marked[open_, other]
            who, what = open_[fresh], other[fresh]
            marked[who, what] = True
            compared += len(who)
            away = ((points[who] - self.entries[what]) ** 2).sum(axis=1)
            nearer = (away < best[who]) | ((away == best[who]) & (what < best_at[who]))
            jump = who[nearer]
            best_at[jump], best[jump], along[jump] = what[nearer], away[nearer], 0
            open_ = open_[along[open_] < k]
        return best_at, best, compared


def _cut(column: pa.Array, parts: int, per: int) -> np.ndarray:
    """The vectors of a list column as (part, row, position), shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if per and (sizes == parts * per).all():
        whole = flat.reshape(len(sizes), parts, per)
    else:
        whole = np.zeros((len(sizes), parts * per), np.int64)
        whole[np.arange(parts * per) < sizes[:, None]] = flat
        whole = whole.reshape(len(sizes), parts, per)
    return np.ascontiguousarray(whole.transpose(1, 0, 2))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of rows(vec_id, q), begun with the rows of the smallest vec_ids, nulls last, ties by q.

    Each round adds up the parts nearest to every entry and puts the floor of their mean in its place; unused entries stay.
    """
    d = rows.agg(F.max(F.size("q"))).first()[0] or 0
    per = -(-d // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()["q"].combine_chunks()
    books = _cut(first, parts, per)
    for _ in range(rounds if len(first) else 0):
        sent = rows.sparkSession.sparkContext.broadcast(books)

        def add_up(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = [Book(b) for b in sent.value]
            shape = len(own), len(own[0].entries)
            count, total = np.zeros(shape, np.int64), np.zeros((*shape, per), np.int64)
            for batch in batches:
                for p, points in enumerate(_cut(batch.column("q"), parts, per)):
                    at, _, _ = own[p].search(points)
                    count[p] += np.bincount(at, minlength=shape[1])
                    np.add.at(total[p], at, points)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        sums = rows.select("q").mapInArrow(add_up, "part long, entry long, n long, total array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(per))).alias("total"))
        for part, entry, n, total in sums.collect():  # parts x entries rows
            books[part, entry] = [t // n for t in total]
        sent.unpersist()
    return books


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors(vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are left out; zero vectors count, and so do rows without an
    id, rows that repeat one, and equal vectors, each as a row. Vectors whose length isn't the longest, or whose length the
    parts don't divide, count as filled with zeros at the end. Components beyond +-131,072 count as those. With fewer rows
    than entries codebooks are shorter. label_error adds the errors of equal labels, nulls together. An empty table has no
    rows; other columns are left out.
    """
    own = vectors.where(finite(F.col("embedding")))
    rows = written(own.select(F.col("vec_id").cast("long").alias("vec_id"), "label", integers(F.col("embedding")).alias("q")))
    books = train(rows, parts, entries, rounds)
    per, digest = books.shape[2], hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(books)
    label = pa.field("label", rows.select("label").limit(0).toArrow().schema.field("label").type)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in sent.value]
        for batch in batches:
            found = [own[p].search(points) for p, points in enumerate(_cut(batch.column("q"), parts, per))]
            codes = np.stack([at for at, _, _ in found], axis=1).astype(np.uint8)
            error = np.sum([e for _, e, _ in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label").cast(label.type), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    told = written(rows.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"))
    discard(rows)
    sums = small_side(written(told.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))))
    return told.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
