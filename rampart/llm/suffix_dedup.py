"""Removal of repeated 400-byte strings: distributed prefix doubling over sampled suffixes, windows only at the edges.

1. Equal texts are one class; of a class one row goes on. All bytes of copies are repeated.
2. Suffixes are sampled by content: a suffix is an anchor if its first GRAM bytes have the least hash among STRIDE
   neighbours, so equal 400-byte strings hold the same anchors wherever they start, but for their edges. Segments lie
   between anchors. Every window of 400 bytes belongs to its first anchor inside those edges.
3. Prefix doubling: anchors are sorted by their first two segments (128 bits of them) and ranked; then Spark sorts the pairs
   of the ranks at an anchor and at 2, 4, 8, ... anchors behind it, and ranks anew. An anchor whose rank is unique leaves.
   Only equality of ranks matters, so rows are dealt by a hash of their pair and sorted where they lie.
   An anchor is past the threshold when its ranked prefix covers all windows that start before the next anchor: these are
   repeated, and nothing of them is looked at any more. Its prefix needn't be a power of two: it ends with a pair at a
   quarter of the offset.
4. What doubling leaves open are windows around the ends of repeated strings: their anchors' inner segments are repeated,
   but the bytes before the first anchor or behind the last segment aren't known. Only these windows, and those of other
   anchors with the same two first segments, are sent as stretches of text to the task of the rarest gram that they hold,
   and compared there by 128-bit rolling hashes of their 400 bytes. A gram that more than HOT stretches hold is not
   gathered in one task: its windows go as rows that are counted first and then joined.

Pairs that a sample shows to be very common get their rank by broadcast, and their rows are dealt out evenly; the sample only
decides where rows go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.common import discard, sliced, small_side, written

#: HOT: bytes of stretches with one gram that a task may gather.
LENGTH, GRAM, STRIDE, HOT = 400, 24, 75, 4 << 20
#: One text of COMMON_OF is looked at for common pairs, and one that COMMON of its anchors have is common.
COMMON_OF, COMMON = 16, 32
_BLOCK = 1 << 20
#: Two independent rolling hashes of 64 bits: the second is only taken where the first finds equals.
_STEPS = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_BYTES = np.random.default_rng(400).integers(0, 1 << 64, (2, 256), np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.uint64(0xFFFFFFFF)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(n: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash's step and of its inverse modulo 2**64."""
    if (kind, 1) not in _powers or len(_powers[kind, 1]) < n:
        size = max(n, 1 << 16)
        for way in (1, -1):
            all_ = np.full(size, pow(_STEPS[kind], way, 1 << 64), np.uint64)
            all_[0] = 1
            _powers[kind, way] = np.multiply.accumulate(all_)
    return _powers[kind, 1], _powers[kind, -1]


def prefix_sums(data: np.ndarray, kind: int = 0) -> np.ndarray:
    up, _ = _power(len(data) + 1, kind)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[kind][data] * up[: len(data)], out=out[1:])
    return out


def string_hashes(sums: np.ndarray, starts: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """Hashes of the strings of a length at starts, equal for equal strings wherever they stand."""
    h = (sums[starts + length] - sums[starts]) * _power(len(sums), kind)[1][starts]
    h ^= h >> np.uint64(29)
    return h * _MIX


def all_hashes(sums: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """Hashes of all strings of a length, by start."""
    n = len(sums) - length
    h = (sums[length:] - sums[:n]) * _power(len(sums), kind)[1][:n]
    h ^= h >> np.uint64(29)
    return h * _MIX


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` neighbours stands, the last of equals, by the first neighbour's place."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    got = (values & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    size = 1
    while size * 2 <= width:
        got = np.minimum(got[:-size], got[size:])
        size *= 2
    if size < width:
        got = np.minimum(got[: n - width + 1], got[width - size : width - size + n - width + 1])
    return (_LOW - (got & _LOW)).astype(np.int64)


def anchors(data: np.ndarray) -> np.ndarray:
    """Places of the anchors of a text."""
    found = []
    for at in range(0, max(1, len(data) - GRAM - STRIDE + 2), _BLOCK):
        part = data[at : at + _BLOCK + GRAM + STRIDE - 2]
        if len(part) >= GRAM + STRIDE - 1:
            found.append(least_of(all_hashes(prefix_sums(part), GRAM), STRIDE) + at)
    places = np.concatenate(found) if found else np.empty(0, np.int64)
    return places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places  # they never go back


def segment_names(text: bytes, places: np.ndarray) -> np.ndarray:
    """128 bits of each two segments, from an anchor through the gram of the second anchor behind it, as two rows."""
    at = places.tolist()
    digests = b"".join([xxhash.xxh3_128_digest(text[a : b + GRAM]) for a, b in zip(at[:-2], at[2:], strict=True)])
    return np.ascontiguousarray(np.frombuffer(digests, np.int64).reshape(-1, 2).T)  # Arrow is slow over strides


def covering(places: np.ndarray, length: int) -> np.ndarray:
    """By anchor but the last: how many segments hold all windows that start before the next anchor; 0 if the text ends."""
    end = np.searchsorted(places, places[1:] + length - 1 - GRAM)
    return np.where(end < len(places), end - np.arange(len(places) - 1), 0)


def owned(places: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By anchor: first and last start of its windows, and how many segments from it on all of them hold."""
    first = np.maximum(0, np.concatenate(([0], places[:-1] - STRIDE + 2)))
    last = np.minimum(places - STRIDE + 1, n - length)
    inner = np.searchsorted(places, first + length + 1 - STRIDE - GRAM, "right") - 1 - np.arange(len(places))
    return first, last, np.where(last >= first, np.maximum(inner, 0), 0)


def needs(cover: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """How many segments from each anchor on must be ranked, for its own sake or for anchors before it."""
    goal = np.maximum(cover - 1, inner)
    if not len(goal):
        return goal
    reach, size = int(goal.max()), 1
    out = goal.copy()
    while size <= reach:  # out holds the largest of `size` neighbours
        step = min(size, reach + 1 - size)
        out[step:] = np.maximum(out[step:], out[:-step])
        size += step
    return out


def _signatures(docs: DataFrame, length: int) -> DataFrame:
    """row, doc_id, text, n, key, sha of every row; only the first of equal texts in a task has anchors: places, a and b (the
    names of segments), cover, inner and need."""
    schema = "doc_id long, text binary, n long, key binary, sha string, places array<int>, a array<long>, b array<long>, cover array<int>, inner array<int>, need array<int>"
    kinds = {"n": pa.int64(), "key": pa.binary(), "sha": pa.string(), "places": pa.list_(pa.int32()), "a": pa.list_(pa.int64()), "b": pa.list_(pa.int64()), "cover": pa.list_(pa.int32()), "inner": pa.list_(pa.int32()), "need": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch in sliced(batches, "text"):
            out = {c: [] for c in kinds}
            for text in batch.column("text").to_pylist():
                key = xxhash.xxh3_128_digest(text)
                made = [None] * 6
                if len(text) >= length and key not in known:
                    places = anchors(np.frombuffer(text, np.uint8))
                    names = segment_names(text, places)
                    cover, inner = covering(places, length)[:-1].astype(np.int32), owned(places, len(text), length)[2][:-2].astype(np.int32)
                    made = [places.astype(np.int32), names[0], names[1], cover, inner, needs(cover, inner)]
                known.add(key)
                for c, v in zip(kinds, (len(text), key, hashlib.sha256(text).hexdigest(), *made), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *(pa.array(out[c], k) for c, k in kinds.items())], names=["doc_id", "text", *kinds])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    return written(own.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys another row has too, with their rank: the place of the first of equals when rows are sorted by keys.

    Keys that are common in a sample of texts have a rank of their own, below 0, and their rows are dealt out evenly; all
    other rows are dealt by their keys and sorted where they lie. rows is read once, and the sample's part of it.
    """
    seen = rows.where(F.pmod(F.xxhash64("row"), F.lit(COMMON_OF)) == 0)
    common = seen.groupBy(*keys).agg(F.count("*").alias("c")).where(F.col("c") >= COMMON).select(*keys)
    common = small_side(written(common.withColumn("known", -1 - F.monotonically_increasing_id())))
    deal = F.when(F.col("known").isNull(), F.hash(*keys)).otherwise(F.hash("row", "i"))
    dealt = rows.join(common, keys, "left").withColumn("deal", deal).repartition("deal").sortWithinPartitions("deal", *keys)
    equal = Window.partitionBy("deal", *keys)
    told = dealt.withColumn("at", F.monotonically_increasing_id()).withColumns({"first": F.min("at").over(equal), "c": F.count("*").over(equal)})
    return told.where("known is not null or c > 1").withColumn("name", F.coalesce("known", "first")).drop("known", "deal", "at", "first", "c")


def doubled(suffixes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(row, i, whole, inner): anchors whose windows before the next anchor are repeated, or whose inner segments are; the
    first ranks (row, i, rank), by prefix doubling over suffixes(row, i, a, b, cover, inner, need); and the tables they read."""
    own = ["row", "i", "cover", "inner", "need"]
    first = written(_ranked(suffixes, ["a", "b"]).select(*own, F.col("name").alias("rank")))
    told = lambda df, whole, inner: df.select("row", "i", whole.alias("whole"), inner.alias("inner")).where("whole or inner")
    within = lambda size: (F.col("inner") >= size) & (F.col("inner") < 2 * size)
    made, out, ranks, size = [first], told(first, F.col("cover").between(1, 2), within(2)), first, 2
    order = Window.partitionBy("row").orderBy("i")
    while True:
        steps = min(4, size)
        unit = size // steps
        ends = (F.col("cover") > size) & (F.col("cover") <= 2 * size)  # the prefix is ranked whole by one more pair
        part = F.ceil((F.col("cover") - size) / unit).cast("int")
        on = F.col("need") >= 2 * size
        # an anchor between that has left was unique, and so is the longer prefix: the row `step` behind must be the anchor `step` behind
        behind = F.array(*(F.lead(F.struct("i", "rank"), k * unit).over(order) for k in range(1, steps + 1)))
        parts = F.array_distinct(F.array_compact(F.array(F.when(ends, part), F.when(on, F.lit(steps)))))
        pairs = ranks.withColumn("behind", behind).where(ends | on).withColumn("part", F.explode(parts)).withColumn("behind", F.col("behind")[F.col("part") - 1])
        pairs = pairs.where(F.col("behind.i") == F.col("i") + F.col("part") * unit).withColumn("then", F.col("behind.rank")).drop("behind")
        found = written(_ranked(pairs, ["part", "rank", "then"]))
        made.append(found)
        goes_on = (F.col("part") == steps) & on
        out = out.union(told(found, ends & (F.col("part") == part), goes_on & within(2 * size)))
        ranks = found.where(goes_on).select(*own, F.col("name").alias("rank"))
        size *= 2
        if ranks.isEmpty():
            return out, first.select("row", "i", "rank"), made


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of numbers of a column, without nulls, as arrays."""
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(zero_copy_only=False), (ends - ends[0])[1:-1]) if len(column) else []


def _decided(lead: DataFrame, ranked: DataFrame, length: int) -> DataFrame:
    """row, done, open, inner: runs of starts (first, last) that doubling decides, and anchors with windows left open."""
    by_row = ranked.groupBy("row").agg(*(F.collect_list(F.when(F.col(c), F.col("i"))).alias(c) for c in ("whole", "inner")))
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    ints = pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            done, left = [], []
            for n, places, whole, inner in zip(batch.column("n").to_pylist(), *(_lists(batch.column(c)) for c in ("places", "whole", "inner")), strict=True):
                sure = np.zeros(len(places), bool)
                sure[whole] = True
                sure[-1] = False
                done.append([{"first": int(places[a]), "last": int(places[b]) - 1} for a, b in zip(*_runs(sure), strict=True)])
                places = places.astype(np.int64)
                first, last, _ = owned(places, n, length)
                before = np.concatenate(([0], np.cumsum(~sure)))
                low, high = np.searchsorted(places, first, "right") - 1, np.searchsorted(places, last, "right") - 1
                shut = (low >= 0) & (before[high + 1] == before[np.maximum(low, 0)])
                left.append(inner[~shut[inner] & (last[inner] >= first[inner])])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(done, spans), pa.array(left, ints), batch.column("inner")], names=["row", "done", "open", "inner"])

    rows = lead.select("row", "n", "places").join(by_row, "row").select("row", "n", "places", "whole", "inner")
    return rows.mapInArrow(run, "row long, done array<struct<first:long,last:long>>, open array<int>, inner array<int>")


def _stretches(texts: DataFrame, length: int) -> DataFrame:
    """row, start, gram, bytes: the windows to compare, cut where another gram of theirs is the least."""
    names = ["row", "start", "gram", "bytes"]

    def run(batches):
        for batch in sliced(batches, "text"):
            out = [], [], [], []
            for row, text, places, chosen in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), _lists(batch.column("places")), _lists(batch.column("chosen")), strict=True):
                data = np.frombuffer(text, np.uint8)
                first, last, _ = owned(places.astype(np.int64), len(text), length)
                chosen = np.sort(chosen)
                want = np.zeros(len(text) - length + 2, np.int32)
                np.add.at(want, first[chosen], 1)
                np.add.at(want, last[chosen] + 1, -1)
                for a, b in zip(*(x.tolist() for x in _runs(np.cumsum(want[:-1]) > 0)), strict=True):
                    for at in range(a, b, _BLOCK):
                        end = min(b, at + _BLOCK)
                        hashes = all_hashes(prefix_sums(data[at : end + length - 1]), GRAM)
                        least = hashes[least_of(hashes, length - GRAM + 1)]
                        cuts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, [end - at]))
                        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                            for k, v in zip(out, (row, at + x, int(least[x].view(np.int64)), text[at + x : at + y + length - 1]), strict=True):
                                k.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    return texts.mapInArrow(run, "row long, start long, gram long, bytes binary")


def _joined(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces as one array, where their windows start in it, and how many each piece has."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    inside = np.ones(len(data) + 1, bool)
    for end in np.cumsum(sizes):
        inside[max(0, end - length + 1) : end] = False
    return data, np.flatnonzero(inside[: len(data) - length + 1]), sizes - length + 1


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _equal_in_task(stretches: DataFrame, length: int) -> DataFrame:
    """row, first, last: starts of repeated windows; stretches of a gram stand together in sorted partitions."""

    def flush(rows, starts, pieces):
        data, places, counts = _joined(pieces, length)
        flags = np.zeros(len(places), bool)
        hashes = all_hashes(prefix_sums(data), length)[places]
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        if same.any():
            some = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            again = string_hashes(prefix_sums(data, 1), places[some], length, 1)
            both = np.lexsort((again, hashes[some]))
            one, two = hashes[some][both], again[both]
            same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            flags[some[both][np.concatenate(([False], same)) | np.concatenate((same, [False]))]] = True
        out, at = ([], [], []), 0
        for row, start, n in zip(rows, starts, counts.tolist(), strict=True):
            for a, b in zip(*(x.tolist() for x in _runs(flags[at : at + n])), strict=True):
                for k, v in zip(out, (row, start + a, start + b - 1), strict=True):
                    k.append(v)
            at += n
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["row", "first", "last"])

    def run(batches):
        rows, starts, pieces, held, gram = [], [], [], 0, None
        for batch in sliced(batches, "bytes"):
            for row, start, g, piece in zip(*(batch.column(c).to_pylist() for c in ("row", "start", "gram", "bytes")), strict=True):
                if g != gram and held > _BLOCK:
                    yield flush(rows, starts, pieces)
                    rows, starts, pieces, held = [], [], [], 0
                gram = g
                rows.append(row)
                starts.append(start)
                pieces.append(piece)
                held += len(piece)
        if rows:
            yield flush(rows, starts, pieces)

    return stretches.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "row long, first long, last long")


def _equal_by_rows(stretches: DataFrame, length: int) -> DataFrame:
    """The same for grams of many stretches: a row for each window; hashes are counted before rows meet them."""

    def run(batches):
        for batch in sliced(batches, "bytes"):
            data, places, counts = _joined(batch.column("bytes").to_pylist(), length)
            at = np.concatenate([np.arange(n) for n in counts])
            each = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts)
            w = [string_hashes(prefix_sums(data, kind), places, length, kind).view(np.int64) for kind in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(each("row"), pa.int64()), pa.array(each("start") + at, pa.int64()), *map(pa.array, w)], names=["row", "first", "w1", "w2"])

    rows = written(stretches.mapInArrow(run, "row long, first long, w1 long, w2 long"))
    counts = written(rows.groupBy("w1", "w2").agg(F.count("first").alias("c")).where("c > 1").select("w1", "w2"))
    return rows.join(small_side(counts), ["w1", "w2"], "left_semi").select("row", "first", F.col("first").alias("last"))


def _cut(rows: DataFrame, cover: DataFrame, length: int) -> DataFrame:
    """rows(row, ...) that lose bytes, with n_removed, n_spans and kept instead of text."""
    by_row = cover.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("c")).select("row", F.col("c.first").alias("first"), F.col("c.last").alias("last"))
    more = ["doc_id", "n", "copies"]

    def run(batches):
        for batch in sliced(batches, "text"):
            out = [], [], []
            for text, first, last in zip(batch.column("text").to_pylist(), _lists(batch.column("first")), _lists(batch.column("last")), strict=True):
                gone = np.zeros(len(text) + 1, np.int32)
                np.add.at(gone, first, 1)
                np.add.at(gone, last + length, -1)
                lost = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~lost].tobytes()
                for k, v in zip(out, (int(lost.sum()), len(_runs(lost)[0]), kept), strict=True):
                    k.append(v)
            kinds = pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=[*more, "n_removed", "n_spans", "kept"])

    return rows.join(by_row, "row").select(*more, "text", "first", "last").mapInArrow(run, "doc_id long, n long, copies long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept (bytes) of every row of docs(doc_id, text).

    A byte goes if a string of `length` bytes around it also starts anywhere else, in the same text or another; strings
    are those of the input. Null texts are empty; texts shorter than `length` lose nothing; repeated rows are copies
    of each other, whatever their ids; other columns are left out; an empty table gives no rows. Texts may be of any
    length and periodic.
    """
    if length < 5 * STRIDE + GRAM - 3:  # so that every window holds two segments behind its anchor
        raise ValueError(f"length must be {5 * STRIDE + GRAM - 3} at least")
    rows = _signatures(docs, length)
    long = rows.where(F.col("n") >= length)
    named = F.when(F.col("places").isNotNull(), F.col("row"))
    classes = long.groupBy("key").agg(F.count("row").alias("copies"), F.min(named).alias("node"), F.count(named).alias("named"))
    classes = written(classes.where("copies > 1"))
    again = long.where("places is not null").select("row", "key").join(small_side(classes.where("named > 1")), "key").where("row != node").select("row")
    lead = rows.where("places is not null").join(small_side(written(again)), "row", "left_anti")  # one of each class, of whatever task
    more = ["b", "cover", "inner", "need"]
    suffixes = lead.select("row", F.posexplode("a").alias("i", "a"), *more).select("row", "i", "a", *(F.col(c)[F.col("i")].alias(c) for c in more))
    ranked, second, made = doubled(suffixes)
    told = written(_decided(lead, ranked, length))
    open_ = told.select("row", F.explode("open").alias("i"))
    asked = written(open_.join(second, ["row", "i"]).select("rank").distinct())
    wanted = second.join(small_side(asked), "rank", "left_semi").select("row", "i").join(told.select("row", F.explode("inner").alias("i")), ["row", "i"], "left_semi")
    chosen = written(wanted.groupBy("row").agg(F.collect_list("i").alias("chosen")))
    texts = rows.join(small_side(chosen.select("row")), "row", "left_semi").select("row", "text", "places").join(chosen, "row")
    stretches = written(_stretches(texts.select("row", "text", "places", "chosen"), length))
    discard(asked, *made)
    many = written(stretches.groupBy("gram").agg(F.sum(F.length("bytes")).alias("c")).where(F.col("c") > hot).select("gram"))
    if many.isEmpty():
        cover = written(_equal_in_task(stretches, length))
    else:
        few = small_side(many)
        cover = _equal_in_task(stretches.join(few, "gram", "left_anti"), length)
        cover = written(cover.union(_equal_by_rows(stretches.join(few, "gram", "left_semi"), length)))
    cover = written(cover.union(told.select("row", F.explode("done").alias("d")).select("row", "d.*")))
    discard(chosen, stretches, told)
    ids = small_side(written(cover.select("row").distinct()))
    all_ = rows.select("row", "doc_id", "n", "key", "sha", "text").join(small_side(classes.select("key", "copies")), "key", "left")
    copied = F.col("copies").isNotNull()
    lost = all_.where(~copied).join(ids, "row", "left_semi").select("row", "doc_id", "n", "copies", "text")
    cut = _cut(lost, cover, length).select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
    none = F.when(copied, F.lit(b"")).otherwise(F.col("text"))
    rest = all_.where(copied).unionByName(all_.where(~copied).join(ids, "row", "left_anti"))
    rest = rest.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(copied, hashlib.sha256(b"").hexdigest()).otherwise(F.col("sha")).alias("kept_sha256"),
        none.alias("kept"),
    )
    return cut.unionByName(rest).withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


def repeats_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, digest, size and text of what is kept, of every row of docs.

    The text is null where the bytes that are left aren't UTF-8, as cuts may fall into a character.
    """
    told = remove_repeats(docs, **options)
    text = F.try_validate_utf8(F.col("kept").cast("string")).alias("kept")
    return told.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", text)
