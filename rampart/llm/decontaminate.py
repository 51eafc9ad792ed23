"""Benchmark decontamination: hash sets of normalised benchmark windows are broadcast, documents scanned for them.

The benchmark is cut in slices by bytes of text. One slice at a time is gathered, sent to the tasks, and its hits are
written before the next slice is, so neither the driver nor a task ever holds more than `slice_bytes` of items; a larger
benchmark takes more passes over the documents instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.llm.common import WordHash, free_name, sliced, windows, written

WINDOW = 13
SLICE_BYTES = 32 << 20
CHUNK_WORDS = 100_000
#: What is found in a text: its words, runs of hit words (first word, words) that don't touch, and the items hit.
FOUND = "n_words int, runs array<struct<at:int,n:int>>, items array<string>"
#: Everything but digits, letters a-z and non-ASCII bytes separates words; A-Z count as a-z.
_PLAIN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def item_windows(items: list[tuple[str, bytes | None]], length: int) -> dict[int, dict[bytes, list[int]]]:
    """By window length: each window's words, and the indices of the items that have it."""
    out: dict[int, dict[bytes, list[int]]] = {}
    for i, (_, text) in enumerate(items):
        w = words(text)
        size = min(length, len(w))
        for at in range(len(w) - size + 1) if size else ():
            own = out.setdefault(size, {}).setdefault(b" ".join(w[at : at + size]), [])
            if not own or own[-1] != i:
                own.append(i)
    return out


def merged(places: list[tuple[int, int]]) -> list[dict]:
    """Runs of words from (first word, words), overlapping and touching ones joined."""
    out: list[dict] = []
    for at, n in sorted(places):
        if out and at <= out[-1]["at"] + out[-1]["n"]:
            out[-1]["n"] = max(out[-1]["n"], at + n - out[-1]["at"])
        else:
            out.append({"at": at, "n": n})
    return out


def _scan(texts: list[bytes | None], grams: dict, sorted_hashes: dict, seen: WordHash):
    """For each text: the number of words, runs of hit words, and indices of the items hit, each once."""
    chunk: list[list[bytes]] = []
    held = 0

    def flush():
        flat = [w for ws in chunk for w in ws]
        starts = np.cumsum([0, *map(len, chunk)])
        hashes = seen.of(flat)
        places: list[list[tuple[int, int]]] = [[] for _ in chunk]
        met: list[set[bytes]] = [set() for _ in chunk]
        items: list[set[int]] = [set() for _ in chunk]
        for length, own in sorted_hashes.items():
            got = windows(hashes, length)
            at = np.minimum(np.searchsorted(own, got), len(own) - 1)
            for p in np.flatnonzero(own[at] == got):
                d = int(np.searchsorted(starts, p, "right")) - 1
                if p + length <= starts[d + 1]:
                    gram = b" ".join(flat[p : p + length])
                    if gram in grams[length]:
                        places[d].append((int(p - starts[d]), length))
                        if gram not in met[d]:
                            met[d].add(gram)
                            items[d].update(grams[length][gram])
        for w, at, own in zip(chunk, places, items, strict=True):
            yield len(w), merged(at), own

    for text in texts:
        chunk.append(words(text))
        held += len(chunk[-1])
        if held >= CHUNK_WORDS:
            yield from flush()
            chunk, held = [], 0
    yield from flush()


def _slices(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> tuple[Iterator[list[tuple[str, bytes | None]]], int]:
    """Items as (id, text bytes), gathered slice by slice, and how many slices there are."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = int(total // most) + 1

    def each():
        for i in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
            got = part.toArrow()
            yield list(zip(got["id"].to_pylist(), got["text"].to_pylist(), strict=True))

    return each(), n


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    name: str = "hits",
) -> DataFrame:
    """docs with a struct column of FOUND, named `name` or with underscores before it if docs has such a column.

    Texts may be null or empty: no words, no hits. Repeated documents each keep their row; repeated items count by their
    ids, null ids as empty. One slice is scanned as docs are read; more slices write docs once, and then each its hits.
    """
    name, spark = free_name(docs, name), docs.sparkSession
    slices, n = _slices(benchmark, item_id, item_text, slice_bytes)
    if n == 1:
        return docs.mapInArrow(_finder(spark, next(slices), length, text_col, docs.columns, name), T.StructType([*docs.schema.fields, _found(name)]))
    row, each = free_name(docs, "row"), []
    base = written(docs.withColumn(row, F.monotonically_increasing_id()))
    for items in slices:
        own = base.select(row, text_col).mapInArrow(_finder(spark, items, length, text_col, [row], name), T.StructType([base.schema[row], _found(name)]))
        hit = own if not each else own.where(F.size(f"{name}.runs") > 0)
        each.append(written(hit))
    both = each[0]
    for more in each[1:]:
        both = both.unionByName(more)
    f = lambda c: F.flatten(F.collect_list(f"{name}.{c}"))
    joined = both.groupBy(row).agg(F.struct(F.max(f"{name}.n_words").alias("n_words"), _disjoint(f("runs")).alias("runs"), F.array_distinct(f("items")).alias("items")).cast(_found(name).dataType).alias(name))
    return base.join(joined, row).select(*(F.col(f"`{c}`") for c in docs.columns), name)


def _found(name: str) -> T.StructField:
    return T.StructField(name, T.StructType.fromDDL(FOUND))


def _disjoint(runs: Column) -> Column:
    """Runs (at, n) sorted, without what earlier ones cover: the longest of those that start together counts."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        at, end = F.greatest(r["at"], acc["end"]), F.greatest(r["at"] + r["n"], acc["end"])
        more = F.when(end > at, F.concat(acc["out"], F.array(F.struct(at.alias("at"), (end - at).alias("n"))))).otherwise(acc["out"])
        return F.struct(end.alias("end"), more.alias("out"))

    return F.aggregate(F.array_sort(runs), start, step, lambda acc: acc["out"])


def _finder(spark, items, length, text_col, columns, name):
    sent = spark.sparkContext.broadcast((item_windows(items, length), [k for k, _ in items]))
    kind = pa.struct([("n_words", pa.int32()), ("runs", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ids = sent.value
        seen = WordHash()
        own = {n: np.unique(windows(seen.of(sum((g.split(b" ") for g in by), [])), n)[::n]) for n, by in grams.items()}
        for batch in sliced(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            found = [{"n_words": n, "runs": runs, "items": list({ids[i] for i in items})} for n, runs, items in _scan(texts, grams, own, seen)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, kind)], names=[*columns, name])

    return run


def judge(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "judged", **options) -> DataFrame:
    """docs with a struct column: n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: at least one word is hit, and at least one in twenty. A null text has no words and is clean.
    """
    found = free_name(docs, "found")
    f = lambda c: F.col(f"{found}.{c}")
    n_hit = F.aggregate(f("runs"), F.lit(0).cast("long"), lambda a, r: a + r["n"])
    told = find_hits(docs, benchmark, text_col, name=found, **options).withColumn(
        name,
        F.struct(
            f("n_words").cast("long").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(f("items")).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(f("items")), ",").cast("binary"), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= f("n_words"))).alias("contaminated"),
        ),
    )
    return told.drop(found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    name = free_name(docs, "judged")
    kept = judge(docs, benchmark, text_col, name, **options)
    return kept.where(~F.col(f"{name}.contaminated")).select(*(F.col(f"`{c}`") for c in docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents; in their texts each run of hit words, with what stands between them, becomes one space."""
    name = free_name(docs, "found")
    hit = find_hits(docs, benchmark, text_col, name=name, **options)

    def run(batches):
        for batch in sliced(batches, text_col):
            texts = []
            for text, found in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column(name).to_pylist(), strict=True):
                texts.append(cut(text, found["runs"]) if found["runs"] else text)
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            names = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in names], names=names)

    return hit.mapInArrow(run, docs.schema)


def cut(text: bytes, hits: list[dict]) -> bytes:
    """text without its hit words."""
    plain = np.frombuffer(text.translate(_PLAIN), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], plain.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for first, last in sorted((int(starts[h["at"]]), int(ends[h["at"] + h["n"] - 1])) for h in hits):
        if first >= at:
            out.append(text[at:first])
        at = max(at, last)
    return b" ".join([*out, text[at:]]) if out else text[at:]


def decontamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each row of docs."""
    own = docs.select("doc_id", "text")
    return judge(own, benchmark, name="judged", **options).select("doc_id", "judged.*")
