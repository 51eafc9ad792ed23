"""What the corpus operators share: reading tables, cutting lineage, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.storage import discard, shared_dir, written  # noqa: F401  the operators take them from here

#: Bytes of text that a Python worker looks at in one go, so that long texts don't pile up; a longer text goes alone.
BATCH_BYTES = 4 << 20
#: Rows of ids and keys, of 64 bytes at most each, that may be broadcast.
SMALL_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of `most` bytes of a text column, or of one row where that is longer. Empty batches go."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few narrow columns, to be broadcast if it has at most `most` rows, else joined by shuffling."""
    return F.broadcast(df) if df.count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it if df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


class WordHash(dict):
    """64-bit hashes of words, remembered; forgets all when it holds too many."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of `length` consecutive words, by position."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] + np.uint64(length)
    for i in range(1, length):
        out *= _STEP
        out += hashes[i : i + n]
    out ^= out >> np.uint64(33)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def text_bytes(name: str):
    """The text column as UTF-8 bytes, null kept."""
    return F.col(f"`{name}`").cast("string").cast("binary")
