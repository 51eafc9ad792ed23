"""Keyed state by repository: the trend of its newest snapshots, kept as a stream, and a word on those that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "repo string, n_seen long, newest double, oldest double, delta double, direction string, silent boolean, last timestamp"
_FIELD = T.StructField
_COMMIT = T.StructType([_FIELD("commit_sha", T.StringType())])
_SNAPSHOT = T.StructType([_FIELD("ts", T.TimestampType()), _FIELD("score", T.DoubleType())])
_SEEN = T.StructType([_FIELD("n", T.LongType()), _FIELD("due", T.LongType())])
#: Points either way that count as stable.
STABLE = 2.0


def trend_row(repo: str, seen: int, kept: list[tuple[datetime, str, float]], silent: bool) -> Row:
    """What a repository's newest snapshots (ts, sha, score), newest first, say; as `history.trend` does for a table."""
    newest, oldest = kept[0][2], kept[-1][2] or kept[0][2]
    delta = float(f"{newest - oldest:.1f}")
    direction = "improving" if delta > STABLE else "degrading" if delta < -STABLE else "stable"
    return Row(repo=repo, n_seen=seen, newest=newest, oldest=oldest, delta=delta, direction=direction, silent=silent, last=kept[0][0])


class _Trend(StatefulProcessor):
    """State of a repository: its `window` newest snapshots by commit, how many it has had, and a timer for its silence."""

    def __init__(self, window: int, silence_ms: int):
        self.window, self.silence_ms = window, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getMapState("newest", _COMMIT, _SNAPSHOT)
        self.seen = handle.getValueState("seen", _SEEN)

    def _kept(self) -> list[tuple[datetime, str, float]]:
        own = [(v[0], k[0], v[1]) for k, v in self.newest.iterator()]
        return sorted(sorted(own, key=lambda r: r[1]), key=lambda r: r[0], reverse=True)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, due = self.seen.get() if self.seen.exists() else (0, 0)
        for r in rows:
            n += not self.newest.containsKey((r.commit_sha,))
            self.newest.updateValue((r.commit_sha,), (r.ts, r.score))
        kept = self._kept()
        for _, sha, _ in kept[self.window :]:
            self.newest.removeKey((sha,))
        kept = kept[: self.window]
        then = int(kept[0][0].replace(tzinfo=kept[0][0].tzinfo or timezone.utc).timestamp() * 1000) + self.silence_ms
        if then != due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(then)
        self.seen.update((n, then))
        yield trend_row(key[0], n, kept, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, _ = self.seen.get()
        self.seen.update((n, 0))
        yield trend_row(key[0], n, self._kept()[: self.window], True)

    def close(self) -> None:
        pass


def trends(snapshots: DataFrame, window: int = 10, silence: str = "7 days", late: str = "30 days") -> DataFrame:
    """The changing trends of a stream of snapshots(repo, commit_sha, ts, score); a row for each repository that a batch touches.

    A snapshot that comes late, by up to `late` after the newest of all, counts as if it had come in time; one that comes
    again under its commit replaces itself as long as it is among the newest. A repository without a snapshot for `silence`,
    by the time of the others, is told once more with silent = true. Rows without a repository, time, commit or score are
    left out. A repository's state holds `window` snapshots.
    """
    whole = snapshots.select("repo", "commit_sha", F.col("ts").cast("timestamp").alias("ts"), F.col("score").cast("double").alias("score")).dropna()
    return whole.withWatermark("ts", late).groupBy("repo").transformWithState(_Trend(window, _ms(silence)), T.StructType.fromDDL(OUT), "Update", "EventTime")


def _ms(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def keep_trends(snapshots: DataFrame, folder: str, **more) -> DataFrame:
    """The newest trend of each repository after all that the stream has had so far.

    The folder holds the checkpoint with the state, and what each batch said; a batch that runs again overwrites its own.
    """
    spark: SparkSession = snapshots.sparkSession

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the store that keyed state of this kind needs; a query holds on to it
    try:
        q = trends(snapshots, **more).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    spark.createDataFrame([], OUT).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    rows = spark.read.schema(f"{OUT}, batch int").parquet(f"{folder}/out")
    columns = [f.name for f in T.StructType.fromDDL(OUT)]
    last = rows.groupBy("repo").agg(F.max_by(F.struct(*columns), F.struct("batch", "silent")).alias("r"))
    return last.select("r.*")
