"""Trends kept by repository as a stream, against the batch trend: replay, restart, late and repeated events, silence."""

import random

from pyspark.sql import functions as F

from rampart.operators import history
from rampart.streaming import running

KIND = "repo string, commit_sha string, ts timestamp, score double"


def snapshots(spark, rows):
    return spark.createDataFrame(rows, "repo string, commit_sha string, ts string, score double").withColumn("ts", F.col("ts").cast("timestamp"))


def same(spark, got, rows, window):
    batch = snapshots(spark, [r for r in rows if None not in r]).withColumnRenamed("ts", "day")
    latest = batch.groupBy("repo", "commit_sha").agg(F.max_by(F.struct("day", "score"), "day").alias("r")).select("repo", "commit_sha", "r.*")
    want = {r.repo: (r.newest, r.oldest, r.delta, r.direction) for r in history.trend(latest, window).collect()}
    assert {r.repo: (r.newest, r.oldest, r.delta, r.direction) for r in got} == want


def test_trends_equal_the_batch_trend(spark, tmp_path):
    rng, rows, n = random.Random(4), [], 0
    source, work = str(tmp_path / "in"), f"file://{tmp_path}/work"
    follow = lambda: running.keep_trends(spark.readStream.schema(KIND).parquet(source), work, window=3).collect()
    for batch in range(3):
        new = [(f"r{rng.randrange(4)}", f"c{n + i}", f"2026-01-{rng.randrange(1, 28):02d} 0{rng.randrange(10)}:00:00", float(rng.choice((0, 50, 51, 60, 80)))) for i in range(8)]
        n += 8
        if batch:
            new += [rows[-1], ("r1", f"late{batch}", "2026-01-01 00:30:00", 90.0), (None, "x", "2026-01-05", 1.0), ("r2", f"none{batch}", None, 1.0)]
        rows += new
        snapshots(spark, new).write.mode("append").parquet(source)
        same(spark, follow(), rows, 3)
    again = follow()  # nothing new: a restart from the checkpoint
    same(spark, again, rows, 3)
    assert all(r.n_seen >= 3 for r in again)


def test_a_silent_repository_is_told_once(spark, tmp_path):
    source, work = str(tmp_path / "in"), f"file://{tmp_path}/work"
    follow = lambda: {r.repo: r.silent for r in running.keep_trends(spark.readStream.schema(KIND).parquet(source), work, silence="7 days", late="1 hours").collect()}
    snapshots(spark, [("quiet", "a", "2026-01-01 00:00:00", 70.0), ("busy", "b", "2026-01-01 00:00:00", 70.0)]).write.mode("append").parquet(source)
    assert follow() == {"quiet": False, "busy": False}
    snapshots(spark, [("busy", "c", "2026-01-20 00:00:00", 75.0)]).write.mode("append").parquet(source)
    assert follow() == {"quiet": True, "busy": False}
    snapshots(spark, [("quiet", "d", "2026-01-21 00:00:00", 90.0)]).write.mode("append").parquet(source)
    assert follow() == {"quiet": False, "busy": False}
