"""Commits as a stream: each micro-batch of routed webhooks brings the stored graph to its next versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.buckets import Buckets
from rampart.operators import stored

#: Commits that a micro-batch may hold; maxFilesPerTrigger of the source keeps it below that.
MOST_COMMITS = 10_000


def follow(pushes: DataFrame, store: Buckets, state: str, rebuild: Callable[[str, DataFrame], tuple], tell: Callable[[DataFrame], None] | None = None, keep: int = 2) -> None:
    """Analyse all commits that a stream pushes(sha, repo, files, ts) has now, in order of time.

    Each commit is put into the store under its place in the stream, so one that was analysed before its batch failed is
    passed over when the batch runs again. rebuild(sha, paths) gives the graph and the imports of the affected files after
    the commit; tell gets a commit's diff once it is visible, at least once. state holds the stream's checkpoint; of older
    versions of the store, `keep` stay. Commits that touch one file follow each other, so the driver walks over the commits.
    """

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        for place, row in enumerate(df.orderBy("ts", "sha").collect()):
            changed = spark.createDataFrame([(p,) for p in row.files], "path string")
            diff = stored.commit(store, row.sha, str(row.ts), row.repo, changed, lambda paths, sha=row.sha: rebuild(sha, paths), batch * MOST_COMMITS + place)
            if diff is not None and tell:
                tell(diff)
        store.vacuum(keep)

    q = pushes.where(F.size("files") > 0).writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
