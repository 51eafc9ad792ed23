"""Written tables: where long jobs cut their lineage, so that lost executors cost a stage at most."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only on a local master, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later stages don't depend on executors that may go.

    The shuffle files of the write go when it has ended, as nothing reads them any more.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


#: Rows of a few narrow columns, or bytes by the plan's estimate, that may be broadcast.
FEW, FEW_BYTES = 200_000, 4 << 20


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if it is small, else joined by shuffling. Small is what its plan, whose tables have been written and so
    know their size, puts below FEW_BYTES; a larger estimate is settled by counting up to `most` rows."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= FEW_BYTES:
        return F.broadcast(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of written tables that nothing reads any more; other tables are left alone."""
    for df in frames:
        if df is not None and (path := _FOLDERS.pop(df, None)):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
