"""Webhook events: parsing, routing, and the stream that keeps snapshots."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.functions import columns as C

ACTIONS = ("opened", "synchronize", "reopened")
PAYLOAD = """after string, ref string, action string, number int, repository struct<full_name:string,clone_url:string>,
commits array<struct<id:string,added:array<string>,modified:array<string>,removed:array<string>>>, head_commit struct<id:string>,
pull_request struct<head:struct<sha:string,ref:string>>"""


def signed(body: bytes, signature: str | None, secret: str) -> bool:
    """Whether a body carries the right signature; without a secret nothing does."""
    if not secret or not signature:
        return False
    own = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return hmac.compare_digest(own, signature)


def route(events: DataFrame) -> DataFrame:
    """Pushes and pull requests to analyse, of events(id, kind, payload: JSON); the others and broken ones are left out."""
    e = events.select("id", "kind", F.from_json("payload", PAYLOAD).alias("p")).select("id", "kind", "p.*")
    sha = F.when(F.col("kind") == "push", F.coalesce(F.nullif("after", F.lit("")), "head_commit.id", F.try_element_at("commits", F.lit(-1))["id"])).otherwise(F.col("pull_request.head.sha"))
    paths = F.transform("commits", lambda c: F.concat(*(F.coalesce(c[k], F.array().cast("array<string>")) for k in ("added", "modified", "removed"))))
    files = F.when(F.col("kind") == "push", F.sort_array(F.array_distinct(F.flatten(paths)))).otherwise(F.array().cast("array<string>"))
    branch = F.when(F.col("kind") == "push", F.replace("ref", F.lit("refs/heads/"), F.lit(""))).otherwise(F.col("pull_request.head.ref"))
    out = e.select(
        "id", "kind", sha.alias("sha"), F.col("repository.full_name").alias("repo"), branch.alias("branch"), files.alias("files"), "number",
        F.when(F.col("kind") == "push", C.security_relevant(files)).otherwise(True).alias("relevant"), "action", F.size("commits").alias("n_commits"),
    )
    push = (F.col("kind") == "push") & (F.col("n_commits") > 0)
    pull = (F.col("kind") == "pull_request") & F.col("action").isin(*ACTIONS)
    real = F.col("sha").isNotNull() & (F.col("sha") != "") & (F.col("sha") != "0" * 40)
    return out.where((push | pull) & real).drop("n_commits", "action")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files: one file, or the part files of a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def hourly(events: DataFrame) -> DataFrame:
    """repo, start, n, users by hour, for batches and streams alike; late events up to a day count."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    grouped = own.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("repo"))
    return grouped.agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors")).select("repo", F.col("w.start").alias("start"), "n", "errors")


def quarantined(events: DataFrame, secret: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of events(id, kind, payload[, body, signature]): bad ones have no readable payload, or, with a secret, a
    signature that isn't the body's; bad has a reason."""
    whole = F.try_parse_json("payload")
    reason = F.when(whole.isNull(), "bad payload")
    if secret is not None:
        key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
        inner, outer = (F.lit(bytearray(b ^ x for b in key.ljust(64, b"\0"))) for x in (0x36, 0x5C))
        own = F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.col("body").cast("binary")), 256))), 256))
        reason = F.when(F.coalesce(own != F.col("signature"), F.lit(True)) | F.lit(not secret), "bad signature").otherwise(reason)
    told = events.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream has had so far: what is new since the last call with this folder is written batch by batch, and all
    is read back. The folder holds the stream's checkpoint, so a call goes on where the last one ended or failed.

    A replayed batch overwrites its own folder, so processing is idempotent. Without any events there are no rows.
    """

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/out")
    newest = rows.groupBy("repo", "start").agg(F.max_by(F.struct("n", "errors"), "batch").alias("last"))
    return newest.select("repo", "start", "last.n", "last.errors")
