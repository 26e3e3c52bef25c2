"""Session memory and incremental updates over Structured Streaming."""

from __future__ import annotations

import secrets
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.walk import upsert


def history(events: DataFrame, session_id=None, event_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, then by descending id."""
    if session_id is not None:
        events = events.where(F.col("session_id") == session_id)
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    ordered = events.orderBy(F.desc("created_at"), F.desc("id"))
    return (ordered.offset(max(0, offset)) if offset > 0 else ordered).limit(50 if limit <= 0 else min(limit, 2000))


def hot_keys(events: DataFrame, kinds: tuple[str, ...] = ("read", "edit"), session_id=None, limit: int = 20) -> DataFrame:
    """(key, n, last): keys by how often, then by name."""
    if session_id is not None:
        events = events.where(F.col("session_id") == session_id)
    counted = events.where(F.col("event_type").isin(*kinds)).groupBy("key").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    return counted.orderBy(F.desc("n"), "key").limit(limit)


def context(events: DataFrame, session_id=None, kinds: tuple[str, ...] = ("decision", "fact", "task"), last: int = 10, used: tuple[str, ...] = ("read", "edit")) -> DataFrame:
    """(event_type, id, key) of the last events of each kind, and of the files used most: hot_file, how often, path."""
    out = None
    for kind in kinds:
        part = history(events, session_id, kind, last).select("event_type", "id", "key")
        out = part if out is None else out.unionByName(part)
    hot = hot_keys(events, used, session_id, last).select(F.lit("hot_file").alias("event_type"), F.col("n").alias("id"), "key")
    return out.unionByName(hot)


def session_table(events: DataFrame) -> DataFrame:
    """The driver's events as session events; the key is the number in props."""
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), "event_type", F.get_json_object("props", "$.k").alias("key"), F.col("ts").alias("created_at"))


def count_stream(spark: SparkSession, folder: str, schema, checkpoint: str, out: str):
    """Events of a folder counted by type in ten-minute windows, late ones within an hour; a started query that ends when all is read."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "1 hour")
    counted = events.groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count("*").alias("n"))
    flat = counted.select(F.col("window.start").alias("start"), "event_type", "n")
    return flat.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def apply_changes(spark: SparkSession, folder: str, schema, checkpoint: str, table: str):
    """Every micro-batch of changed rows (path, ...) replaces the rows of its paths in a snapshot table of numbered folders.

    The snapshot's number is the batch's, so a batch that is run again writes the same
    folder; readers take the newest whole one.
    """
    reader = spark.readStream.schema(schema).parquet(folder)

    def merge(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "stamp").alias("r")).select("r.*")
        before = newest(spark, table, schema, number)
        upsert(before, latest, "path").write.mode("overwrite").parquet(f"{table}/snapshot={number:010d}")

    return reader.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, table: str, schema, below: int | None = None) -> DataFrame:
    """The newest whole snapshot, or an empty table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("snapshot=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                number = int(name.split("=")[1])
                if below is None or number < below:
                    found.append(number)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{table}/snapshot={max(found):010d}")


def pending(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Dirty paths still to do from queue(path, stamp) and done(path, stamp): the newest request of a path, unless it was done at that stamp or later."""
    latest = queue.groupBy("path").agg(F.max("stamp").alias("stamp"))
    finished = done.groupBy("path").agg(F.max("stamp").alias("finished"))
    return latest.join(finished, "path", "left").where("finished is null or finished < stamp").select("path", "stamp")


LOG = "id long, session_id string, event_type string, key string, value string, metadata string, created_at timestamp"


def log(spark: SparkSession, folder: str, event_type: str, key: str = "", value: str = "", metadata: str = "{}", session_id: str = "") -> None:
    """Append one event. Ids are microseconds with ten random bits behind, so later events have larger ones and those of two drivers differ."""
    now = datetime.now(UTC)
    row = ((int(now.timestamp() * 1e6) << 10) + secrets.randbelow(1 << 10), session_id, event_type, key, value, metadata, now.replace(microsecond=0))
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(folder)
