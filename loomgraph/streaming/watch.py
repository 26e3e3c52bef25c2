"""Watching a tree: new and changed files as a stream, a micro-batch for the time that changes are let gather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import walk

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
QUEUE = "path string, reason string, stamp long"


def changed(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """A stream of (path, stamp) of files below ``root`` that come or change, without skipped folders, ignored and binary files. Stamps are modification times in microseconds."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).load(root)
    rows = files.select(walk.relative(F.col("path"), root).alias("path"), F.unix_micros("modificationTime").alias("stamp"))
    return rows.where(~walk.unwanted(F.col("path"), patterns or []) & ~walk.denied(F.col("path")))


def watch(spark: SparkSession, root: str, queue: str, checkpoint: str, patterns: list[str] | None = None, debounce_ms: int = 750, once: bool = False):
    """A started query that appends every changed path to the ``queue`` folder (QUEUE), once per micro-batch however often it changed in it.

    Micro-batches are ``debounce_ms`` apart, which is the time that changes gather. A batch that is
    run again writes the same folder. What is deleted gives no event: an update of the
    tree finds it. ``once`` ends the query when all is read.
    """

    def keep(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max("stamp").alias("stamp")).select("path", F.lit("changed").alias("reason"), "stamp")
        latest.coalesce(1).write.mode("overwrite").parquet(f"{queue}/batch={number:010d}")

    writer = changed(spark, root, patterns).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()


def queued(spark: SparkSession, queue: str) -> DataFrame:
    """All requests in the folder; ``store.enqueue`` leaves the newest of each path."""
    return spark.read.schema(QUEUE).parquet(f"{queue}/batch=*")
