"""Looking after written tables: small files into large ones, and a check of an index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import store
from loomgraph.plans.ingest import Index
from loomgraph.storage import work_dir


def _size(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) below a path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    summary = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(target)
    return summary.getFileCount(), summary.getLength()


def compact(spark: SparkSession, path: str, target_bytes: int = 128 << 20, order: list[str] | None = None) -> tuple[str, dict]:
    """A copy of a Parquet table in files of about ``target_bytes``, in ranges of ``order`` if given; its path and the sizes before and after. The old table stays until the caller drops it."""
    files, size = _size(spark, path)
    parts = max(1, math.ceil(size / target_bytes))
    table = spark.read.parquet(path)
    table = table.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else table.repartition(parts)
    out = work_dir(spark, "compact")
    table.write.option("compression", "zstd").parquet(out)
    after, smaller = _size(spark, out)
    return out, {"files": files, "bytes": size, "files_after": after, "bytes_after": smaller}


def doctor(g: Index) -> DataFrame:
    """(check, status, n): whether an index has what queries need and holds together. status is ok, warning or error."""
    ids = g.symbols.select("id")
    duplicated = g.symbols.groupBy("id").count().where("count > 1")
    orphans = g.symbols.join(store.live(g.files).select(F.col("id").alias("file_id")), "file_id", "left_anti")
    lost = g.calls.where("dst is not null").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    adrift = g.calls.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    checks = [
        ("no files", g.files.limit(1).groupBy().count().select((1 - F.col("count")).alias("n")), "error"), ("symbols with the same id", duplicated.groupBy().agg(F.count("*").alias("n")), "error"), ("symbols of files that are not there", orphans.groupBy().agg(F.count("*").alias("n")), "error"),
        ("calls to symbols that are not there", lost.groupBy().agg(F.count("*").alias("n")), "error"), ("calls from symbols that are not there", adrift.groupBy().agg(F.count("*").alias("n")), "error"), ("files that could not be parsed", g.files.where("parse_state = 'parse_failed'").groupBy().agg(F.count("*").alias("n")), "warning"),
    ]
    out = None
    for name, counted, bad in checks:
        one = counted.select(F.lit(name).alias("check"), F.when(F.col("n") > 0, bad).otherwise("ok").alias("status"), F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
