"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A stashed table cuts lineage: it is plain Parquet that every executor can
read, so a lost executor costs at most the tasks that were running on it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        found = _own[app]
    return found.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex[:12]}-{label}"
    _made[path] = (spark, path)
    return path


def stash(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it."""
    path = work_dir(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str, most: int = 10_000) -> DataFrame:
    """``df`` as rows that are there: up to ``most`` are kept by the driver and marked for broadcast, more are stashed."""
    found = df.limit(most + 1).toArrow()
    if found.num_rows > most:
        return stash(df, label)
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema) if found.num_rows else df.sparkSession.createDataFrame([], df.schema))


def stash_by(df: DataFrame, label: str, column: str) -> DataFrame:
    """As ``stash``, in as many buckets by ``column`` as shuffles have partitions, so that joins and sums by it need not move the rows again."""
    spark = df.sparkSession
    name = f"loomgraph_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", work_dir(spark, label)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


@atexit.register
def _clean() -> None:
    for spark, path in list(_made.values()):
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        except Exception:  # the session may have ended before the interpreter
            pass
