"""Joins and numbers that no single key can burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import stash

#: A key with more rows than this is hot; of n rows at most n / HOT keys are.
HOT = 100_000
#: Rows that are numbered in one group, about.
GROUP = 8192


def hot_keys(rows: DataFrame, key: str, least: int = HOT) -> DataFrame | None:
    """The keys of more than ``least`` rows as a written table; None if there are none. Null is no key."""
    found = stash(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows")).where(F.col("rows") > least).select("key"), "hot")
    return None if found.isEmpty() else found


def join_on(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``one``, which has a row per ``key``.

    Rows with a hot key find their match in a broadcast of the hot keys' rows alone, a
    row for each of at most n / HOT keys; the others are joined by a merge. Rows with a null
    key have no match and take no part in the shuffle.
    """
    lone = None
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema if f.name != key]
        lone = rows.where(F.col(key).isNull()).select("*", *missing)
    rows = rows.where(F.col(key).isNotNull())
    if hot is None:
        out = rows.hint("merge").join(one.hint("merge"), key, how)
    else:
        hot = F.broadcast(hot.withColumnRenamed("key", key))
        cold = rows.join(hot, key, "left_anti").hint("merge").join(one.hint("merge"), key, how)
        out = cold.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key, how))
    return out if lone is None else out.unionByName(lone)


def numbered(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``rows`` with a number 0, 1, ... among the rows that agree in ``by`` (null agrees with null).

    Which of them has which number is left open, but every number is given once. Groups are
    numbered in parts of about GROUP, behind which the counts of the parts before are put.
    """
    kept = stash(rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__by", F.xxhash64(*by)), "numbered")
    most = kept.groupBy("__by").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // GROUP))
    salted = kept.withColumn("__part", F.pmod(F.xxhash64("__at"), F.lit(parts)))
    counts = stash(salted.groupBy("__by", "__part").count(), "parts")
    before = counts.select("__by", "__part", F.coalesce(F.sum("count").over(Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = salted.withColumn("__inside", F.row_number().over(Window.partitionBy("__by", "__part").orderBy("__at")) - 1)
    return inside.join(before, ["__by", "__part"]).withColumn(name, F.col("__inside") + F.col("__before")).drop("__by", "__part", "__at", "__inside", "__before")
