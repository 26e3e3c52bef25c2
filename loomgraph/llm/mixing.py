"""Mixing sources to target weights with DataFrame functions only.

Tokens are summed per source, a repetition rate per source follows from the
targets, and every document is taken floor(rate) times plus one more time with
the fraction as probability, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.skew import numbered
from loomgraph.storage import stash

#: Up to so many sources, or repeated ids, a table of them is broadcast; beyond, it is joined by a shuffle that AQE may split.
BROADCAST_SOURCES, BROADCAST_IDS = 10_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone; a null key counts as the word null."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the
    sum of all sizes. A target stops at ``most`` times its source's size; what is
    over is shared again by weight. The end of that resharing is a level L with
    target = min(cap, weight * L): sources fill up in the order of cap / weight, so L
    follows from running sums over one row per source. These sums, and the order of the
    sources, use one task; it sees a name and a number per source, 100 MB for 10**6 of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, here_on, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on))
    # the level of the first source that does not fill holds for it and all behind it; it is the largest of theirs
    per = per.withColumn("open", F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(every))
    return per.select("source", "source_size", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("open"))).alias("target"))


def with_keys(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, ...) with ``key``, what their draws go by; ``ids`` is their doc_id column alone.

    The key is the doc_id where it stands once. Rows with a null or repeated doc_id are told
    apart by their text's hash, and equal ones by a number, so that each has a draw of its own.
    """
    repeated = stash(ids.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is null or rows > 1").select(F.col("doc_id").alias("__id")), "repeated")
    some = repeated.limit(BROADCAST_IDS + 1).count()
    if not some:
        return rows.withColumn("key", F.col("doc_id").cast("string"))
    if some <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    again = rows.where("doc_id is null").unionByName(rows.join(repeated, rows["doc_id"] == F.col("__id"), "left_semi"))
    once = rows.where("doc_id is not null").join(repeated, rows["doc_id"] == F.col("__id"), "left_anti")
    counted = numbered(again, [F.col("doc_id"), F.col("text_hash")], "__turn")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_hash").cast("string"), F.col("__turn").cast("string"))
    return once.withColumn("key", F.col("doc_id").cast("string")).unionByName(counted.withColumn("key", key).drop("__turn"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, copies, source) for every row of ``docs``.

    Size is the number of words of the text. Null and empty texts have size 0; a null
    source is a source of its own, behind all others, and so is the empty name. Rows with
    a null or repeated doc_id each draw for themselves. A source without words has target 0
    and rate 0. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash")), "sizes")
    return _copies(sized, with_keys(sized, sized.select("doc_id")), weights, most, seed).select("doc_id", "size", "source_size", "target", "copies", "source")


def _copies(sized: DataFrame, rows: DataFrame, weights: tuple[float, ...], most: float, seed: str) -> DataFrame:
    """``rows`` with source_size, target and copies; ``sized`` has the source and size of each."""
    rates = stash(targets(sized, weights, most), "rates")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    joined = rows.join(rates.withColumnRenamed("source", "__source"), rows["source"].eqNullSafe(F.col("__source")), "left").drop("__source")
    whole = F.floor(rate)
    return joined.withColumn("copies", whole + F.when(draw(F.col("key"), seed) < rate - whole, 1).otherwise(0))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, each as often as the mixture takes it; nulls, repeats and empty tables as in ``mixture``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    sized = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _copies(sized, with_keys(packed, ids), weights, most, seed)
    return taken.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
