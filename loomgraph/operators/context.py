"""What is gathered for a task: direct hits, their neighbours and their tests as candidates of one ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph, search
from loomgraph.storage import settle

#: Seeds whose neighbours are taken in, neighbours a side, and related tests a file. Fixed values.
SEEDS, FANOUT, TESTS = 30, 10, 10


def direct_hits(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, qualified_name, id, signal) for hits(path, qualified_name, score): the symbol that each names."""
    signal = settle(hits.select("path", "qualified_name", F.col("score").alias("signal")), "hits")
    return settle(search.symbols_for_refs(signal.select("path", "qualified_name"), symbols, files).join(signal, ["path", "qualified_name"]), "direct")


def candidates(direct: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame | graph.Adjacency | None, related: DataFrame | None, max_files: int = 10) -> DataFrame:
    """(id, class, path, qualified_name, signal, name, stable_key): the direct hits, callers and callees of the first SEEDS of them over ``edges``, and related(path, symbol, score) tests.

    Signals are over the largest of their own class, as lists of different origin have different scales.
    """
    every = direct.select(F.lit("direct").alias("class"), "path", "qualified_name", "id", "signal")
    if edges is not None:
        seeds = direct.orderBy(F.desc("signal"), "path", "qualified_name").limit(SEEDS)
        near = graph.seed_neighbours(edges, seeds, symbols, FANOUT).select(F.col("side").alias("class"), "id").distinct()
        placed = near.join(symbols.select("id", "file_id", "qualified_name"), "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        every = every.unionByName(placed.select("class", "path", "qualified_name", "id", F.lit(1.0).alias("signal")))
    if related is not None:
        first = related.orderBy(F.desc("score"), "path", "symbol").limit(TESTS * max(1, max_files))
        tests = first.groupBy("path", F.col("symbol").alias("qualified_name")).agg(F.max("score").alias("signal"))
        ids = search.symbols_for_refs(tests.select("path", "qualified_name"), symbols, files)
        every = every.unionByName(tests.join(ids, ["path", "qualified_name"], "left").select(F.lit("test").alias("class"), "path", "qualified_name", "id", "signal"))
    every = settle(every, "candidates")
    top = every.groupBy("class").agg(F.max("signal").alias("top"))  # a row per class
    scaled = every.join(F.broadcast(top), "class").withColumn("signal", F.when(F.col("top") > 0, F.col("signal") / F.col("top")).otherwise(F.col("signal"))).drop("top")
    return scaled.join(symbols.select("id", "name", "stable_key"), "id", "left")
