"""Symbols at a level of detail: card, skeleton with members, excerpt and full with source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Members listed of a container, containers of a page that get a list, lines around a symbol, and the most lines at either level. Fixed values.
MEMBERS, CONTAINERS, CONTEXT, EXCERPT, FULL = 40, 200, 3, 60, 1200
LEVELS = ("card", "skeleton", "excerpt", "full")
CONTAINER_KINDS = ("class", "type", "struct", "interface", "enum", "object", "protocol", "actor", "trait")


def level(raw: str | None, default: str = "card") -> str:
    """The level of an argument; ValueError for a word that is none."""
    raw = (raw or "").strip() or default
    if raw not in LEVELS:
        raise ValueError(f"invalid detail {raw!r}: one of {', '.join(LEVELS)}")
    return raw


def skeletons(wanted: DataFrame, symbols: DataFrame, most: int | None = CONTAINERS) -> DataFrame:
    """(id, member_count, members) of the first ``most`` containers of ``wanted`` (a page, by id), or of all: the first MEMBERS symbols inside their lines, in the order of lines.

    Members are in the same file, within the container's lines and not the container itself.
    """
    page = wanted.where(F.col("kind").isin(*CONTAINER_KINDS))
    page = (page if most is None else page.orderBy("id").limit(most)).select("id", "file_id", "start_line", "end_line")
    inside = symbols.select(F.col("id").alias("m_id"), "file_id", F.col("start_line").alias("m_start"), F.col("end_line").alias("m_end"), "name", "kind")
    held = page.join(inside, "file_id").where("m_start >= start_line and m_end <= end_line and m_id <> id")
    turn = held.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("m_start", "m_id")))
    listed = F.sort_array(F.collect_list(F.when(F.col("turn") <= MEMBERS, F.struct("turn", F.concat_ws(" ", "kind", "name").alias("m")))))
    found = turn.groupBy("id").agg(F.count("*").alias("member_count"), F.transform(listed, lambda x: x["m"]).alias("members"))
    return page.select("id").join(found, "id", "left").select("id", F.coalesce("member_count", F.lit(0)).alias("member_count"), F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def source_windows(symbols: DataFrame, contents: DataFrame, at: str = "excerpt") -> DataFrame:
    """(id, from_line, to_line, text, truncated) for symbols(id, file_id, start_line, end_line) and contents(file_id, content).

    CONTEXT lines on either side, within EXCERPT or FULL lines; truncated if the symbol
    ends behind the file or lines were cut. Empty files, files without content and symbols that
    begin behind the end of the file have null lines. Line ends may be CR LF.
    """
    most = EXCERPT if level(at) == "excerpt" else FULL
    lines = F.split(F.regexp_replace(F.regexp_replace("content", "\r(?=\n|$)", ""), "\n\\z", ""), "\n", -1)
    rows = symbols.select("id", "file_id", F.greatest("start_line", F.lit(1)).alias("a"), "end_line").join(contents.select("file_id", "content"), "file_id", "left")
    rows = rows.withColumn("lines", F.when(F.col("content") != "", lines)).withColumn("total", F.size("lines"))
    rows = rows.withColumn("b", F.greatest("a", "end_line")).withColumn("seen", (F.col("total") > 0) & (F.col("a") <= F.col("total")))
    begin = F.greatest(F.lit(1), F.col("a") - CONTEXT)
    end = F.least(F.col("total"), F.least("b", "total") + CONTEXT)
    rows = rows.withColumn("from_line", F.when(F.col("seen"), begin).cast("int")).withColumn("uncut", F.when(F.col("seen"), end).cast("int"))
    rows = rows.withColumn("to_line", F.least("uncut", F.col("from_line") + most - 1))
    window = F.array_join(F.slice("lines", F.col("from_line"), F.col("to_line") - F.col("from_line") + 1), "\n")
    truncated = F.when(F.col("seen"), (F.col("b") > F.col("total")) | (F.col("to_line") < F.col("uncut")))
    return rows.select("id", "from_line", "to_line", F.when(F.col("seen"), window).alias("text"), truncated.alias("truncated"))


def drifted(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """(path, drifted) for indexed(path, size, mtime, sha256) and now(path, size, mtime, sha256).

    A file has changed if its size has; else, if its time has and a digest was kept, by the digest.
    """
    n = now.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.col("sha256").alias("n_sha256"))
    by_time = (F.col("mtime") != 0) & (F.col("mtime") != F.col("n_mtime")) & (F.col("sha256") != "") & (F.col("sha256") != F.col("n_sha256"))
    return indexed.join(n, "path").select("path", F.coalesce((F.col("size") != F.col("n_size")) | by_time, F.lit(False)).alias("drifted"))
