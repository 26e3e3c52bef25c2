"""Source trees as DataFrames: walking, filters by path, and what a scan decides for each file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text

#: Folders that are never walked, and extensions of binary files. Fixed values.
SKIPPED_FOLDERS = ["node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv"]
DENIED = "png jpg jpeg gif bmp ico webp svg mp3 mp4 avi mov wav ogg flac zip tar gz bz2 xz 7z rar jar war class exe dll so dylib a o obj bin dat db sqlite pdf doc docx xls xlsx ppt pptx woff woff2 ttf eot otf pyc pyo wasm lock".split()


def denied(path: Column) -> Column:
    return text.extension(path).isin(*DENIED)


def glob_regex(pattern: str) -> str:
    """* and ? within a path segment, sets as they are."""
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, c if c in "[]-" else re.escape(c)) for c in pattern)
    return f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches excludes: ! negates, a final /** is a plain prefix, others are globs on the path or its last part."""
    out = F.lit(False)
    name = F.substring_index(path, "/", -1)
    for pattern in patterns:
        keep, body = pattern.startswith("!"), pattern.removeprefix("!")
        if body.endswith("/**"):
            hit = path.startswith(body.removesuffix("/**"))
        else:
            hit = path.rlike(glob_regex(body)) | name.rlike(glob_regex(body))
        out = F.when(hit, not keep).otherwise(out)
    return out


def relative(path: Column, root: str) -> Column:
    """A file's URI as its path below ``root``."""
    base = "file:" + root.rstrip("/") if "://" not in root else root.rstrip("/")
    return F.regexp_replace(path, "^" + re.escape(base).replace("file:", "file:(//)?") + "/", "")


def unwanted(path: Column, patterns: list[str]) -> Column:
    """Whether a path lies in a skipped or dot folder or is ignored."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED_FOLDERS)) | ignored(path, patterns)


def walk(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = 1 << 20) -> DataFrame:
    """(path, size, modified, sha256, content, skip) of the files below ``root`` that are not in skipped or dot folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.where(~unwanted(F.col("path"), patterns or []))
    return rows.withColumn("skip", denied(F.col("path")) | (F.col("size") > max_bytes)).withColumn("sha256", F.sha2("content", 256))


def scoped(found: DataFrame, paths: DataFrame) -> DataFrame:
    """The files at explicit paths (path); a path that is not there has no row, so against what is stored it is a delete."""
    return found.join(paths.select("path").distinct(), "path", "left_semi")


def classify_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, action): replace, touch, mark_seen, skip_only or delete, from (path, size, modified, sha256[, skip])."""
    a = stored.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("sha256").alias("old_sha"))
    b = found.select("path", "size", "modified", "sha256", "skip", F.lit(True).alias("there"))
    both = a.join(b, "path", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified"))
    action = F.when(F.col("there").isNull(), "delete").when(F.col("skip"), "skip_only").when(same, "mark_seen").when(F.col("sha256") == F.col("old_sha"), "touch").otherwise("replace")
    return both.select("path", F.coalesce(action, F.lit("replace")).alias("action"))


def replace_files(stored: DataFrame, parsed: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Rows of files that were replaced or deleted go, those of ``parsed`` come."""
    gone = changes.where(F.col("action").isin("replace", "delete")).select(F.col("path").alias(key))
    return stored.join(gone, key, "left_anti").unionByName(parsed)


def upsert(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows by key, the new ones before the stored."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows)
