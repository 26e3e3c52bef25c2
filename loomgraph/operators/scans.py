"""Repositories and their scans: lifecycle, summaries, coverage by language, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.inventory import page


def list_repos(repos: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return page(repos.select("id", "root_path", "canonical_path"), ["id"], limit, offset)


def latest_errors(scans: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Failed scans that tell why, newest first."""
    return page(scans.where("status = 'failed' and error_text <> ''"), [F.desc("id")], limit, offset)


def summaries(outcomes: DataFrame) -> DataFrame:
    """(scan_id, files_seen, files_changed, files_deleted, parse_failed) from a row per scanned file: outcome is indexed, skipped, parse_failed or deleted.

    Deleted files were not seen; changed are those that were read again, whether or not they could be parsed.
    """
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return outcomes.groupBy("scan_id").agg(n("indexed", "skipped", "parse_failed").alias("files_seen"), n("indexed", "parse_failed").alias("files_changed"), n("deleted").alias("files_deleted"), n("parse_failed").alias("parse_failed"))


def language_coverage(outcomes: DataFrame) -> DataFrame:
    """(scan_id, language, seen, indexed, skipped, parse_failed) of the files that were seen."""
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    return outcomes.where("outcome <> 'deleted'").groupBy("scan_id", "language").agg(F.count("*").alias("seen"), n("indexed"), n("skipped"), n("parse_failed"))


def complete(scans: DataFrame, summary: DataFrame, finished: Column) -> DataFrame:
    """Running scans (id, status, error_text, ...) that have a summary, closed: failed where error_text is not empty, else completed."""
    of = summary.select(F.col("scan_id").alias("id"), "files_seen", "files_changed", "files_deleted", F.lit(True).alias("__done"))
    joined = scans.drop("files_seen", "files_changed", "files_deleted").join(of, "id", "left")
    done = F.col("__done") & (F.col("status") == "running")
    closed = F.when(F.coalesce("error_text", F.lit("")) != "", "failed").otherwise("completed")
    old = F.col("finished_at") if "finished_at" in scans.columns else F.lit(None).cast("timestamp")
    return joined.withColumn("finished_at", F.when(done, finished).otherwise(old)).withColumn("status", F.when(done, closed).otherwise(F.col("status"))).drop("__done")


def needs_full_scan(stored_config: str | None, config: str) -> bool:
    """Whether the settings have changed since the last scan, after which every file is scanned again."""
    return stored_config != config
