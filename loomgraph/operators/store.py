"""The write path as tables: live rows, what a scan marks, what a changed file takes with it, and the queue of paths to do.

Tables are values: every function gives the table as it is afterwards, in one rewrite however
many kinds of change there are, and the caller writes it.

files(id, path, language, size, modified, sha256, parse_state, last_scan_id, is_deleted)
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text


def live(files: DataFrame) -> DataFrame:
    """The rows that are not deleted; a table that cannot tell has live rows only."""
    return files.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in files.columns else files


def of_live_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (file_id, ...) of files that are not deleted."""
    return rows.join(live(files).select(F.col("id").alias("file_id")), "file_id", "left_semi")


def existing(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, size, modified, sha256) of the live files, of ``paths`` (path) alone if given."""
    found = live(files).select("path", "size", "modified", "sha256")
    return found if paths is None else found.join(paths.select("path").distinct(), "path", "left_semi")


def file_id(files: DataFrame, path: str) -> DataFrame:
    """(id) of the live file at a path as it may be spelled; no row if there is none."""
    return live(files).where(F.col("path") == text.canonical_path(F.lit(path))).select("id")


def content_hash(files: DataFrame, path: str) -> DataFrame:
    return live(files).where(F.col("path") == text.canonical_path(F.lit(path))).select("sha256")


def has_rows(table: DataFrame | None) -> bool:
    """Whether there is a graph before a scan, or any embedding: the first row answers."""
    return table is not None and not table.isEmpty()


def last_scan(scans: DataFrame) -> int | None:
    """The newest scan that is done, which stamps what queries see."""
    return scans.where("status = 'completed'").agg(F.max("id")).first()[0]


def upsert_repo(repos: DataFrame, root: str, canonical: str, now: Column) -> DataFrame:
    """repos(id, root_path, canonical_path, updated_at) with a row for ``canonical``: its root and time are renewed, or it is added under a hash of its path."""
    same = F.col("canonical_path") == F.lit(canonical)
    kept = repos.select("id", F.when(same, F.lit(root)).otherwise(F.col("root_path")).alias("root_path"), "canonical_path", F.when(same, now).otherwise(F.col("updated_at")).alias("updated_at"))
    new = repos.sparkSession.range(1).select(F.xxhash64(F.lit(canonical)).alias("id"), F.lit(root).alias("root_path"), F.lit(canonical).alias("canonical_path"), now.alias("updated_at"))
    return kept.unionByName(new.join(repos.select("canonical_path"), "canonical_path", "left_anti").select(*kept.columns))


def with_failures(changes: DataFrame, failed: DataFrame) -> DataFrame:
    """changes(path, action) in which files that were to be replaced and could not be parsed (path) are parse_failed."""
    bad = failed.select("path", F.lit(True).alias("__bad")).distinct()
    joined = changes.join(bad, "path", "left")
    return joined.withColumn("action", F.when((F.col("action") == "replace") & F.col("__bad"), "parse_failed").otherwise(F.col("action"))).drop("__bad")


def mark(files: DataFrame, changes: DataFrame, found: DataFrame, scan_id: int) -> DataFrame:
    """``files`` after a scan: changes(path, action) and what was found (path, language, size, modified, sha256).

    mark_seen stamps the scan; touch also renews size and time; replace and parse_failed renew
    all that is known of the content, with parse_state indexed or parse_failed; delete and
    skip_only leave a row of state deleted. Files not named in ``changes`` stay as they are.
    A path that was deleted lives again when it is replaced. New paths get the hash of the path as id.
    """
    now = found.select("path", *[F.col(c).alias(f"n_{c}") for c in ("language", "size", "modified", "sha256")])
    all_ = files.join(changes.select("path", "action").join(now, "path", "left"), "path", "full_outer")
    act = F.col("action")
    renewed, read = act.isin("touch", "replace", "parse_failed"), act.isin("replace", "parse_failed")
    gone = act.isin("delete", "skip_only")
    take = lambda when, new, old: F.when(when, F.col(new)).otherwise(F.col(old)).alias(old)
    state = F.when(act == "replace", "indexed").when(act == "parse_failed", "parse_failed").when(gone, "deleted").otherwise(F.col("parse_state"))
    rows = all_.where(F.col("id").isNotNull() | read).select(
        F.coalesce("id", F.xxhash64("path")).alias("id"), "path", F.coalesce(F.when(read, F.col("n_language")), F.col("language")).alias("language"), take(renewed, "n_size", "size"), take(renewed, "n_modified", "modified"), take(read, "n_sha256", "sha256"),
        state.alias("parse_state"), F.when(act.isNotNull(), F.lit(scan_id).cast("long")).otherwise(F.col("last_scan_id")).alias("last_scan_id"), F.when(gone, True).when(read, False).otherwise(F.col("is_deleted")).alias("is_deleted"),
    )
    return rows.select(*files.columns)


def delete_unseen(files: DataFrame, scan_id: int) -> DataFrame:
    """``files`` in which live ones that the scan has not stamped are deleted."""
    unseen = ~F.coalesce("is_deleted", F.lit(False)) & (F.coalesce("last_scan_id", F.lit(-1)) != scan_id)
    return files.withColumn("parse_state", F.when(unseen, "deleted").otherwise(F.col("parse_state"))).withColumn("is_deleted", F.when(unseen, True).otherwise(F.col("is_deleted")))


def purge(files: DataFrame) -> DataFrame:
    """``files`` without the rows of deleted ones, once nothing refers to them."""
    return live(files)


def gone_symbols(symbols: DataFrame, changed: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(id) of the symbols in ``changed`` files (file_id) that the new symbols ``parsed`` no longer have."""
    old = symbols.join(changed.select("file_id").distinct(), "file_id", "left_semi").select("id")
    return old if parsed is None else old.join(parsed.select("id"), "id", "left_anti")


def replace_rows(stored: DataFrame, changed: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Rows (file_id, ...) of changed files (file_id) go, those of ``parsed`` come."""
    kept = stored.join(changed.select("file_id").distinct(), "file_id", "left_anti")
    return kept if parsed is None else kept.unionByName(parsed.select(*stored.columns))


def unbind(calls: DataFrame, gone: DataFrame) -> DataFrame:
    """``calls`` (dst, strategy, confidence, ...) in which bindings to symbols that are gone (id) and their metadata are cleared; an id may be given more than once."""
    lost = gone.select(F.col("id").alias("dst"), F.lit(True).alias("__lost")).distinct()
    joined = calls.join(lost, "dst", "left")
    return joined.select(*[F.when(F.col("__lost").isNull(), F.col(c)).alias(c) if c in ("dst", "strategy", "confidence") else F.col(c) for c in calls.columns])


def unbind_tests(links: DataFrame, gone: DataFrame, gone_files: DataFrame) -> DataFrame:
    """Test links without those from files that are gone (file_id), and without targets that are."""
    kept = links.join(gone_files.select(F.col("file_id").alias("test_file_id")).distinct(), "test_file_id", "left_anti")
    kept = kept.join(gone.select(F.col("id").alias("target_symbol_id"), F.lit(True).alias("__lost")).distinct(), "target_symbol_id", "left")
    kept = kept.join(gone_files.select(F.col("file_id").alias("target_file_id"), F.lit(True).alias("__away")).distinct(), "target_file_id", "left")
    return kept.withColumn("target_symbol_id", F.when(F.col("__lost").isNull(), F.col("target_symbol_id"))).withColumn("target_file_id", F.when(F.col("__away").isNull(), F.col("target_file_id"))).select(*links.columns)


# the queue of paths to do: queue(path, reason, stamp, claim)


def enqueue(queue: DataFrame, paths: DataFrame) -> DataFrame:
    """``queue`` with paths(path, reason, stamp): the newest request of a path stays, and a new one frees it from its claim."""
    every = queue.unionByName(paths.select("path", "reason", "stamp").withColumn("claim", F.lit(None).cast("long")))
    return every.groupBy("path").agg(F.max_by(F.struct("reason", "stamp", "claim"), F.struct("stamp", F.col("claim").isNull())).alias("q")).select("path", "q.reason", "q.stamp", "q.claim")


def claim(queue: DataFrame, at: int, limit: int = 500) -> DataFrame:
    """``queue`` in which the oldest ``limit`` unclaimed paths are claimed at ``at``."""
    taken = queue.where("claim is null").orderBy("stamp", "path").limit(limit).select("path", F.lit(at).cast("long").alias("__at"))
    return queue.join(taken, "path", "left").withColumn("claim", F.coalesce("claim", "__at")).select(*queue.columns)


def finish(queue: DataFrame, done: DataFrame) -> DataFrame:
    """``queue`` without done(path, stamp), but for paths that were requested again meanwhile; these wait anew, so every request is done at least once."""
    finished = done.groupBy("path").agg(F.max("stamp").alias("__done"))
    joined = queue.join(finished, "path", "left")
    return joined.where("__done is null or __done < stamp").withColumn("claim", F.when(F.col("__done").isNull(), F.col("claim"))).select(*queue.columns)


@dataclass
class Config:
    """What a repository is scanned with. The defaults."""

    exclude: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)  # all if empty
    max_file_size_bytes: int = 1 << 20
    debounce_ms: int = 750
    fail_on_parse_error: bool = False
    embedding_dimensions: int = 768

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def read(cls, raw: str | None) -> Config:
        """From JSON; ValueError for unknown keys and values of another type."""
        given = json.loads(raw) if raw else {}
        default = cls()
        for key, value in given.items():
            if not hasattr(default, key) or not isinstance(value, type(getattr(default, key))):
                raise ValueError(f"config: {key}")
        return cls(**given)
