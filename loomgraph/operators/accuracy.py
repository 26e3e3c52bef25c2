"""How well a resolver does on declared cases: outcomes, determinism over runs, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_outcomes(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, outcome, variants) for cases(case_id, expect, valid_targets) and observed(run, case_id, target).

    observed has a row per run in which the case's call was found; target is the
    qualified name it was bound to, null if unbound. expect: valid, invalid, unresolved or
    ambiguous. Outcomes: no_edge, miswired, missing_edge, expected_valid, expected_unresolved,
    correctly_unresolved; nondeterministic, with the variants, if runs disagree.
    """
    bound = F.col("target").isNotNull()
    told = cases.join(observed.withColumn("__seen", F.lit(True)), "case_id", "left")
    one = (
        F.when(F.col("__seen").isNull(), "no_edge")
        .when(F.col("expect") == "valid", F.when(~bound, "missing_edge").when(F.array_contains("valid_targets", F.col("target")), "expected_valid").otherwise("miswired"))
        .when(F.col("expect").isin("invalid", "unresolved", "ambiguous"), F.when(bound, "miswired").when(F.col("expect") == "invalid", "correctly_unresolved").otherwise("expected_unresolved"))
        .otherwise("nondeterministic")
    )
    # a case has seven outcomes at most, so the set is small however many runs there are
    runs = told.select("case_id", one.alias("one")).groupBy("case_id").agg(F.sort_array(F.collect_set("one")).alias("variants"))
    return runs.select("case_id", F.when(F.size("variants") == 1, F.get("variants", 0)).otherwise("nondeterministic").alias("outcome"), "variants")


def metrics(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def unstable_edges(observed: DataFrame) -> DataFrame:
    """(case_id, targets): calls that runs bind differently; null targets count as the word unbound."""
    targets = observed.groupBy("case_id").agg(F.sort_array(F.collect_set(F.coalesce("target", F.lit("unbound")))).alias("targets"))
    return targets.where(F.size("targets") > 1)


def parity(full: DataFrame, incremental: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one of a full and an incremental resolve gives, with side."""
    a, b = full.select(*keys), incremental.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("full")).unionByName(b.exceptAll(a).withColumn("side", F.lit("incremental")))
