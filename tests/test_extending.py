"""Callers known by longer spellings: each caller, spelling and symbol once, without a shuffle of the rows that are given."""

from loomgraph.operators import identity


def test_rows_are_distinct_over_languages_and_names(spark):
    calls = spark.createDataFrame([(1, "v/a.b", "go"), (1, "v/a.b", "go"), (1, "v/a.b", "python"), (2, "v/a.b", "python"), (3, "v/c", "go"), (None, "v/a.b", "go"), (4, None, "go"), (5, "v/a.b", None)], "src long, dst_name string, language string")
    # 7 is borne in two languages, 8 by two names that both end the spelling
    symbols = spark.createDataFrame([(7, "A.B", "go"), (7, "a.b", "python"), (8, "a.b", "go"), (8, "b", "go"), (9, "c", "python")], "id long, qualified_name string, language string")
    got = identity.extending_callers(calls, symbols)
    assert sorted((r.src or 0, r.dst_name, r.id) for r in got.collect()) == [(0, "v/a.b", 7), (0, "v/a.b", 8), (1, "v/a.b", 7), (1, "v/a.b", 8), (2, "v/a.b", 7)]


def test_found_rows_are_not_shuffled(spark):
    calls = spark.createDataFrame([(1, "v/a", "go")], "src long, dst_name string, language string")
    plan = identity.extending_callers(calls, spark.createDataFrame([(7, "a", "go")], "id long, qualified_name string, language string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]
