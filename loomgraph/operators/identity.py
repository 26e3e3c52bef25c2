"""Which symbols a spelled name may mean, for many names at once, by the first stage that has an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators.resolve import TYPES
from loomgraph.storage import stash

#: Languages in which a type is seen from another file by import only. Fixed values.
GATED = ("python", "typescript", "cpp")


def identity_cascade(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, language, stage, id) for names(name, language): all symbols of the first stage that has any in the name's language.

    Stages: 1 qualified name, 2 name, 3 suffix behind a dot or :: (ASCII case aside): the
    whole spelling of a member (a.b, a::b), the short name of others; or a qualified name
    that the spelling of a member ends in; 4 short name of a spelling that is no
    member. A spelling without qualifier means no type in gated languages, and neither does a
    short name in stage 4. Names without language mean nothing.

    All stages are equi-joins of distinct names; members never fall back to their bare tail.
    """
    n = names.select("name", "language").where("name <> '' and language <> ''").distinct()
    name = F.col("name")
    gated = F.col("language").isin(*GATED)
    n = n.select("name", "language", text.member_qualified(name).alias("member"), text.short_name(name).alias("short"), (gated & text.bare(name)).alias("no_type"), gated.alias("gated"))
    s = symbols.select("id", "language", F.col("kind").isin(*TYPES).alias("is_type"), F.col("name").alias("own"), F.col("qualified_name").alias("q"))
    allowed = ~(F.col("no_type") & F.col("is_type"))

    def hits(stage: int, left: DataFrame, right: DataFrame, when) -> DataFrame:
        return left.join(right, ["key", "language"]).where(when).select("name", "language", F.lit(stage).alias("stage"), "id")

    whole = n.withColumn("key", name)
    suffixes = s.withColumn("key", F.explode(text.boundary_suffixes(text.ascii_lower(F.col("q")))))
    wanted = n.withColumn("key", text.ascii_lower(F.when(F.col("member"), name).otherwise(F.col("short"))))
    no_type_by_tail = F.col("gated") & text.bare(F.col("key")) & F.col("is_type")
    deeper = n.where("member").withColumn("key", F.explode(text.boundary_suffixes(name, slashes=True))).where(F.col("key").contains(".") | F.col("key").contains("::"))
    tails = n.where("not member and short <> '' and short <> name").withColumn("key", F.col("short"))
    found = [
        hits(1, whole, s.withColumn("key", F.col("q")), allowed),
        hits(2, whole, s.withColumn("key", F.col("own")), allowed),
        hits(3, wanted.where("key <> ''"), suffixes, ~no_type_by_tail),
        hits(3, deeper, s.withColumn("key", F.col("q")), F.lit(True)),
        hits(4, tails, s.withColumn("key", F.col("own")), ~(F.col("gated") & F.col("is_type"))),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.distinct()
    first = every.groupBy("name", "language").agg(F.min("stage").alias("stage"))
    return every.join(first, ["name", "language", "stage"], "left_semi")


def extended_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(dst_name, language, id): distinct spellings of calls that extend the qualified name of a symbol of their language at a boundary.

    Suffixes of the spellings are exploded and joined, so no pair of a name and a symbol is tried that does not match.
    """
    spelled = calls.select("dst_name", "language").distinct().withColumn("key", F.explode(F.array_distinct(text.boundary_suffixes(text.ascii_lower(F.col("dst_name")), slashes=True))))
    return spelled.join(symbols.select("id", "language", text.ascii_lower(F.col("qualified_name")).alias("key")), ["key", "language"]).select("dst_name", "language", "id").distinct()


def extending_callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst_name, id): unbound calls whose spelling extends the qualified name of a symbol of the call's language at a boundary.

    Names meet symbols before callers meet names, and both sides of the last join are distinct. A
    caller, spelling and symbol that meet in several languages are kept in the first of these, so the
    rows, which are far more than either side, are given as they are found and never shuffled.
    """
    pairs = stash(calls.select("src", "dst_name", "language").distinct(), "spelled")
    meant = stash(extended_names(pairs, symbols), "meant")
    pairs = pairs.join(meant.select("dst_name", "language").distinct(), ["dst_name", "language"], "left_semi")
    languages = lambda name: F.collect_set("language").alias(name)
    by = pairs.groupBy("src", "dst_name").agg(languages("by")).withColumn("language", F.explode("by"))
    of = meant.groupBy("dst_name", "id").agg(languages("of")).withColumn("language", F.explode("of"))
    # merged: `of` may be large, and a broadcast would be held whole
    both = by.hint("merge").join(of.hint("merge"), ["dst_name", "language"])
    return both.where(F.col("language") == F.array_min(F.array_intersect("by", "of"))).select("src", "dst_name", "id")
