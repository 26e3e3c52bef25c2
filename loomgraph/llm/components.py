"""Connected components of a link table, wholly as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.skew import hot_keys, join_on
from loomgraph.storage import stash


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over the links; only nodes with a link are listed.

    Rounds of minimum over neighbours, hooking of roots and pointer jumping, until
    nothing changes: the number of rounds is logarithmic for long chains and two
    or three for groups that are linked with a common member. Every round is a
    table in the shared folder, so the lineage stays short. Nodes with very many links, and
    labels of very many nodes, find their rows in a broadcast, so neither a hub nor a giant
    component is gathered in one task. Links with a null end, from a node to itself and
    repeated ones add nothing; without links the result is empty.
    """
    both = stash(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v")).distinct(),
        "links",
    )
    hubs = hot_keys(both, "v")
    labels = stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = join_on(both, labels.withColumnRenamed("node", "v"), "v", hubs).groupBy("u").agg(F.min("label").alias("near"))
        seen = labels.hint("merge").join(near.hint("merge"), labels.node == near.u).select("node", "label", F.least("label", "near").alias("low"))
        roots = stash(seen.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("hooked")), "roots")
        if roots.where("hooked < root").isEmpty():
            return labels
        # a root's parent may itself have been hooked: follow two steps at once
        ahead = roots.select(F.col("root").alias("next"), F.col("hooked").alias("further"))
        jump = roots.hint("merge").join(ahead.hint("merge"), roots.hooked == ahead.next, "left").select(F.col("root").alias("label"), F.coalesce("further", "hooked").alias("to"))
        labels = stash(join_on(labels, jump, "label", hot_keys(labels, "label")).select("node", F.col("to").alias("label")), "labels")
