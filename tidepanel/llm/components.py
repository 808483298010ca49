"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources.sinks import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``links`` (``a, b``).

    Each round hands every node the smallest root among its neighbours and then
    follows roots of roots, so distances halve; rounds go on until nothing changes.
    Neighbour minima are pre-aggregated, so a node with very many links stays cheap.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where(F.col("a") != F.col("b")).distinct(), "links")
    state = materialize(
        both.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("root")),
        "roots",
    )
    while True:
        near = (
            both.join(state.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        joined = state.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        # a root takes over the best root any of its members has seen
        hooked = joined.groupBy(F.col("old").alias("r")).agg(F.min("root").alias("better"))
        moved = joined.join(hooked, joined["root"] == hooked["r"], "left").select(
            "node", "old", F.least("root", F.coalesce("better", "root")).alias("root")
        )
        new = materialize(moved, "roots")
        if new.where(F.col("root") != F.col("old")).limit(1).count() == 0:
            return new.select("node", "root")
        state = new.select("node", "root")
