"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller (small) neighbours on the least node seen from it."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of one orderable type to (node, component): the least node reachable.

    Nodes without an edge don't appear. Hubs are never gathered: a node's minimum is a partial aggregate and the join
    back to its links is one that AQE can split. Each round is written to the shared folder. A chain of n nodes takes
    about log n rounds.
    """
    state = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = (seen["n"], seen["h"])
        state = cut(_stars(_stars(state, large=True), large=False))
