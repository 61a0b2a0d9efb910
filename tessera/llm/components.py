"""Connected components by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = both if large else both.where("v < u")
    low = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = rows.join(low, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for each node with a link; root is the smallest node reachable.

    ``edges`` has comparable columns u and v; direction, repeats and self-links do
    not matter, rows with a null end are dropped. The large-star and small-star
    steps never collect a neighbourhood: a node's links are only minimised (with
    map-side partial sums) and re-joined, so a hub is split by the skew join. Each
    round is written to the shared folder, which cuts lineage. Rounds end when the
    links are stars: each node has one link, to a node that has none.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while True:
        once = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        inner = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if once.select("u").union(inner.select("u")).limit(1).count() == 0:
            return edges.select("u", F.col("v").alias("root"))
        old, edges = edges, materialize(_star(_star(edges, True), False), "stars")
        discard(old)
