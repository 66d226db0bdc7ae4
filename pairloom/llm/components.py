"""Connected components by repeated contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, component), component the smallest id that a node reaches.

    Each round maps every node to the smallest of itself and its neighbours and
    keeps the links between images, so paths shrink geometrically; the maps are
    then applied backwards.  Links of a null end and self-links add nothing.
    Only nodes with a link are returned.  Hot nodes are pre-aggregated by the
    partial minimum before the shuffle.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    edges = stash(edges, "edges")
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "least")
        maps.append(least)
        left = least.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = least.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        images = edges.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = stash(images.distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = maps.pop().select("node", F.col("to").alias("component"))
    while maps:
        inner = label.select(F.col("node").alias("to"), "component")
        label = maps.pop().join(inner, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return stash(label, "components")
