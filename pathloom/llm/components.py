"""Connected components by alternating star contractions, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.store import drop_table, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the component's smallest node.

    Each round a node's neighbours are linked to the smallest of them and the node (large star, then small star), which
    ends in stars after a number of rounds that grows with the logarithm of the longest path. Only two aggregates of a
    round's links come to the driver, to see whether anything changed. A node of very many links is summed up by
    map-side minima; its links are spread by the join that follows.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = materialize(links, "components")
    state = _state(links)
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct(), "components")
        drop_table(links)
        links, before, state = now, state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
