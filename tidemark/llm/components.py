"""Connected components of a link table, without any part of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialize, release

#: Rounds before giving up; each at least halves the longest path to a component's smallest node.
MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``node, part``: for every node of ``links`` (columns ``a``, ``b``) the smallest node that it is connected with.

    Alternates large-star and small-star steps until the links no longer change. A node of many links is a group in an
    aggregation with map-side minima, never collected. The minima, one row a node, are dealt evenly before they meet the
    links again, so that both sides of that join come straight from a shuffle: adaptive execution can then split the links of
    a hub over many tasks.
    """
    evenly = lambda df: df.repartition(F.xxhash64("u"))
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    if not edges.head(1):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
    state = None
    for _ in range(MAX_ROUNDS):
        # large star: all larger neighbours of a node link to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(evenly(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: the smaller neighbours of a node, and the node, link to its smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(evenly(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        old, edges = edges, materialize(small, "links")
        release(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
