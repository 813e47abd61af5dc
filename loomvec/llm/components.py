"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star rounds (a published MapReduce method): each is a
minimum per node and a join, and after a few rounds every node is linked to the smallest node it can reach.
Minima combine on the map side, so a node with very many links is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm._common import checkpointed


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``links`` (u, v; any direction, repeats and self-links allowed) to (node, component) for every node with a link.

    ``component`` is the smallest node reachable. Links with a null end are ignored; no links give no rows.
    """
    e = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    before = _mark(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # (a larger neighbour's own view of the link gives the same or a smaller end, and is made in the small star)
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour of a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = checkpointed(small.where("u <> v").distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
