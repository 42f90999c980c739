"""Connected components of a link table by alternating large-star and small-star steps.

Each step replaces links by links to the smallest known neighbour, so links never
outnumber those of the step before by more than the nodes, no neighbour list is ever
gathered, and rounds grow with the logarithm of a component's width. Minima are
pre-aggregated and joined back from written tables, so that Spark can split the rows
of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) in any order, repeats and self-links allowed, nulls ignored -> (node, root), root the smallest node.

    Roots are listed with themselves, nodes without a link to another not at all. An empty table gives an empty table.
    """
    edges = saved(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large-star")
        large = saved(
            both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "links",
        )
        low2 = saved(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        step = large.join(low2, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        )
        small = saved(step.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), "links")
        drop(edges, low, large, low2)
        edges, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    else:
        raise RuntimeError("components: no fixed point; raise the number of rounds")
    own = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own.select(F.col("b").alias("node"), F.col("b").alias("root")))
