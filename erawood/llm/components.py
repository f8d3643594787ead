"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erawood.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for every node with an edge; root is the smallest node reachable.

    Alternates large-star and small-star steps: each hangs a node's neighbours on the smallest
    of them, so the edge count never grows and chains shorten by half. Nodes are bigints; loops,
    null ends and repeated edges are dropped. Only a checksum of the edges reaches the driver.
    """
    e = (
        edges.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    e = cut(e)
    before = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(small_least, "hi")
            .select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("x"))
            .select("x.hi", F.col("x.m").alias("lo"))
            .where("hi != lo")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.sum(F.expr("hash(hi, lo)").cast("bigint"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = e.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")
    return cut(roots.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()))
