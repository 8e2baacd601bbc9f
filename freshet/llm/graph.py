"""Connected components of link tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root): the least node that each linked node reaches.

    Each step is two partial aggregates and joins, so a node with many links never meets in one task; each round's table is
    written to the shared folder. An even number of hops shrinks to stars in a logarithmic number of rounds as a rule.
    """
    one = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    last = one.agg(mark).first()
    for i in range(most_rounds):
        both = one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct(), f"{name}-{i}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        new = scratch.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{i + 1}")
        now = new.agg(mark).first()
        scratch.drop(f"{name}-{i}-large")
        if i:
            scratch.drop(f"{name}-{i}")
        one, changed, last = new, now != last, now
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    return one.select(F.col("u").alias("node"), F.col("v").alias("root")).union(one.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
