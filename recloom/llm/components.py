"""Connected components of a link table, by alternating large-star and small-star steps; nothing of it reaches the driver
but two numbers per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.llm.store import Scratch


def components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """``a``, ``b`` (links, any order) to ``node``, ``component`` (smallest node reachable), for nodes with a link.  Links with a null
    end or to oneself say nothing and are left out; repeated ones count once; an empty table gives an empty one."""
    now = scratch.save(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    state, turn = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        turn += 1
        now = scratch.save(small, f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = tuple(got)
