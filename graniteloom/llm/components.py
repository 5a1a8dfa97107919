"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteloom.llm.common import forget, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id reachable.

    Each step groups by vertex with partial aggregation and joins back on the vertex, so a hub is no task of its own;
    each result is written, so a lost executor costs nothing. Rows with a null or with a = b add nothing. No edges
    give an empty table.
    """
    plain = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = written(plain.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large)
        forget(now)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        forget(large)
        state, before = _state(now), state
        if state == before:
            break
    stars = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return stars.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
