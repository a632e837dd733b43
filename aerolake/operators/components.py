"""Connected components by alternating large-star and small-star steps.

Every step is a partial-aggregating ``groupBy`` plus an equi-join that AQE can
split at hubs; no neighbour list is ever gathered and nothing but two numbers a
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.runtime import discard, materialize


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _dealt_anew(key: str) -> Column:
    """The key as a new expression: the join then deals both of its sides itself, and can split a hub's rows."""
    return F.col(key).bitwiseXOR(F.lit(0)).alias(key)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node (a long) that an edge touches; component is the smallest node.

    Self-loops, repeated, reversed and null-ended edges are ignored; an empty edge
    table gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    now = materialize(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds if mark[0] else 0):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(_dealt_anew("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        near = large.groupBy("b").agg(F.min("a").alias("m")).select(_dealt_anew("b"), "m")
        small = large.join(near, "b")
        ends = F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")
        after = materialize(small.select(ends).select("e.a", "e.b").where("a != b").distinct(), "cc")
        was, mark = mark, _mark(after)
        discard(now)
        now = after
        if mark == was:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
