"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach_by_key


def _mark(edges: DataFrame) -> tuple:
    """Tells one edge set from another: count and sum of hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _to_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. A node of many neighbours is not gathered in one task."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return attach_by_key(pairs, least, "u", "n", total, ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge, root being the least node of its component. Nulls and loops are ignored."""
    scratch = Scratch(edges.sparkSession, "components")
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.written(now, "edges")
    mark, last = _mark(now), "edges"
    step = 0
    while mark[0]:
        step += 1
        both = scratch.written(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = _to_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.written(large, "large")
        small = _to_least(large, 2 * mark[0])
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        last = f"small-{step}"
        now, before = scratch.written(small, last), mark
        mark = _mark(now)
        scratch.clear(last)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
