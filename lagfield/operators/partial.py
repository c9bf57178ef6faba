"""Lag sums of parts of a sequence that merge later, and the same as a table function for SQL."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.grid import Grid, qgrid
from .blocked import Q, halo_sums, mean_of_sums
from .radial import bin_edges, rings_of

STATE = "seq_id string, iy int, ix int, part int, lag int, n long, s double"


def part_states(spectrum: DataFrame, lags: list[int], part: int) -> DataFrame:
    """The states (n pairs, s sum of |difference|^2) of the parts of ``part`` frames, by wavevector and lag; a pair belongs to the part of its earlier frame.

    States of different parts are plain rows: keep them by part, add those of a new part, merge any of them.
    """
    return halo_sums(spectrum, lags, part).select("seq_id", "iy", "ix", F.col("block").alias("part"), "lag", "n", "s")


def next_part(tail: DataFrame, new: DataFrame, lags: list[int], part: int) -> tuple[DataFrame, DataFrame]:
    """(states, tail) of new frames that follow those of ``tail``, the last max(lags) frames before them: what was read before is not read again.

    States are under the number of the new frames' part; their pairs with the tail are theirs, since the tail's part is closed.
    """
    most = max(lags)
    number = F.floor(F.min("t").over(Window.partitionBy("seq_id")) / part).cast("int")
    both = tail.select(*Q, "t", "re", "im", F.lit(False).alias("new")).unionByName(new.select(*Q, "t", "re", "im", F.lit(True).alias("new")))
    early = both.select(*Q, F.col("t").alias("t1"), F.col("re").alias("re1"), F.col("im").alias("im1"))
    late = new.withColumn("part", number).select(*Q, "t", "re", "im", "part", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("t1", F.col("t") - F.col("lag"))
    dr, di = F.col("re") - F.col("re1"), F.col("im") - F.col("im1")
    states = late.join(early, [*Q, "t1"]).groupBy(*Q, "part", "lag").agg(F.count(F.lit(1)).alias("n"), F.sum(dr * dr + di * di).alias("s"))
    last = both.groupBy("seq_id").agg(F.max("t").alias("_last"))
    return states, both.join(last, "seq_id").where(F.col("t") > F.col("_last") - most).select(*Q, "t", "re", "im")


def merged(states: DataFrame, delta_t: float = 1.0) -> DataFrame:
    """The structure function of all parts in ``states``."""
    return mean_of_sums(states, delta_t)


def ring_states(sf: DataFrame, grid: Grid, bins: int, mask: Column | None = None) -> DataFrame:
    """(seq_id, lag, bin, w, mean, m2): weighted moments of the pixels of each ring, which merge by ``merge_moments``: of parts of the plane, or of sequences."""
    ky, kx = grid.axes()
    edges, low = bin_edges(bins, None, [(a * a + b * b) ** 0.5 for a in ky for b in kx])
    pixels = rings_of(qgrid(sf.sparkSession, grid), edges, low).where(F.col("bin").isNotNull() & (mask if mask is not None else F.lit(True))).select("iy", "ix", "bin", F.col("mult").cast("double").alias("w"))
    alike = sf.join(pixels, ["iy", "ix"]).groupBy("seq_id", "lag", "bin", "w").agg(F.count(F.lit(1)).alias("c"), F.avg("d").alias("mean"), F.var_pop("d").alias("v"))
    return merge_moments(alike.select("seq_id", "lag", "bin", (F.col("w") * F.col("c")).alias("w"), "mean", (F.col("w") * F.col("c") * F.col("v")).alias("m2")), ["seq_id", "lag", "bin"])


def merge_moments(states: DataFrame, by: list[str]) -> DataFrame:
    """Adds up (w, mean, m2) by ``by``: m2 of the whole is that of the parts and their means' distance from the whole's, so that no sum of squares cancels."""
    whole = states.groupBy(*by).agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    return states.join(whole, by).groupBy(*by).agg(F.sum("w").alias("w"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("w") * apart * apart).alias("m2"))


@udtf(returnType="seq_id string, iy int, ix int, lag int, n bigint, s double")
class LagSums:
    """One partition is a wavevector, its rows in order of t. Holds the last max(lags) frames and a sum a lag."""

    def __init__(self) -> None:
        self.key, self.lags, self.frames, self.sums = None, [], deque(), {}

    def eval(self, row, lags: list[int]) -> Iterator[tuple]:
        if self.key is None:
            self.key, self.lags = (row["seq_id"], row["iy"], row["ix"]), sorted({int(x) for x in lags})
        t, now = row["t"], complex(row["re"], row["im"])
        while self.frames and self.frames[0][0] < t - self.lags[-1]:
            self.frames.popleft()
        at = dict(self.frames)
        for lag in self.lags:
            if (before := at.get(t - lag)) is not None:
                n, s = self.sums.get(lag, (0, 0.0))
                self.sums[lag] = n + 1, s + abs(now - before) ** 2
        self.frames.append((t, now))
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        for lag, (n, s) in sorted(self.sums.items()):
            yield (*self.key, lag, n, s)


def register_table_function(spark: SparkSession, name: str = "lag_sums") -> None:
    """``SELECT * FROM lag_sums(TABLE(spectrum) PARTITION BY (seq_id, iy, ix) ORDER BY (t), ARRAY(1, 2))``: states of whole sequences, for SQL. Frames come one at a time; the DataFrame forms are faster."""
    spark.udtf.register(name, LagSums)
