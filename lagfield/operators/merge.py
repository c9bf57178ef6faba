"""Resampling of curves and merging of acquisitions at different rates. Curves have columns seq_id, bin, k, tau, a value, err.

A curve is one row with its points as arrays, bounded by the number of lags. A spline's value is a weighted sum of the curve's logarithms, and the weights depend on the
list of tau alone: they are a table, a row for each different list, that the curves are joined to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spline import weights

MELT_POINTS = 10
NAN = float("nan")
WEIGHTS = "src array<double>, at array<double>, w array<array<double>>"


def _curves(rows: DataFrame, value: str, to: str = "") -> DataFrame:
    """seq_id, bin, and with the suffix ``to``: k, tau, v, err; arrays by tau. Null errors are NaN."""
    points = F.sort_array(F.collect_list(F.struct(F.col("tau").cast("double").alias("tau"), F.col(value).cast("double").alias("v"), F.coalesce(F.col("err").cast("double"), F.lit(NAN)).alias("err"))))
    wide = rows.groupBy("seq_id", "bin").agg(F.first("k").alias("k"), points.alias("p"))
    return wide.select("seq_id", "bin", F.col("k").alias(f"k{to}"), *[F.col(f"p.{c}").alias(f"{c}{to}") for c in ("tau", "v", "err")])


def _weights(lists: DataFrame, degree: int, known: list[tuple[list[float], list[float]]] | None) -> DataFrame:
    """``WEIGHTS`` for the different pairs (src, at) of ``lists``; made on the driver where the caller knows the pairs."""
    if known is not None:
        rows = [([float(x) for x in src], [float(x) for x in at], weights(src, at, degree).tolist()) for src, at in known]
        return lists.sparkSession.createDataFrame(rows, WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [weights(src, at, degree).tolist() for src, at in zip(b.column("src").to_pylist(), b.column("at").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("at"), pa.array(w, pa.list_(pa.list_(pa.float64())))], ["src", "at", "w"])

    return lists.select("src", "at").distinct().mapInArrow(run, WEIGHTS)


def _log(v: Column) -> Column:
    return F.when(v > 0, F.ln(v)).when(v == 0, float("-inf")).otherwise(NAN)


def _at_weights(w: Column, values: Column) -> Column:
    """exp(w times the logs of the values): the spline at the places of w."""
    logs = F.transform(values, _log)
    return F.transform(w, lambda row: F.exp(F.aggregate(F.zip_with(row, logs, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def _rows(wide: DataFrame, value: str) -> DataFrame:
    """Points of arrays tau, v, err."""
    each = F.explode(F.arrays_zip("tau", "v", "err")).alias("x")
    return wide.select("seq_id", "bin", "k", each).select("seq_id", "bin", "k", "x.tau", F.col("x.v").alias(value), "x.err")


def resample(curves: DataFrame, tau: list[float], value: str = "d", tau_lists: list[list[float]] | None = None) -> DataFrame:
    """Quadratic splines in log-log, values and errors; a curve that begins with NaN stays NaN, and so do errors of which one is missing.

    ``tau_lists``: the different lists of tau that the curves have, if the caller knows them; then no Python runs on executors, and a curve with another list raises.
    """
    to = sorted(float(x) for x in tau)
    at = F.array(*map(F.lit, to))
    wide = _curves(curves, value).withColumnsRenamed({"tau": "src", "v": "old", "err": "old_err"}).withColumn("at", at)
    found = _matched(wide, _weights(wide, 2, None if tau_lists is None else [(x, to) for x in tau_lists]))
    nothing = F.transform("at", lambda _: F.lit(NAN))
    known = ~F.isnan(F.col("old")[0])
    v = F.when(known, _at_weights(F.col("w"), F.col("old"))).otherwise(nothing)
    err = F.when(known & ~F.exists("old_err", F.isnan), _at_weights(F.col("w"), F.col("old_err"))).otherwise(nothing)
    return _rows(found.select("seq_id", "bin", "k", F.col("at").alias("tau"), v.alias("v"), err.alias("err")), value)


def _matched(wide: DataFrame, table: DataFrame) -> DataFrame:
    """Curves with their weights; a curve without any raises. Short lists of numbers are compared as they are."""
    found = wide.join(table.select(F.col("src").alias("_src"), F.col("at").alias("_at"), "w"), (F.col("src") == F.col("_src")) & (F.col("at") == F.col("_at")), "left").drop("_src", "_at")
    wrong = F.raise_error(F.lit("a curve has a list of tau that is not among those given")).cast("array<array<double>>")
    return found.withColumn("w", F.when(F.col("w").isNull(), wrong).otherwise(F.col("w")))


def melt(first: DataFrame, second: DataFrame, value: str = "d", tau_lists: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Fast acquisition scaled onto the slow one: fast up to the slow one's middle overlap, then slow.

    Slow is the one with the larger first tau (a tie makes the second one fast). n, ``MELT_POINTS`` at most, is how many slow times lie before the last fast one. The
    cut is the fast time nearest to the slow time number n // 2 (the first of equals): fast points up to it stay, and slow ones after number n // 2. The factor is
    the least-squares one between the cubic spline of the fast curve at the first n slow times and the slow values there. NaN curves stay NaN, errors too.
    Rings of one side alone have no rows. ``tau_lists``: the lists of tau of ``first`` and of ``second``, as in ``resample``.
    """
    both = _curves(first, value, "1").join(_curves(second, value, "2"), ["seq_id", "bin"])
    swap = F.col("tau1")[0] < F.col("tau2")[0]
    pick = lambda c, fast: F.when(swap, F.col(f"{c}{1 if fast else 2}")).otherwise(F.col(f"{c}{2 if fast else 1}"))
    wide = both.select("seq_id", "bin", pick("k", True).alias("k"), *[pick(c, fast).alias(f"{n}{c}") for n, fast in (("f", True), ("s", False)) for c in ("tau", "v", "err")])
    n = F.least(F.lit(MELT_POINTS), F.size(F.filter("stau", lambda t: t < F.element_at("ftau", -1))))
    wide = wide.withColumn("n", n).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    wide = wide.withColumn("off", F.transform("ftau", lambda t: F.abs(t - F.element_at("stau", F.col("half") + 1))))
    wide = wide.withColumns({"cut": F.array_position("off", F.array_min("off")).cast("int"), "src": F.col("ftau"), "at": F.slice("stau", F.lit(1), F.col("n"))})
    known = None
    if tau_lists is not None:
        fast, slow = tau_lists if tau_lists[0][0] < tau_lists[1][0] else tau_lists[::-1]
        known = [(fast, [t for t in slow if t < fast[-1]][:MELT_POINTS])]
    found = _matched(wide, _weights(wide, 3, known)).withColumn("over", _at_weights(F.col("w"), F.col("fv")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    alpha = total(F.zip_with("over", F.slice("sv", F.lit(1), F.col("n")), lambda a, b: a * b)) / F.nullif(total(F.transform("over", lambda a: a * a)), F.lit(0.0))
    found = found.withColumn("alpha", F.when(F.isnan(F.col("fv")[0]) | F.isnan(F.col("sv")[0]), NAN).otherwise(F.coalesce(alpha, F.lit(NAN))))
    rest = lambda c: F.slice(F.col(c), F.col("half") + 2, F.size(c))
    nan_too = lambda a: F.when(F.isnan("alpha"), F.transform(a, lambda _: F.lit(NAN))).otherwise(a)
    joined = lambda c: F.concat(F.transform(F.slice(F.col(f"f{c}"), F.lit(1), F.col("cut")), lambda x: x * F.col("alpha")), nan_too(rest(f"s{c}")))
    out = found.select("seq_id", "bin", "k", F.concat(F.slice("ftau", F.lit(1), F.col("cut")), rest("stau")).alias("tau"), joined("v").alias("v"), joined("err").alias("err"))
    return _rows(out, value)


def mergesort(first: DataFrame, second: DataFrame, value: str = "d") -> DataFrame:
    """All points of both, repeats kept; errors only in sequences where both have them. Order is left to the reader's ``orderBy``."""
    cols = ["seq_id", "bin", "k", "tau", value]
    both = first.select(*cols, "err", F.lit(1).alias("_from")).unionByName(second.select(*cols, "err", F.lit(2).alias("_from")))
    w = Window.partitionBy("seq_id")
    has = lambda n: F.max(F.when((F.col("_from") == n) & F.col("err").isNotNull(), 1).otherwise(0)).over(w) == 1
    return both.select(*cols, F.when(has(1) & has(2), F.col("err")).alias("err"))


def _extra_of(first: DataFrame, extra1: DataFrame, second: DataFrame, extra2: DataFrame, pick_first: str) -> DataFrame:
    marks = first.groupBy("seq_id").agg(F.min("tau").alias("lo1"), F.max("tau").alias("hi1")).join(second.groupBy("seq_id").agg(F.min("tau").alias("lo2"), F.max("tau").alias("hi2")), "seq_id")
    marks = marks.select("seq_id", F.when(F.expr(pick_first), 1).otherwise(2).alias("_take"))
    both = extra1.withColumn("_from", F.lit(1)).unionByName(extra2.withColumn("_from", F.lit(2)))
    return both.join(marks, "seq_id").where("_from = _take").drop("_from", "_take")


def melt_extra(first: DataFrame, extra1: DataFrame, second: DataFrame, extra2: DataFrame) -> DataFrame:
    """aa_extra of a melt: the slow one's."""
    return _extra_of(first, extra1, second, extra2, "lo1 >= lo2")


def mergesort_extra(first: DataFrame, extra1: DataFrame, second: DataFrame, extra2: DataFrame) -> DataFrame:
    """aa_extra of a mergesort: that of the larger last tau, of the second in a tie."""
    return _extra_of(first, extra1, second, extra2, "hi1 > hi2")
