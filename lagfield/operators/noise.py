"""Noise floor B of structure functions: six modes for radial averages, six for the plane."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("zero", "min", "high_q", "power_spec", "var", "polyfit")
NAN = float("nan")


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def _limits(k_min: float | None, k_max: float | None, default: Column) -> tuple[Column, Column]:
    if k_min is not None and k_max is not None and k_min > k_max:
        warnings.warn("k_min exceeds k_max: swapped", stacklevel=3)
        k_min, k_max = k_max, k_min
    return (default if k_min is None else F.lit(float(k_min))), (default if k_max is None else F.lit(float(k_max)))


def _all_bins(aa: DataFrame) -> DataFrame:
    # Not by k: a ring's k may differ in its last bit from slice to slice.
    return aa.select("seq_id", "bin").distinct()


def _spread(aa: DataFrame, one: DataFrame) -> DataFrame:
    """One value a sequence, for every ring."""
    return _all_bins(aa).join(one, "seq_id", "left").select("seq_id", "bin", F.coalesce("b", F.lit(NAN)).alias("b"), F.coalesce("b_err", F.lit(NAN)).alias("b_err"))


def quadratic(rows: DataFrame, by: list[str], value: str, weight: Column, scaled: bool) -> DataFrame:
    """Constant term of a weighted quadratic in tau, and its standard error, from the sums of the normal equations.

    tau is centred and scaled within the group, which keeps the equations well conditioned; the term is carried back.
    Degenerate groups give NaN.
    """
    w = Window.partitionBy(*by)
    x = rows.withColumns({"_c": F.avg("tau").over(w), "_s": F.coalesce(F.nullif(F.max("tau").over(w) - F.min("tau").over(w), F.lit(0.0)), F.lit(1.0)), "_w": weight})
    x = x.withColumn("_x", (F.col("tau") - F.col("_c")) / F.col("_s"))
    w2, v = F.col("_w") * F.col("_w"), F.col(value)
    power = lambda n: F.sum(w2 * F.pow("_x", F.lit(float(n)))) if n else F.sum(w2)
    names = {f"s{n}": power(n) for n in range(5)} | {f"y{n}": F.sum(w2 * v * (F.pow("_x", F.lit(float(n))) if n else F.lit(1.0))) for n in range(3)}
    g = x.groupBy(*by).agg(*[e.alias(n) for n, e in names.items()], F.count(F.lit(1)).alias("n"), F.sum(w2 * v * v).alias("yy"), F.first("_c").alias("c"), F.first("_s").alias("s"))
    s = [F.col(f"s{n}") for n in range(5)]
    c00, c01, c02 = s[2] * s[4] - s[3] * s[3], s[2] * s[3] - s[1] * s[4], s[1] * s[3] - s[2] * s[2]
    c11, c12, c22 = s[0] * s[4] - s[2] * s[2], s[1] * s[2] - s[0] * s[3], s[0] * s[2] - s[1] * s[1]
    g = g.withColumns({"det": s[0] * c00 + s[1] * c01 + s[2] * c02, "i00": c00, "i01": c01, "i02": c02, "i11": c11, "i12": c12, "i22": c22})
    ok = F.nullif("det", F.lit(0.0))
    i = {k: F.col(f"i{k}") / ok for k in ("00", "01", "02", "11", "12", "22")}
    p = [i["00"] * F.col("y0") + i["01"] * F.col("y1") + i["02"] * F.col("y2"), i["01"] * F.col("y0") + i["11"] * F.col("y1") + i["12"] * F.col("y2"), i["02"] * F.col("y0") + i["12"] * F.col("y1") + i["22"] * F.col("y2")]
    z = -F.col("c") / F.col("s")  # tau = 0 in the scaled variable
    b = p[0] + p[1] * z + p[2] * z * z
    var = i["00"] + 2 * z * i["01"] + z * z * (i["11"] + 2 * i["02"]) + 2 * z * z * z * i["12"] + z * z * z * z * i["22"]
    if scaled:
        rest = F.col("yy") - p[0] * F.col("y0") - p[1] * F.col("y1") - p[2] * F.col("y2")
        var = var * F.greatest(rest, F.lit(0.0)) / (F.col("n") - 3)
    return g.select(*by, F.coalesce(b, F.lit(NAN)).alias("b"), F.coalesce(F.sqrt(var), F.lit(NAN)).alias("b_err"))


def first_lags(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("tau"))).where(F.col("_rank") <= n).drop("_rank")


def radial_noise(aa: DataFrame, aa_extra: DataFrame, mode: str = "zero", k_min: float | None = None, k_max: float | None = None, num_points: int = 5) -> DataFrame:
    """noise (seq_id, bin, b, b_err) of a radial average. An unknown mode raises ``RuntimeError``.

    The error of a mean divides by all values, those without data too; ``polyfit`` keeps the unscaled covariance.
    """
    if mode not in MODES:
        raise RuntimeError(f"unknown mode {mode}; there are {', '.join(MODES)}")
    if mode == "zero":
        return _all_bins(aa).select("seq_id", "bin", F.lit(0.0).alias("b"), F.lit(0.0).alias("b_err"))
    if mode == "min":
        start = aa.withColumn("_t0", F.min("tau").over(Window.partitionBy("seq_id"))).where((F.col("tau") == F.col("_t0")) & _known(F.col("d")))
        return _spread(aa, start.groupBy("seq_id").agg(F.min("d").alias("b"), F.min_by(F.coalesce("err", "d"), "d").alias("b_err")))
    if mode == "polyfit":
        rows = first_lags(aa, ["seq_id", "bin"], max(3, num_points))
        bad = F.max((~_known(F.col("err"))).cast("int")).over(Window.partitionBy("seq_id", "bin")) == 1
        rows = rows.withColumn("_weight", F.when(bad, 1.0).otherwise(1.0 / F.col("err")))
        whole = rows.withColumn("_d0", F.min_by("d", "tau").over(Window.partitionBy("seq_id", "bin"))).where(_known(F.col("_d0")))
        return _all_bins(aa).join(quadratic(whole, ["seq_id", "bin"], "d", F.col("_weight"), False), ["seq_id", "bin"], "left").select("seq_id", "bin", F.coalesce("b", F.lit(NAN)).alias("b"), F.coalesce("b_err", F.lit(NAN)).alias("b_err"))
    top = aa.groupBy("seq_id").agg(F.max("k").alias("_top"))
    low, high = _limits(k_min, k_max, F.col("_top"))
    if mode == "high_q":
        source, value, err, times = aa, "d", "err", 1.0
    else:
        source, value, err, times = aa_extra, mode, f"{mode}_err", 2.0
    inside = source.join(top, "seq_id").where((F.col("k") >= low) & (F.col("k") <= high))
    v, e = F.col(value), F.col(err)
    mean = times * F.avg(F.when(_known(v), v))
    spread = F.sqrt(F.sum(F.when(_known(e), e * e))) / F.count(F.lit(1)) * times
    no_err = F.count(e) == 0
    return _spread(aa, inside.groupBy("seq_id").agg(mean.alias("b"), F.when(no_err, mean).otherwise(spread).alias("b_err")))


def plane_noise(sf: DataFrame, extra: DataFrame, grid_rows: DataFrame, mode: str = "zero", mask: Column | None = None, k_min: float | None = None, k_max: float | None = None, num_points: int = 5) -> DataFrame:
    """noise (seq_id, iy, ix, b, b_err) of a structure function; ``grid_rows`` has iy, ix, kx, ky, k. Means go over annulus and mask."""
    if mode not in MODES:
        raise RuntimeError(f"unknown mode {mode}; there are {', '.join(MODES)}")
    cells = extra.select("seq_id", "iy", "ix")
    if mode == "zero":
        return cells.select("*", F.lit(0.0).alias("b"), F.lit(0.0).alias("b_err"))
    if mode == "polyfit":
        n = max(3, num_points)
        if n < 4:
            raise RuntimeError("the scaled covariance of a quadratic needs at least 4 points")
        return quadratic(first_lags(sf, ["seq_id", "iy", "ix"], n), ["seq_id", "iy", "ix"], "d", F.lit(1.0), True)
    g = grid_rows.where(mask) if mask is not None else grid_rows
    g = g.select("iy", "ix", "k")
    if mode == "min":
        start = sf.join(g, ["iy", "ix"]).withColumn("_t0", F.min("tau").over(Window.partitionBy("seq_id"))).where(F.col("tau") == F.col("_t0"))
        one = start.groupBy("seq_id").agg(F.min(F.when(_known(F.col("d")), F.col("d"))).alias("b"))
    else:
        top = grid_rows.agg(F.greatest(F.max("kx"), F.max("ky")).alias("_top"))
        low, high = _limits(k_min, k_max, F.col("_top"))
        limits = top.select(low.alias("_low"), high.alias("_high")).first()  # one row of two numbers
        ring = g.where(F.col("k").between(limits["_low"], limits["_high"])).select("iy", "ix")
        source, value, times = (sf, "d", 1.0) if mode == "high_q" else (extra, mode, 2.0)
        one = source.join(ring, ["iy", "ix"]).groupBy("seq_id").agg((times * F.avg(value)).alias("b"))
    return cells.join(one, "seq_id", "left").select("seq_id", "iy", "ix", F.coalesce("b", F.lit(NAN)).alias("b"), F.coalesce("b", F.lit(NAN)).alias("b_err"))


def noise_of(curves: DataFrame, extra: DataFrame, mode: str = "zero", grid_rows: DataFrame | None = None, **args) -> DataFrame:
    """Noise of a radial average (column bin) or of a structure function (columns iy, ix; needs ``grid_rows``); any other input raises ``TypeError``."""
    columns = set(curves.columns) if isinstance(curves, DataFrame) else set()
    if {"bin", "k", "tau", "d"} <= columns:
        return radial_noise(curves, extra, mode, **args)
    if {"iy", "ix", "tau", "d"} <= columns and grid_rows is not None:
        return plane_noise(curves, extra, grid_rows, mode, **args)
    raise TypeError("a radial average, or a structure function with its grid, is needed")
