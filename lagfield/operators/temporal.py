"""Lagged difference statistics of spectra over time: structure function, mean power spectrum, temporal variance.

Frames may be missing: all strategies leave out the pairs that need a missing frame, and a lag without a pair has no row.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.lags import checked_lags
from .blocked import by_block_scan, by_fft_blocks, by_halo
from .raster import pack
from .spectral import rfft2_arrow, spectrum_of

Q = ["seq_id", "iy", "ix"]
SF = "seq_id string, lag int, tau double, iy int, ix int, d double, n_pairs int"
STRATEGIES = ("join", "lead", "prefix", "fft", "halo", "block_scan", "fft_blocks")
#: Frames of a sequence from which ``auto`` cuts the time axis in blocks.
LONG_FRAMES = 8192
#: Bytes of spectrum that a task of the FFT strategy holds, about.
BLOCK_BYTES = 1 << 26


def power_and_variance(spectrum: DataFrame) -> DataFrame:
    """sf_extra: mean power, and population variance of the complex amplitude, in one aggregation."""
    power = F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return spectrum.groupBy(*Q).agg(power.alias("power_spec"), (F.var_pop("re") + F.var_pop("im")).alias("var"))


def _out(df: DataFrame, delta_t: float) -> DataFrame:
    return df.select("seq_id", F.col("lag").cast("int").alias("lag"), (F.col("lag") * float(delta_t)).alias("tau"), "iy", "ix", "d", F.col("n_pairs").cast("int").alias("n_pairs"))


def by_join(spectrum: DataFrame, lags: list[int], delta_t: float = 1.0) -> DataFrame:
    """Equi self-join on wavevector and shifted time. Shuffles the spectrum once for each lag's side."""
    later = spectrum.select(*Q, F.col("t").alias("t2"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    pairs = spectrum.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("t2", F.col("t") + F.col("lag")).join(later, [*Q, "t2"])
    d = (F.col("re2") - F.col("re")) * (F.col("re2") - F.col("re")) + (F.col("im2") - F.col("im")) * (F.col("im2") - F.col("im"))
    return _out(pairs.groupBy(*Q, "lag").agg(F.avg(d).alias("d"), F.count(F.lit(1)).alias("n_pairs")), delta_t)


def _at(lags: list[int]) -> dict[str, Column]:
    """re and im of the frame at t + lag, null if it is missing; a negative lag looks back."""
    w = Window.partitionBy(*Q).orderBy("t")
    return {f"_{part}{lag}": F.first(part).over(w.rangeBetween(lag, lag)) for lag in lags for part in ("re", "im")}


def _by_lag(rows: DataFrame, sums: list[Column], delta_t: float) -> DataFrame:
    wide = rows.groupBy(*Q).agg(F.array(*sums).alias("_all"))
    return _out(wide.select(*Q, F.explode("_all").alias("_x")).select(*Q, "_x.lag", "_x.d", "_x.n_pairs").where("n_pairs > 0"), delta_t)


def by_lead(spectrum: DataFrame, lags: list[int], delta_t: float = 1.0) -> DataFrame:
    """One exchange and one sort by wavevector: the window's frame is the time t + lag itself."""
    sums = []
    for lag in lags:
        dr, di = F.col(f"_re{lag}") - F.col("re"), F.col(f"_im{lag}") - F.col("im")
        sums.append(F.struct(F.lit(lag).alias("lag"), F.avg(dr * dr + di * di).alias("d"), F.count(f"_re{lag}").alias("n_pairs")))
    return _by_lag(spectrum.withColumns(_at(lags)), sums, delta_t)


def slices_by_lead(spectrum: DataFrame, lags: list[int], delta_t: float = 1.0) -> DataFrame:
    """What ``slices_of`` gives, from one pass over the spectrum: its exchange by wavevector serves lags, power spectrum and variance."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    entry = lambda what, lag, v, n: F.struct(F.lit(what).alias("what"), F.lit(lag).cast("int").alias("lag"), v.alias("v"), n.alias("n_pairs"))
    sums = [entry("power_spec", None, F.avg(p), F.count(F.lit(1))), entry("var", None, F.var_pop("re") + F.var_pop("im"), F.count(F.lit(1)))]
    for lag in lags:
        dr, di = F.col(f"_re{lag}") - F.col("re"), F.col(f"_im{lag}") - F.col("im")
        sums.append(entry("d", lag, F.avg(dr * dr + di * di), F.count(f"_re{lag}")))
    wide = spectrum.withColumns(_at(lags)).groupBy(*Q).agg(F.array(*sums).alias("_all"))
    out = wide.select(*Q, F.explode("_all").alias("_x")).where("_x.n_pairs > 0")
    return out.select(*Q, "_x.what", (F.col("_x.lag") * float(delta_t)).alias("tau"), "_x.v")


def slices_of(sf: DataFrame, extra: DataFrame) -> DataFrame:
    """Structure function, power spectrum and variance below one another: seq_id, iy, ix, what (d, power_spec, var), tau (null for the two), v."""
    pick = lambda name: F.struct(F.lit(name).alias("what"), F.lit(None).cast("double").alias("tau"), F.col(name).alias("v"))
    both = extra.select(*Q, F.explode(F.array(pick("power_spec"), pick("var"))).alias("_x")).select(*Q, "_x.*")
    return sf.select(*Q, F.lit("d").alias("what"), "tau", F.col("d").alias("v")).unionByName(both)


def by_prefix(spectrum: DataFrame, lags: list[int], n_frames: int, delta_t: float = 1.0) -> DataFrame:
    """(forward sum + reversed sum - 2 autocorrelation) / pairs, from running sums in both directions.

    The running sums end at frames 0 to N - 1 - lag and lag to N - 1; the power of frames whose partner is missing is taken off again.
    """
    w = Window.partitionBy(*Q).orderBy("t")
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    forward = F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = F.sum(p).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = {f"_has{lag}": F.first("re").over(w.rangeBetween(-lag, -lag)).isNotNull() for lag in lags}
    rows = spectrum.withColumns({**_at(lags), **before, "_c": forward, "_r": back, "_p": p})
    sums = []
    for lag in lags:
        first, second = F.col("t") <= n_frames - 1 - lag, F.col("t") >= lag
        ends = F.max(F.when(first, F.col("_c"))) + F.max(F.when(second, F.col("_r")))
        alone = F.sum(F.when(first & F.col(f"_re{lag}").isNull(), F.col("_p")).otherwise(0.0)) + F.sum(F.when(second & ~F.col(f"_has{lag}"), F.col("_p")).otherwise(0.0))
        ac = F.sum(F.col("re") * F.col(f"_re{lag}") + F.col("im") * F.col(f"_im{lag}"))
        n = F.count(f"_re{lag}")
        sums.append(F.struct(F.lit(lag).alias("lag"), ((ends - alone - 2 * ac) / F.nullif(n, F.lit(0))).alias("d"), n.alias("n_pairs")))
    return _by_lag(rows, sums, delta_t)


def by_fft(spectrum: DataFrame, lags: list[int], n_frames: int, delta_t: float = 1.0, q_blocks: int = 64) -> DataFrame:
    """Autocorrelation by zero-padded FFT: the factor of the lags goes. A task holds a block of wavevectors with all their frames."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, place = np.unique(pdf[["iy", "ix"]].to_numpy(), axis=0, return_inverse=True)
        t = pdf["t"].to_numpy()
        s, here = np.zeros((len(keys), n_frames), complex), np.zeros((len(keys), n_frames))
        s[place, t], here[place, t] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), 1.0
        power = s.real**2 + s.imag**2
        ac = np.fft.ifft(np.abs(np.fft.fft(s, n=2 * n_frames, axis=1)) ** 2, axis=1).real[:, :n_frames]
        out = []
        for lag in lags:
            early, late = slice(None, n_frames - lag), slice(lag, None)
            n = (here[:, early] * here[:, late]).sum(1)
            ends = (power[:, early] * here[:, late]).sum(1) + (power[:, late] * here[:, early]).sum(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                d = (ends - 2 * ac[:, lag]) / n
            rows = pd.DataFrame({"seq_id": pdf["seq_id"].iloc[0], "lag": lag, "tau": lag * delta_t, "iy": keys[:, 0], "ix": keys[:, 1], "d": d, "n_pairs": n.astype("int32")})
            out.append(rows[n > 0])
        return pd.concat(out)

    keyed = spectrum.withColumn("_block", F.pmod(F.xxhash64("iy", "ix"), F.lit(q_blocks)))
    return keyed.groupBy("seq_id", "_block").applyInPandas(block, SF)


def choose_strategy(n_frames: int, lags: list[int]) -> str:
    """``fft`` once the lags outweigh the logarithm that it costs; the window form for few lags; either in blocks of the time axis once a sequence is long."""
    many, long = n_frames >= 64 and len(lags) > 2 * np.log2(2 * n_frames), n_frames >= LONG_FRAMES
    return ("fft_blocks" if long else "fft") if many else ("halo" if long else "lead")


def _chosen(n_frames: int, lags: Iterable[int], strategy: str) -> tuple[list[int], str]:
    if strategy != "auto" and strategy not in STRATEGIES:
        raise RuntimeError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    lags = checked_lags(lags, n_frames)
    return lags, choose_strategy(n_frames, lags) if strategy == "auto" else strategy


def structure_function(frames: DataFrame, grid: Grid, n_frames: int, lags: Iterable[int], window: Column | DataFrame | None = None, strategy: str = "auto", spectrum: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sf, sf_extra) of frames_cell, whose t runs from 0 to n_frames - 1. Unknown strategies, negative lags and lags beyond the sequence raise ``RuntimeError``."""
    lags, how = _chosen(n_frames, lags, strategy)
    if spectrum is None:
        spectrum = spectrum_of(frames, grid, window)
    if how == "join":
        sf = by_join(spectrum, lags, grid.delta_t)
    elif how == "lead":
        sf = by_lead(spectrum, lags, grid.delta_t)
    elif how == "prefix":
        sf = by_prefix(spectrum, lags, n_frames, grid.delta_t)
    elif how == "halo":
        sf = by_halo(spectrum, lags, grid.delta_t)
    elif how == "block_scan":
        sf = by_block_scan(spectrum, lags, n_frames, grid.delta_t)
    elif how == "fft_blocks":
        sf = by_fft_blocks(spectrum, lags, grid.delta_t, wavevectors=grid.ny * grid.nxh)
    else:
        blocks = max(64, -(-grid.ny * grid.nxh * n_frames * 16 // BLOCK_BYTES))
        sf = by_fft(spectrum, lags, n_frames, grid.delta_t, blocks)
    return sf, power_and_variance(spectrum)


def structure_slices(frames: DataFrame, grid: Grid, n_frames: int, lags: Iterable[int], window: Column | DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """The same as one table of slices, for callers that need both: one pass where the strategy is ``lead``."""
    checked, how = _chosen(n_frames, lags, strategy)
    if how == "lead":
        return slices_by_lead(spectrum_of(frames, grid, window), checked, grid.delta_t)
    return slices_of(*structure_function(frames, grid, n_frames, checked, window, how))


def spectrum_arrow(frames: DataFrame, grid: Grid, window: np.ndarray | None = None) -> DataFrame:
    return rfft2_arrow(pack(frames, grid.height, grid.width), grid, window)
