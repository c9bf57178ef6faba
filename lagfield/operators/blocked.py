"""Lagged statistics of sequences of any length: the time axis is cut in blocks, so that tasks grow with frames and hold a block each.

Three mechanisms. Halo: a block gets copies of the frames up to the largest lag beyond its end, so that every pair lies in the block of its earlier
frame. Block scan: running sums inside blocks, and of block totals, level by level. Overlap-add: the autocorrelation of a block with
itself and its halo by FFT, added up over blocks. Each block gives additive sums (pairs, sum), which meet once more by wavevector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q = ["seq_id", "iy", "ix"]
#: Frames of a block at least; a block is never shorter than ``HALO_PARTS`` times the largest lag, so that the halo adds a quarter at most.
BLOCK_FRAMES, HALO_PARTS = 1024, 4
#: Totals that a window scans at once; more of them are blocks of their own.
SCAN_FAN = 1024
#: Bytes of frames that a task of the overlap-add form transforms at once, about.
FFT_BYTES = 1 << 24
SUMS = "seq_id string, iy int, ix int, lag int, s double, n long"


def block_frames(lags: list[int]) -> int:
    return max(BLOCK_FRAMES, HALO_PARTS * max(lags))


def with_halo(rows: DataFrame, block: int, before: int = 0, after: int = 0, t: str = "t") -> DataFrame:
    """Rows with the number of their ``block`` and ``own``; frames within ``before`` of its begin or ``after`` of its end come as copies (own is false).

    A frame is copied only into blocks whose halo it lies in: rows grow by (before + after) / block.
    """
    first, last = F.floor((F.col(t) - after) / block).cast("int"), F.floor((F.col(t) + before) / block).cast("int")
    out = rows.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return out.withColumn("own", F.col("block") == F.floor(F.col(t) / block))


def _power() -> Column:
    return F.col("re") * F.col("re") + F.col("im") * F.col("im")


def _partner(lag: int, part: str, w: Window) -> Column:
    return F.first(part).over(w.rangeBetween(lag, lag))


def _summed(rows: DataFrame, by: list[str], sums: list[Column]) -> DataFrame:
    """Rows of ``by``, lag and what ``sums`` (a struct a lag) hold, over the rows of each group."""
    wide = rows.groupBy(*by).agg(F.array(*sums).alias("_all"))
    return wide.select(*by, F.explode("_all").alias("_x")).select(*by, "_x.*")


def halo_sums(spectrum: DataFrame, lags: list[int], block: int | None = None) -> DataFrame:
    """(seq_id, iy, ix, block, lag, s, n): sums of |difference|^2 and pairs of every block of the earlier frame. One exchange, by wavevector and block."""
    block = block or block_frames(lags)
    w = Window.partitionBy(*Q, "block").orderBy("t")
    rows = with_halo(spectrum, block, after=max(lags)).withColumns({f"_{part}{lag}": _partner(lag, part, w) for lag in lags for part in ("re", "im")})
    sums = []
    for lag in lags:
        dr, di = F.col(f"_re{lag}") - F.col("re"), F.col(f"_im{lag}") - F.col("im")
        sums.append(F.struct(F.lit(lag).alias("lag"), F.sum(dr * dr + di * di).alias("s"), F.count(f"_re{lag}").alias("n")))
    return _summed(rows.where("own"), [*Q, "block"], sums).where("n > 0")


def by_halo(spectrum: DataFrame, lags: list[int], delta_t: float = 1.0, block: int | None = None) -> DataFrame:
    """The structure function by halo blocks. The exchange holds (1 + largest lag / block) times the spectrum; its groups grow with the frames."""
    return mean_of_sums(halo_sums(spectrum, lags, block), delta_t)


def mean_of_sums(sums: DataFrame, delta_t: float = 1.0) -> DataFrame:
    """Structure function of additive sums (s, n) per wavevector and lag, however many rows of them there are."""
    total = sums.groupBy(*Q, "lag").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    return total.select("seq_id", F.col("lag").cast("int").alias("lag"), (F.col("lag") * float(delta_t)).alias("tau"), "iy", "ix", (F.col("s") / F.col("n")).alias("d"), F.col("n").cast("int").alias("n_pairs"))


def prefix_sums(rows: DataFrame, by: list[str], order: str, value: str, out: str = "prefix", block: int = BLOCK_FRAMES, most: int | None = None, fan: int = SCAN_FAN) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the group's rows up to this one in the order of the whole number ``order`` (0 to ``most`` - 1).

    Running sums of blocks, and the running sums of their totals in the same way, until a group has ``fan`` totals at most: no window holds more than a block or ``fan`` rows
    of a group. Without ``most`` the largest ``order`` is looked up. Rows alike in group and order count together in the later one's sum, in no fixed order among themselves.
    """
    if most is None:
        most = (rows.agg(F.max(order)).first()[0] or 0) + 1
    if most <= block:
        return rows.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    number = f"{order}_block"
    rows = rows.withColumn(number, F.floor(F.col(order) / block))
    inside = rows.withColumn("_in", F.sum(value).over(Window.partitionBy(*by, number).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = rows.groupBy(*by, number).agg(F.sum(value).alias("_total"))
    before = prefix_sums(totals, by, number, "_total", "_upto", fan, -(-most // block), fan).select(*by, number, (F.col("_upto") - F.col("_total")).alias("_before"))
    return inside.join(before, [*by, number]).withColumn(out, F.col("_before") + F.col("_in")).drop(number, "_in", "_before")


def by_block_scan(spectrum: DataFrame, lags: list[int], n_frames: int, delta_t: float = 1.0, block: int | None = None) -> DataFrame:
    """(forward sum + reversed sum - 2 autocorrelation) / pairs, the running sums from ``prefix_sums`` and the autocorrelation from halo blocks.

    With C the running power, frames 0 to N - 1 - lag have C there, and frames lag to N - 1 have the whole power less C before lag; the power of frames whose partner
    is missing is taken off. C is known at present frames only: the last one up to N - 1 - lag, the first one from lag on.
    """
    block = block or block_frames(lags)
    scanned = prefix_sums(spectrum.withColumn("_p", _power()), Q, "t", "_p", "_c", block, n_frames)
    w = Window.partitionBy(*Q, "block").orderBy("t")
    look = {f"_{part}{lag}": _partner(lag, part, w) for lag in lags for part in ("re", "im")} | {f"_has{lag}": _partner(-lag, "re", w).isNotNull() for lag in lags}
    rows = with_halo(scanned, block, before=max(lags), after=max(lags)).withColumns(look).where("own")
    sums = []
    for lag in lags:
        first, second = F.col("t") <= n_frames - 1 - lag, F.col("t") >= lag
        alone = F.sum(F.when(first & F.col(f"_re{lag}").isNull(), F.col("_p")).otherwise(0.0)) + F.sum(F.when(second & ~F.col(f"_has{lag}"), F.col("_p")).otherwise(0.0))
        sums.append(
            F.struct(
                F.lit(lag).alias("lag"), F.count(f"_re{lag}").alias("n"), alone.alias("alone"), F.sum(F.col("re") * F.col(f"_re{lag}") + F.col("im") * F.col(f"_im{lag}")).alias("ac"),
                F.max(F.when(first, F.col("_c"))).alias("head"), F.min(F.when(second, F.col("_c") - F.col("_p"))).alias("before"), F.max("_c").alias("whole"),
            )
        )
    parts = _summed(rows, [*Q, "block"], sums)
    ends = F.max("head") + F.max("whole") - F.min("before")
    total = parts.groupBy(*Q, "lag").agg((ends - F.sum("alone") - 2 * F.sum("ac")).alias("s"), F.sum("n").alias("n"))
    return mean_of_sums(total, delta_t)


def _correlated(x: np.ndarray, y: np.ndarray, size: int, most: int) -> np.ndarray:
    """Sum over t of x(t) * conj(y(t + lag)) for the lags 0 to ``most``; rows are series. ``size`` holds a block with its halo, so that nothing wraps."""
    f = np.conj(np.fft.fft(x, size, 1)) * np.fft.fft(y, size, 1)
    return np.conj(np.fft.ifft(f, axis=1)[:, : most + 1])


def _block_sums(table: pa.Table, lags: list[int], block: int) -> pa.Table:
    """The sums of one time block and a group of wavevectors: own frames against own ones and the halo, by FFT."""
    iy, ix, t, re, im = (table.column(c).to_numpy() for c in ("iy", "ix", "t", "re", "im"))
    keys, place = np.unique(np.column_stack([iy, ix]), axis=0, return_inverse=True)
    most, begin = max(lags), int(table.column("block")[0].as_py()) * block
    at, width, size = t - begin, block + most, 1 << int(block + most - 1).bit_length()
    s, here = np.zeros((len(keys), width), complex), np.zeros((len(keys), width))
    s[place.ravel(), at], here[place.ravel(), at] = re + 1j * im, 1.0
    power = s.real**2 + s.imag**2
    own = lambda a: a[:, :block]
    n = np.rint(_correlated(own(here), here, size, most).real)
    total = _correlated(own(power), here, size, most).real + _correlated(own(here), power, size, most).real - 2 * _correlated(own(s), s, size, most).real
    pick = np.array(lags)
    n, total = n[:, pick], total[:, pick]
    some = n.ravel() > 0
    q, k = np.repeat(np.arange(len(keys)), len(lags))[some], np.tile(pick, len(keys))[some]
    columns = [pa.array([table.column("seq_id")[0].as_py()] * len(q), pa.string()), pa.array(keys[q, 0], pa.int32()), pa.array(keys[q, 1], pa.int32()), pa.array(k, pa.int32()), pa.array(total.ravel()[some]), pa.array(n.ravel()[some].astype(np.int64))]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in SUMS.split(", ")])


def by_fft_blocks(spectrum: DataFrame, lags: list[int], delta_t: float = 1.0, block: int | None = None, wavevectors: int | None = None) -> DataFrame:
    """Overlap-add: autocorrelation of blocks by FFT, Arrow in and out. A task's memory is that of one block of ``FFT_BYTES``, however long the sequence
    and however many lags; ``wavevectors`` (how many there are) lets a block hold several of them."""
    block = block or block_frames(lags)
    together = max(1, FFT_BYTES // (16 * 2 * (block + max(lags))))
    groups = max(1, -(-wavevectors // together)) if wavevectors else 1 << 16
    rows = with_halo(spectrum, block, after=max(lags)).withColumn("_part", F.pmod(F.xxhash64("iy", "ix"), F.lit(groups)))
    sums = rows.select(*Q, "t", "re", "im", "block", "_part").groupBy("seq_id", "_part", "block").applyInArrow(lambda table: _block_sums(table, lags, block), SUMS)
    return mean_of_sums(sums, delta_t)
