"""Spatial spectra of frames on the half plane, y shifted, divided by the root of the padded size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .raster import dense, gathered

SPECTRUM = "seq_id string, t int, iy int, ix int, re double, im double"
#: Pixels of a padded frame up to which the spectrum is two relational sums; each pixel gives nx/2 + ny rows there. Larger frames are transformed whole.
DFT_PIXELS = 1024
#: Pixels of a padded frame beyond which no row holds a frame: rows and columns are transformed apart.
FRAME_PIXELS = 1 << 24
#: Bytes of a column block of one frame, about.
COLUMN_BYTES = 1 << 22
LINES = "seq_id string, t int, y int, part int, re array<double>, im array<double>"


def windowed(frames: DataFrame, window: Column | DataFrame | None) -> DataFrame:
    """Pixels times the window: an expression over y and x, or a table (y, x, w)."""
    if window is None:
        return frames
    if isinstance(window, DataFrame):
        return frames.join(window.select("y", "x", "w"), ["y", "x"]).withColumn("v", F.col("v") * F.col("w")).drop("w")
    return frames.withColumn("v", F.col("v") * window)


def check_window(window: DataFrame, grid: Grid) -> None:
    """A window table has each pixel of the unpadded image once, else ``RuntimeError``."""
    inside = F.col("y").between(0, grid.height - 1) & F.col("x").between(0, grid.width - 1)
    rows, pixels, within = window.agg(F.count(F.lit(1)), F.count_distinct("y", "x"), F.count(F.when(inside & F.col("w").isNotNull(), 1))).first()
    if not rows == pixels == within == grid.height * grid.width:
        raise RuntimeError("the window must have the shape of the unpadded image")


def spectrum_of(frames: DataFrame, grid: Grid, window: Column | DataFrame | None = None) -> DataFrame:
    """The spectrum by the form that suits the frame's size: relational sums up to ``DFT_PIXELS``, an FFT a frame beyond, FFTs of rows and columns beyond ``FRAME_PIXELS``."""
    size = grid.ny * grid.nx
    return (dft_cells if size <= DFT_PIXELS else rfft2_cells if size <= FRAME_PIXELS else rfft2_pencil)(frames, grid, window)


def dft_cells(frames: DataFrame, grid: Grid, window: Column | DataFrame | None = None) -> DataFrame:
    """Spectrum by two sums, along x and then along y; cells that are absent count as 0, which also pads.

    Both aggregations group by (seq_id, t, ...), so one exchange by frame serves both.
    """
    if isinstance(window, DataFrame):
        check_window(window, grid)
    cells = windowed(frames.select("seq_id", "t", "y", "x", F.col("v").cast("double").alias("v")), window).repartition("seq_id", "t")
    ax = F.col("jx") * F.col("x") * (2 * math.pi / grid.nx)
    along_x = cells.withColumn("jx", F.explode(F.sequence(F.lit(0), F.lit(grid.nxh - 1))))
    along_x = along_x.groupBy("seq_id", "t", "y", "jx").agg(F.sum(F.col("v") * F.cos(ax)).alias("a"), F.sum(-F.col("v") * F.sin(ax)).alias("b"))
    ay = F.col("jy") * F.col("y") * (2 * math.pi / grid.ny)
    both = along_x.withColumn("jy", F.explode(F.sequence(F.lit(0), F.lit(grid.ny - 1))))
    norm = math.sqrt(grid.nx * grid.ny)
    both = both.groupBy("seq_id", "t", "jy", "jx").agg(
        (F.sum(F.col("a") * F.cos(ay) + F.col("b") * F.sin(ay)) / norm).alias("re"),
        (F.sum(F.col("b") * F.cos(ay) - F.col("a") * F.sin(ay)) / norm).alias("im"),
    )
    return both.select("seq_id", "t", F.pmod(F.col("jy") + grid.ny // 2, F.lit(grid.ny)).cast("int").alias("iy"), F.col("jx").alias("ix"), "re", "im")


def _transformed(seq: pa.Scalar, t: pa.Scalar, image: np.ndarray, grid: Grid, iy: np.ndarray, ix: np.ndarray) -> pa.RecordBatch:
    s = np.fft.fftshift(np.fft.rfft2(image, s=(grid.ny, grid.nx)), axes=0).ravel() / math.sqrt(grid.nx * grid.ny)
    n = len(s)
    columns = [pa.array([seq.as_py()] * n, pa.string()), pa.array(np.full(n, t.as_py(), np.int32)), pa.array(iy), pa.array(ix), pa.array(s.real.copy()), pa.array(s.imag.copy())]
    return pa.RecordBatch.from_arrays(columns, ["seq_id", "t", "iy", "ix", "re", "im"])


def _places(grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    iy, ix = (a.ravel().astype(np.int32) for a in np.indices((grid.ny, grid.nxh)))
    return iy, ix


def rfft2_cells(frames: DataFrame, grid: Grid, window: Column | DataFrame | None = None) -> DataFrame:
    """The same by an FFT a frame: cells meet by frame in one exchange, a task holds an Arrow batch of frames."""
    if isinstance(window, DataFrame):
        check_window(window, grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        iy, ix = _places(grid)
        for b in batches:
            for seq, t, at, v in zip(*(b.column(c) for c in ("seq_id", "t", "at", "v")), strict=True):
                yield _transformed(seq, t, dense(at, v, grid.height * grid.width).reshape(grid.height, grid.width), grid, iy, ix)

    cells = windowed(frames.select("seq_id", "t", "y", "x", F.col("v").cast("double").alias("v")), window)
    return gathered(cells, grid.width, []).mapInArrow(run, SPECTRUM)


def rfft2_arrow(packed: DataFrame, grid: Grid, window: np.ndarray | None = None) -> DataFrame:
    """The same from packed frames. Needs no exchange."""
    if window is not None and window.shape != (grid.height, grid.width):
        raise RuntimeError("the window must have the shape of the unpadded image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        iy, ix = _places(grid)
        for b in batches:
            for seq, t, pixels in zip(*(b.column(c) for c in ("seq_id", "t", "pixels")), strict=True):
                image = np.asarray(pixels.values, dtype=np.float64).reshape(grid.height, grid.width)
                yield _transformed(seq, t, image if window is None else image * window, grid, iy, ix)

    return packed.select("seq_id", "t", "pixels").mapInArrow(run, SPECTRUM)


def rfft2_pencil(frames: DataFrame, grid: Grid, window: Column | DataFrame | None = None, columns: int | None = None) -> DataFrame:
    """The same by two passes of one-dimensional FFTs and an exchange between them; a row holds a line of a frame at most, a task a block of columns.

    Cells meet by (sequence, t, y) and every line is transformed along x and cut in blocks of ``columns`` wavevectors, which meet by (sequence, t, block)
    to be transformed along y. Lines without a cell are zeros and need no row.
    """
    if isinstance(window, DataFrame):
        check_window(window, grid)
    columns = columns or max(1, COLUMN_BYTES // (16 * grid.ny))
    cuts = range(0, grid.nxh, columns)

    def along_x(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                f = np.fft.rfft(dense(b.column("at")[i], b.column("v")[i], grid.width), grid.nx)
                parts = [f[k : k + columns] for k in cuts]
                same = [pa.array([b.column(c)[i].as_py()] * len(parts), kind) for c, kind in (("seq_id", pa.string()), ("t", pa.int32()), ("y", pa.int32()))]
                ends = pa.array(np.r_[[*cuts], grid.nxh].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in (f.real, f.imag)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(parts), dtype=np.int32)), *lists], ["seq_id", "t", "y", "part", "re", "im"])

    def along_y(table: pa.Table) -> pa.Table:
        begin = table.column("part")[0].as_py() * columns
        width, y = min(columns, grid.nxh - begin), table.column("y").to_numpy()
        lines = np.zeros((grid.ny, width), complex)
        re, im = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width) for c in ("re", "im"))
        lines[y] = re + 1j * im
        s = np.fft.fftshift(np.fft.fft(lines, axis=0), axes=0).ravel() / math.sqrt(grid.nx * grid.ny)
        iy, ix = (a.ravel().astype(np.int32) for a in np.indices((grid.ny, width)))
        same = [pa.array([table.column("seq_id")[0].as_py()] * len(s), pa.string()), pa.array(np.full(len(s), table.column("t")[0].as_py(), np.int32))]
        return pa.Table.from_arrays([*same, pa.array(iy), pa.array(ix + np.int32(begin)), pa.array(s.real.copy()), pa.array(s.imag.copy())], ["seq_id", "t", "iy", "ix", "re", "im"])

    cells = windowed(frames.select("seq_id", "t", "y", "x", F.col("v").cast("double").alias("v")), window)
    line = F.collect_list(F.struct(F.col("x").cast("int").alias("at"), "v"))
    lines = cells.groupBy("seq_id", F.col("t").cast("int").alias("t"), F.col("y").cast("int").alias("y")).agg(line.alias("_b"))
    lines = lines.select("seq_id", "t", "y", F.col("_b.at").alias("at"), F.col("_b.v").alias("v")).mapInArrow(along_x, LINES)
    return lines.groupBy("seq_id", "t", "part").applyInArrow(along_y, SPECTRUM)


def full_plane(half: DataFrame, grid: Grid) -> DataFrame:
    """Half plane to full plane by point symmetry, x shifted too. Rows keep their other columns; a spectrum's im changes sign in the mirror."""
    half_x = (grid.nx + 1) // 2 if grid.nx % 2 else grid.nxh - 1
    own = half.withColumn("_jx", F.col("ix"))
    mirror = half.where((F.col("ix") > 0) & (F.col("ix") < half_x)).withColumn("_jx", F.lit(grid.nx) - F.col("ix"))
    mirror = mirror.withColumn("iy", F.pmod(F.lit(grid.ny) - F.col("iy"), F.lit(grid.ny)).cast("int") if grid.ny % 2 == 0 else (F.lit(grid.ny - 1) - F.col("iy")).cast("int"))
    if "im" in half.columns:
        mirror = mirror.withColumn("im", -F.col("im"))
    whole = own.unionByName(mirror)
    return whole.withColumn("ix", F.pmod(F.col("_jx") + grid.nx // 2, F.lit(grid.nx)).cast("int")).drop("_jx")
