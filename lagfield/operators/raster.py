"""Tables to image sequences: one row per (seq_id, t, y, x) that holds anything.

Absent cells of a frame are 0. A frame without any cell is missing: it has no spectrum, and pairs that need it are left
out; ``filled_frames`` makes such frames dark ones instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raster(table: DataFrame, t: Column, y: Column, x: Column, v: Column, seq_id: str = "s0") -> DataFrame:
    """Groups a table onto a grid; ``v`` is an aggregate. t is shifted to begin at 0."""
    cells = table.select(t.cast("int").alias("t"), y.cast("int").alias("y"), x.cast("int").alias("x"), "*").groupBy("t", "y", "x").agg(v.cast("double").alias("v"))
    first = cells.agg(F.min("t").alias("_first"))
    return cells.crossJoin(F.broadcast(first)).select(F.lit(seq_id).alias("seq_id"), (F.col("t") - F.col("_first")).cast("int").alias("t"), "y", "x", "v")


def lineitem_cube(lineitem: DataFrame, height: int = 8, width: int = 8) -> DataFrame:
    """Months x suppliers x parts, summed quantity."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return raster(lineitem, month, F.col("l_suppkey") % height, F.col("l_partkey") % width, F.sum("l_quantity"))


EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def event_cube(events: DataFrame, hours: float = 1) -> DataFrame:
    """Hours x users x event types, counts. Whole seconds a frame: ``hours`` is a multiple of 1 / 3600."""
    code = F.create_map(*[F.lit(a) for kv in EVENT_CODES.items() for a in kv])
    at = F.floor(F.unix_timestamp("ts") / round(3600 * hours))
    return raster(events, at, F.col("user_id") % 8, F.element_at(code, F.col("event_type")), F.count(F.lit(1)))


def filled_frames(cells: DataFrame, n_frames: int) -> DataFrame:
    """Gives every frame of 0 to n_frames - 1 that has no cell one cell of value 0: an empty frame then counts as dark, not as missing."""
    have = cells.select("seq_id", "t").distinct()
    all_frames = cells.select("seq_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))))
    dark = all_frames.join(have, ["seq_id", "t"], "left_anti").select("seq_id", F.col("t").cast("int").alias("t"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("v"))
    return cells.select("seq_id", "t", "y", "x", F.col("v").cast("double").alias("v")).unionByName(dark)


def gathered(cells: DataFrame, width: int, more: list[str]) -> DataFrame:
    """One row per frame: the places (row-major) and values of its cells, in any order."""
    both = F.collect_list(F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), F.col("v").cast("double").alias("v")))
    return cells.groupBy("seq_id", "t", *more).agg(both.alias("_b")).select("seq_id", "t", *more, F.col("_b.at").alias("at"), F.col("_b.v").alias("v"))


def dense(at: pa.Scalar, v: pa.Scalar, size: int) -> np.ndarray:
    """The pixels of a frame: absent cells are 0, repeated ones add up."""
    return np.bincount(at.values.to_numpy(), v.values.to_numpy(), size)


def pack(cells: DataFrame, height: int, width: int, more: list[str] | None = None) -> DataFrame:
    """frames_packed: one row per frame (and ``more`` keys) with its pixels in row-major order. A frame is the unit of work: it fits a task by definition."""
    keys = ["seq_id", "t", *(more or [])]
    types = dict(cells.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pixels = dense(b.column("at")[i], b.column("v")[i], height * width)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in keys), pa.array([pixels.tolist()], pa.list_(pa.float64()))], [*keys, "pixels"])

    filled = gathered(cells, width, more or []).mapInArrow(run, f"{schema}, pixels array<double>")
    return filled.select("seq_id", "t", *(more or []), F.lit(height).alias("height"), F.lit(width).alias("width"), "pixels")


def unpack(frames: DataFrame) -> DataFrame:
    """frames_packed to frames_cell."""
    return frames.select("seq_id", "t", "width", F.posexplode("pixels").alias("_p", "v")).select("seq_id", "t", F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"), (F.col("_p") % F.col("width")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def chunk_frames(frames: DataFrame, n_frames: int, chunk: int, overlap: int = 0) -> DataFrame:
    """Overlapped chunks along t: adds ``chunk`` and counts t from the chunk's begin.

    Chunk i holds [i * (chunk - overlap), that + chunk); the last one holds what is left.
    """
    if not 0 <= overlap < chunk:
        raise ValueError("overlap must be smaller than the chunk")
    step, starts, at = chunk - overlap, [], 0
    while at + chunk < n_frames:
        starts.append(at)
        at += step
    if at < n_frames:
        starts.append(at)
    last = len(starts) - 1
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - chunk + 1) / step)).cast("int")
    high = F.least(F.lit(last), F.floor(F.col("t") / step)).cast("int")
    out = frames.where(low <= high).withColumn("chunk", F.explode(F.sequence(low, high)))
    return out.withColumn("t", (F.col("t") - F.col("chunk") * step).cast("int")).where(F.col("t") < chunk)


def rank_frames(images: DataFrame, path_col: str = "path") -> DataFrame:
    """One image a file to a sequence: t is the rank of the path within its sequence."""
    return images.withColumn("t", (F.row_number().over(Window.partitionBy("seq_id").orderBy(path_col)) - 1).cast("int"))
