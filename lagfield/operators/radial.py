"""Weighted radial means over rings of the wavevector modulus."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, qgrid
from ..sources.shared import kept
from .temporal import slices_of


#: Edges up to which a pixel's ring is counted in a list of them; more are joined as a table.
FEW_EDGES = 64


def bin_edges(bins: int | Iterable[float], k_range: tuple[float, float] | None, k_all: Iterable[float]) -> tuple[list[float], float]:
    """(edges, lower limit). A number gives that many edges, the first ring being the degenerate k <= first edge; a list is taken as it is."""
    if isinstance(bins, (int, np.integer)) and not isinstance(bins, bool):
        low, high = (min(k_all), max(k_all)) if k_range is None else sorted(k_range)
        return [float(e) for e in np.linspace(low, high, int(bins))], float(low)
    if isinstance(bins, Iterable) and not isinstance(bins, (str, bytes)):
        edges = [float(e) for e in bins]
        if any(b < a for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError("bins must not decrease")
        return edges, edges[0]
    raise ValueError("bins is a number or a sequence of edges")


def rings_of(rows: DataFrame, edges: list[float], low: float) -> DataFrame:
    """Adds ``bin``: the ring i with edge[i-1] < k <= edge[i], null beyond the edges or below ``low``.

    A few edges are counted in place. More are a table of rings: every ring is entered in all cells of a regular division of k that it touches, rows meet the
    rings of their own cell, and the edges themselves decide. Cells are as many as edges, so that even edges give a row two rings to look at.
    """
    if len(edges) <= FEW_EDGES:
        spot = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("k")))
        return rows.withColumn("bin", F.when((spot < len(edges)) & (F.col("k") >= low), spot))
    width = (edges[-1] - low) / len(edges) or 1.0
    cell = lambda k: F.floor((k - low) / width)
    bounds = np.array(edges)
    table = rows.sparkSession.createDataFrame(pa.table({"bin": np.arange(len(edges), dtype=np.int32), "above": np.r_[-np.inf, bounds[:-1]], "upto": bounds}))
    # Ring 0 holds low alone, or what lies between it and the first edge; empty rings (equal edges) are in no cell.
    entered = table.where("above < upto").withColumn("_cell", F.explode(F.sequence(cell(F.greatest("above", F.lit(low))), cell(F.greatest("upto", F.lit(low))))))
    inside = F.col("k").between(low, edges[-1])
    rows = rows.withColumn("_at", F.when(inside, cell(F.col("k"))))
    found = rows.join(entered, (F.col("_at") == F.col("_cell")) & (F.col("k") > F.col("above")) & (F.col("k") <= F.col("upto")), "left")
    return found.drop("_at", "_cell", "above", "upto")


def azimuthal_average(values: DataFrame, grid_rows: DataFrame, edges: list[float], low: float, by: list[str], value: str = "d", mask: Column | None = None, weight: Column | None = None, eval_err: bool = True) -> DataFrame:
    """One row per group of ``by`` and ring: bin, k, avg, err.

    ``grid_rows`` has iy, ix, k, mult, and what mask and weight use. A pixel belongs to the ring i with edge[i-1] < k <= edge[i]; k beyond the
    edges or below ``low`` drops out, and so do masked pixels and those of weight 0, NaN or null; a negative weight raises ``ValueError``. The error is the
    unbiased weighted standard deviation (NaN for a single count). Empty rings give NaN and the middle of their edges.

    One pass over the pixels: pixels of a ring that weigh the same are reduced to count, mean and variance before the exchange, and the
    parts of a ring are joined by their distance from the ring's mean, so that no sum of squares cancels.
    """
    if weight is not None and not grid_rows.where(weight < 0).isEmpty():
        raise ValueError("weights must not be negative")
    given = weight if weight is not None else F.lit(1.0)
    w = F.col("mult") * given
    inside = F.col("bin").isNotNull() & (mask if mask is not None else F.lit(True)) & (w > 0) & ~F.isnan(w.cast("double"))
    # Pixels outside fall into a ring of null, so that a group without any pixel inside still has its empty rings.
    g = rings_of(grid_rows, edges, low).select("iy", "ix", "k", F.when(inside, F.col("bin")).alias("bin"), F.when(inside, w).otherwise(0).cast("double").alias("_w"), F.when(inside, w * given).otherwise(0).cast("double").alias("_w2"))
    part = values.join(g, ["iy", "ix"]).groupBy(*by, "bin", "_w", "_w2").agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_s"), F.sum("k").alias("_k"))
    ring = Window.partitionBy(*by, "bin")
    part = part.withColumn("_wn", F.col("_w") * F.col("_n")).withColumn("avg", F.sum(F.col("_wn") * F.col("_m")).over(ring) / F.nullif(F.sum("_wn").over(ring), F.lit(0.0)))
    apart = F.col("_m") - F.col("avg")
    sw = F.nullif(F.sum("_wn"), F.lit(0.0))
    bias = sw - F.sum(F.col("_w2") * F.col("_n")) / sw
    spread = F.sum(F.col("_wn") * (F.col("_s") + apart * apart))
    nan = F.lit(float("nan"))
    err = F.when(bias == 0, nan).otherwise(F.sqrt(spread / bias)) if eval_err else F.lit(None).cast("double")
    found = part.groupBy(*by, "bin").agg((F.sum(F.col("_w") * F.col("_k")) / sw).alias("k"), F.first("avg").alias("avg"), err.alias("err"))
    middles = [edges[0], *((a + b) / 2 for a, b in zip(edges, edges[1:], strict=False))]
    out = (_with_empty if len(edges) <= FEW_EDGES else _with_many_empty)(found, by, middles)
    nothing = F.col("_x").isNull()
    err_out = F.when(nothing, nan).otherwise(F.col("_x.err")) if eval_err else F.lit(None).cast("double")
    return out.select(*by, "bin", F.coalesce("_x.k", "_middle").alias("k"), F.when(nothing, nan).otherwise(F.col("_x.avg")).alias("avg"), err_out.alias("err"))


def _with_empty(found: DataFrame, by: list[str], middles: list[float]) -> DataFrame:
    """A row for each group and ring: ``_x`` what was found, ``_middle``. A group's rings are gathered in one row."""
    of_group = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct("k", "avg", "err")))))
    out = found.groupBy(*by).agg(of_group.alias("_found")).select(*by, "_found", F.posexplode(F.array(*map(F.lit, middles))).alias("bin", "_middle"))
    return out.withColumn("_x", F.try_element_at("_found", F.col("bin")))


def _with_many_empty(found: DataFrame, by: list[str], middles: list[float]) -> DataFrame:
    """The same with rows for the empty rings, which meet the found ones in one aggregation, and the middles as a table."""
    one = F.struct("k", "avg", "err")
    empty = found.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(middles) - 1))).alias("bin"), F.lit(None).cast("struct<k: double, avg: double, err: double>").alias("_x"))
    both = found.where("bin IS NOT NULL").select(*by, "bin", one.alias("_x")).unionByName(empty).groupBy(*by, "bin").agg(F.max("_x").alias("_x"))
    table = found.sparkSession.createDataFrame(pa.table({"bin": np.arange(len(middles), dtype=np.int32), "_middle": np.array(middles)}))
    return both.join(table, "bin")


def radial_slices(slices: DataFrame, grid: Grid, bins: int | Iterable[float] = 10, k_range: tuple[float, float] | None = None, mask: Column | None = None, weight: Column | None = None, eval_err: bool = True, keep: bool = False) -> tuple[DataFrame, DataFrame, list[float]]:
    """(aa, aa_extra, edges) of the slices of ``temporal.structure_slices``: one pass over all of them.

    ``keep`` writes the rings (a row per ring and slice) once in the shared folder, for callers that go on with both tables.
    """
    spark: SparkSession = slices.sparkSession
    ky, kx = grid.axes()
    edges, low = bin_edges(bins, k_range, [math.sqrt(a * a + b * b) for a in ky for b in kx])
    rings = azimuthal_average(slices, qgrid(spark, grid), edges, low, ["seq_id", "what", "tau"], "v", mask, weight, eval_err)
    if keep:
        rings = kept(rings, "rings")
    aa = rings.where("what = 'd'").select("seq_id", "bin", "k", "tau", F.col("avg").alias("d"), "err")
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    aa_extra = rings.where("what <> 'd'").groupBy("seq_id", "bin").agg(F.first("k").alias("k"), of("power_spec", "avg").alias("power_spec"), of("power_spec", "err").alias("power_spec_err"), of("var", "avg").alias("var"), of("var", "err").alias("var_err"))
    return aa, aa_extra, edges


def radial(sf: DataFrame, extra: DataFrame, grid: Grid, bins: int | Iterable[float] = 10, k_range: tuple[float, float] | None = None, mask: Column | None = None, weight: Column | None = None, eval_err: bool = True, keep: bool = False) -> tuple[DataFrame, DataFrame, list[float]]:
    """(aa, aa_extra, edges): rings of the structure function, and of power spectrum and variance; as ``radial_slices``."""
    return radial_slices(slices_of(sf, extra), grid, bins, k_range, mask, weight, eval_err, keep)
