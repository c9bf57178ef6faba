"""Time-blocked lag statistics and FFTs of rows and columns: against the plain forms, at any block, and what their plans and rows hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagfield import Grid
from lagfield.operators import blocked, raster, spectral, temporal

FORMS = {
    "halo": lambda s, lags, n, block: blocked.by_halo(s, lags, 0.5, block),
    "block_scan": lambda s, lags, n, block: blocked.by_block_scan(s, lags, n, 0.5, block),
    "fft_blocks": lambda s, lags, n, block: blocked.by_fft_blocks(s, lags, 0.5, block, 6),
}


def spectrum(spark, n, missing=0.0, seed=1):
    r = random.Random(seed)
    rows = [(s, t, iy, ix, r.uniform(-9, 9), r.uniform(-9, 9)) for s in ("a", "b") for t in range(n) if r.random() >= missing for iy in range(2) for ix in range(3)]
    return spark.createDataFrame(rows, spectral.SPECTRUM)


def values(df):
    return {(r.seq_id, r.lag, r.tau, r.iy, r.ix, r.n_pairs): r.d for r in df.collect()}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize(("n", "missing", "block"), [(60, 0.0, 20), (97, 0.4, 13), (50, 0.9, 7), (40, 0.2, 64)])
def test_blocks_equal_the_self_join(spark, form, n, missing, block):
    lags = [1, 2, 5, 13, n - 1]
    s = spectrum(spark, n, missing).cache()
    got, want = values(FORMS[form](s, lags, n, block)), values(temporal.by_join(s, lags, 0.5))
    assert set(got) == set(want) and all(np.isclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)


@pytest.mark.parametrize("form", FORMS)
def test_blocks_of_an_empty_spectrum(spark, form):
    assert FORMS[form](spectrum(spark, 0), [1, 2], 10, 4).isEmpty()


def test_frames_meet_the_halo_of_the_blocks_that_need_them(spark):
    rows = spark.range(100).select(F.col("id").cast("int").alias("t"))
    got = blocked.with_halo(rows, 20, after=5)
    assert got.where("own").count() == 100 and got.count() == 100 + 4 * 5
    assert {(r.t, r.block) for r in got.where("NOT own").collect()} == {(b * 20 + k, b - 1) for b in range(1, 5) for k in range(5)}
    far = blocked.with_halo(rows, 10, before=3, after=25)
    assert {(r.t, r.block) for r in far.collect()} >= {(34, 1), (34, 2), (34, 3), (29, 3), (20, 0)} and far.groupBy("t", "block").count().where("count > 1").isEmpty()


def test_groups_grow_with_frames_and_exchange_stays_small(spark):
    lags = [1, 250]
    assert blocked.block_frames(lags) == 1024 and blocked.block_frames([5000]) == 20_000
    for n, blocks in ((2000, 2), (8000, 8)):
        s = spark.range(n).select(F.lit("s").alias("seq_id"), F.col("id").cast("int").alias("t"), (F.col("id") * 0).cast("int").alias("iy"), (F.col("id") * 0).cast("int").alias("ix"), F.rand(3).alias("re"), F.rand(4).alias("im"))
        assert blocked.halo_sums(s, lags).select("block").distinct().count() == blocks
        assert blocked.with_halo(s, 1024, after=250).count() <= n * (1 + 250 / 1024)
    windows = blocked.by_halo(s, lags)._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1:]
    assert windows and all("block#" in w.split(" ASC")[0].rpartition(", ")[0] for w in windows)


def test_no_scan_holds_a_whole_sequence(spark):
    """Every window of the block scan is over a block, or over totals of which there are few."""
    s = spark.range(5000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 9000)).alias("g"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    want = np.cumsum(np.arange(5000) % 7)
    out = blocked.prefix_sums(s, ["g"], "t", "v", block=10, fan=8)
    assert {r.t: r.prefix for r in out.collect()} == dict(enumerate(want.tolist())) and out.columns == ["g", "t", "v", "prefix"]
    windows = out._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1:]
    keys = [w.split("ASC")[0].split(", ") for w in windows]
    # 5000 rows in blocks of 10, 500 totals in blocks of 8, 63 in blocks of 8, 8 at once.
    assert len(keys) == 4 and sum(len(k) == 3 for k in keys) == 3
    gaps = s.where("t % 3 = 1 AND t > 700")
    got = {r.t: r.prefix for r in blocked.prefix_sums(gaps, ["g"], "t", "v", block=16, fan=4).collect()}
    at = [t for t in range(5000) if t % 3 == 1 and t > 700]
    assert got == dict(zip(at, np.cumsum([float(t % 7) for t in at]).tolist(), strict=True))
    assert blocked.prefix_sums(s.where("false"), ["g"], "t", "v").isEmpty()


def test_strategies_by_name_and_length(spark):
    g = Grid.of(3, 4)
    r = np.random.default_rng(2).normal(size=(30, 3, 4))
    frames = spark.createDataFrame([("s", t, y, x, float(r[t, y, x])) for t in range(30) for y in range(3) for x in range(4)], "seq_id string, t int, y int, x int, v double")
    want = values(temporal.structure_function(frames, g, 30, [1, 3, 29], strategy="join")[0])
    for how in temporal.STRATEGIES:
        got = values(temporal.structure_function(frames, g, 30, [1, 3, 29], strategy=how)[0])
        assert set(got) == set(want) and all(np.isclose(got[k], want[k], rtol=1e-9) for k in want), how
    assert temporal.choose_strategy(100, [1, 2]) == "lead" and temporal.choose_strategy(100_000, [1, 2]) == "halo"
    assert temporal.choose_strategy(100, list(range(1, 90))) == "fft" and temporal.choose_strategy(100_000, list(range(1, 90))) == "fft_blocks"


@pytest.mark.parametrize(("height", "width", "columns"), [(5, 7, 2), (8, 6, 100), (1, 9, 1), (13, 1, None)])
def test_pencils_equal_the_whole_transform(spark, height, width, columns):
    g = Grid.of(height, width)
    a = np.random.default_rng(5).normal(size=(3, height, width))
    a[1, 1:] = 0.0
    cells = [("s", t, y, x, float(a[t, y, x])) for t in range(3) for y in range(height) for x in range(width) if a[t, y, x] != 0]
    frames = spark.createDataFrame(cells, "seq_id string, t int, y int, x int, v double")
    got = {(r.t, r.iy, r.ix): complex(r.re, r.im) for r in spectral.rfft2_pencil(frames, g, columns=columns).collect()}
    want = {(t, iy, ix): v for t in range(3) for (iy, ix), v in np.ndenumerate(np.fft.fftshift(np.fft.rfft2(a[t], s=(g.ny, g.nx)), axes=0) / np.sqrt(g.nx * g.ny))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_row_of_a_pencil_holds_a_frame(spark, monkeypatch):
    """The exchange between the passes holds pieces of lines, and the choice of form follows the size."""
    g, sizes = Grid.of(64, 48), []
    frames = spark.range(64 * 48).select(F.lit("s").alias("seq_id"), F.lit(0).alias("t"), F.floor(F.col("id") / 48).cast("int").alias("y"), (F.col("id") % 48).cast("int").alias("x"), F.rand(1).alias("v"))
    out = spectral.rfft2_pencil(frames, g, columns=5)
    assert out.count() == g.ny * g.nxh
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "mapInArrow" in plan.replace("MapInArrow", "mapInArrow") and "FlatMapGroupsInArrow" in plan
    for name in ("dft_cells", "rfft2_cells", "rfft2_pencil"):
        monkeypatch.setattr(spectral, name, lambda *a, n=name: sizes.append(n))
    for shape in ((8, 8), (100, 100), (5000, 5000)):
        spectral.spectrum_of(None, Grid.of(*shape))
    assert sizes == ["dft_cells", "rfft2_cells", "rfft2_pencil"]


def test_a_window_table_serves_the_pencil(spark):
    frames = raster.filled_frames(spark.createDataFrame([("s", 0, 1, 1, 2.0), ("s", 0, 2, 0, 3.0)], "seq_id string, t int, y int, x int, v double"), 2)
    window = spark.range(12).select(F.floor(F.col("id") / 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"), (F.col("id") + 1.0).alias("w"))
    a, b = ({(r.t, r.iy, r.ix): (r.re, r.im) for r in f(frames, Grid.of(3, 4), window).collect()} for f in (spectral.rfft2_pencil, spectral.dft_cells))
    assert set(a) == set(b) and all(np.allclose(a[k], b[k], atol=1e-12) for k in b)
    with pytest.raises(RuntimeError):
        spectral.rfft2_pencil(frames, Grid.of(3, 4), window.where("y < 2"))
