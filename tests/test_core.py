"""Operators against numpy, laws that must hold, and the errors that callers rely on."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagfield.functions import grid as G
from lagfield.functions import lags as L
from lagfield.functions.models import MODELS, Hint
from lagfield.functions.spline import interpolate
from lagfield.operators import fit, isf, merge, noise, radial, raster, spectral, temporal
from lagfield.sources import container, tiff
from lagfield.streaming import lagged

N, H, W = 12, 5, 6


@pytest.fixture(scope="module")
def movie():
    return np.random.default_rng(0).normal(size=(N, H, W)).round(3)


@pytest.fixture(scope="module")
def cells(spark, movie):
    t, y, x = (a.ravel() for a in np.indices(movie.shape))
    return spark.createDataFrame(pd.DataFrame({"seq_id": "s0", "t": t.astype("int32"), "y": y.astype("int32"), "x": x.astype("int32"), "v": movie.ravel()}))


@pytest.fixture(scope="module")
def sf(cells):
    a, b = temporal.structure_function(cells, G.Grid.of(H, W), N, [1, 2, 3, 4, 5], strategy="join")
    return a.cache(), b.cache()


def spectra(movie):
    return np.fft.fftshift(np.fft.rfft2(movie), axes=1) / np.sqrt(H * W)


@pytest.mark.parametrize("how", temporal.STRATEGIES)
def test_strategies_agree_with_numpy(cells, movie, how):
    got = temporal.structure_function(cells, G.Grid.of(H, W), N, [3, 1], strategy=how)[0].toPandas()
    s = spectra(movie)
    for r in got.itertuples():
        assert np.isclose(r.d, (np.abs(s[r.lag :, r.iy, r.ix] - s[: -r.lag, r.iy, r.ix]) ** 2).mean(), rtol=1e-9)


def test_parseval_and_variance_order(sf, movie):
    extra = sf[1].join(G.qgrid(sf[1].sparkSession, G.Grid.of(H, W)), ["iy", "ix"]).toPandas()
    assert np.isclose((extra.power_spec * extra.mult).sum(), (movie**2).sum() / N)
    assert (extra.power_spec >= extra["var"] - 1e-12).all() and (extra["var"] >= -1e-12).all()


def test_constant_sequence_is_still(spark):
    c = spark.range(8).select(F.lit("s0").alias("seq_id"), F.col("id").cast("int").alias("t"), F.lit(0).alias("y"), F.lit(1).alias("x"), F.lit(2.5).alias("v"))
    sf, extra = temporal.structure_function(c, G.Grid.of(2, 3), 8, [1, 2])
    assert sf.agg(F.max(F.abs("d"))).first()[0] < 1e-12 and extra.agg(F.max(F.abs("var"))).first()[0] < 1e-12


@pytest.mark.parametrize("shape", [(4, 6), (5, 6), (4, 5), (5, 5)])
def test_full_plane_is_the_full_transform(spark, shape):
    a = np.random.default_rng(1).normal(size=(1, *shape))
    y, x = (i.ravel() for i in np.indices(shape))
    c = spark.createDataFrame(pd.DataFrame({"seq_id": "s0", "t": 0, "y": y, "x": x, "v": a.ravel()}))
    g = G.Grid(*shape, *shape)
    got = spectral.full_plane(spectral.dft_cells(c, g), g).toPandas()
    want = np.fft.fftshift(np.fft.fft2(a[0])) / np.sqrt(a[0].size)
    assert len(got) == a[0].size
    assert all(np.isclose(complex(r.re, r.im), want[r.iy, r.ix], atol=1e-9) for r in got.itertuples())


def test_errors(cells):
    g = G.Grid.of(H, W)
    for args, kw in (((cells, g, N, [-1]), {}), ((cells, g, N, [N]), {}), ((cells, g, N, [1]), {"strategy": "gpu"})):
        with pytest.raises(RuntimeError):
            temporal.structure_function(*args, **kw)
    with pytest.warns(UserWarning):
        assert L.checked_lags([0, 2, 2, 1], N) == [1, 2]
    with pytest.raises(RuntimeError):
        spectral.rfft2_arrow(raster.pack(cells, H, W), g, np.ones((H + 1, W)))
    with pytest.raises(ValueError):
        radial.bin_edges([0, 5, 1], None, [])
    with pytest.raises(ValueError):
        radial.bin_edges("x", None, [])
    with pytest.raises(RuntimeError):
        G.sector_weight(kind="box")
    with pytest.raises(ValueError):
        raster.chunk_frames(cells, N, 4, 4)


def test_number_of_bins_is_the_edge_list(sf):
    g = G.Grid.of(H, W)
    aa, _, edges = radial.radial(*sf, g, bins=4, k_range=(3.0, 0.0))
    bb, _, _ = radial.radial(*sf, g, bins=edges)
    a, b = (x.orderBy("bin", "tau").toPandas() for x in (aa, bb))
    pd.testing.assert_frame_equal(a, b)
    assert radial.radial(*sf, g, bins=4, eval_err=False)[0].where("err IS NOT NULL").isEmpty()


def test_slices_are_the_two_tables(cells, sf):
    g = G.Grid.of(H, W)
    want = temporal.slices_of(*sf).orderBy("what", "tau", "iy", "ix").toPandas()
    for how in ("lead", "fft", "auto"):
        got = temporal.structure_slices(cells, g, N, [5, 1, 2, 3, 4], strategy=how).orderBy("what", "tau", "iy", "ix").toPandas()
        assert (got.what == want.what).all() and np.allclose(got.v, want.v, atol=1e-12) and np.allclose(got.tau.fillna(0), want.tau.fillna(0))
    with pytest.raises(RuntimeError):
        temporal.structure_slices(cells, g, N, [1], strategy="gpu")


def test_radial_average_by_hand(sf):
    g = G.Grid.of(H, W)
    aa, _, edges = radial.radial(*sf, g, bins=5)
    ky, kx = g.axes()
    k = np.hypot(np.array(ky)[:, None], np.array(kx)[None])
    mult = np.where(np.isin(np.arange(g.nxh), [0, g.nxh - 1]), 1, 2) * np.ones((g.ny, 1))
    d = np.zeros((g.ny, g.nxh))
    for r in sf[0].where("lag = 2").toPandas().itertuples():
        d[r.iy, r.ix] = r.d
    for r in aa.where("tau = 2").toPandas().itertuples():
        low = edges[r.bin - 1] if r.bin else -1
        m = (k > low) & (k <= edges[r.bin] + 1e-12)
        w = mult[m]
        if not len(w):
            assert np.isnan(r.d) and np.isnan(r.err)
            continue
        mean = (w * d[m]).sum() / w.sum()
        assert np.isclose(r.d, mean)
        bias = w.sum() - w.sum() / w.sum()
        if bias > 0:
            assert np.isclose(r.err, np.sqrt((w * (d[m] - mean) ** 2).sum() / bias))
        else:
            assert np.isnan(r.err)


def test_polyfit_noise_is_numpys(sf):
    g = G.Grid.of(H, W)
    aa, extra, _ = radial.radial(*sf, g, bins=4)
    got = {r.bin: r for r in noise.radial_noise(aa, extra, "polyfit").toPandas().itertuples()}
    for b, c in aa.toPandas().sort_values("tau").groupby("bin"):
        y, e = c.d.to_numpy()[:5], c.err.to_numpy()[:5]
        w = None if np.isnan(e).any() else 1 / e
        p, cov = np.polyfit(np.arange(1, 6), y, 2, w=w, cov="unscaled")
        assert np.isclose(got[b].b, p[-1], rtol=1e-7) and np.isclose(got[b].b_err, np.sqrt(cov[-1, -1]), rtol=1e-7)
    plane = noise.plane_noise(*sf, G.qgrid(aa.sparkSession, g), "polyfit").toPandas()
    one = plane.iloc[0]
    y = sf[0].where(f"iy = {one.iy} AND ix = {one.ix}").orderBy("tau").toPandas().d.to_numpy()
    p, cov = np.polyfit(np.arange(1, 6), y, 2, cov=True)
    assert np.isclose(one.b, p[-1]) and np.isclose(one.b_err, np.sqrt(cov[-1, -1]))
    with pytest.raises(RuntimeError):
        noise.plane_noise(*sf, G.qgrid(aa.sparkSession, g), "polyfit", num_points=3)
    with pytest.raises(RuntimeError):
        noise.radial_noise(aa, extra, "none")
    with pytest.raises(RuntimeError):
        isf.intermediate_scattering(aa, extra, "zero", "mean")


def curves(spark, tau, rows, err=None):
    data = [("s0", b, 0.5 + b, float(t), float(v), None if err is None else float(v) * err) for b, f in rows for t, v in zip(tau, f(np.asarray(tau, float)), strict=True)]
    return spark.createDataFrame(data, "seq_id string, bin int, k double, tau double, d double, err double")


def test_resample_and_merge(spark):
    tau = np.arange(1, 15)
    c = curves(spark, tau, [(0, lambda t: 3 * t**1.5), (1, lambda t: t * np.nan)], 0.1)
    out = merge.resample(c, [1.5, 7.25, 20.0]).orderBy("bin", "tau").toPandas()
    assert np.allclose(out.d[:3], 3 * np.array([1.5, 7.25, 20.0]) ** 1.5) and np.allclose(out.err[:3], out.d[:3] * 0.1) and out.d[3:].isna().all()
    fast, slow = curves(spark, np.arange(1, 13), [(0, lambda t: t**0.5)], 0.1), curves(spark, np.arange(4, 60, 4), [(0, lambda t: 2 * t**0.5)], 0.1)
    m = merge.melt(slow, fast).orderBy("tau").toPandas()
    assert np.allclose(m.d, 2 * m.tau**0.5) and m.tau.is_unique and m.tau.max() == 56
    both, again = (merge.mergesort(a, b).orderBy("tau", "d").toPandas() for a, b in ((fast, slow), (slow, fast)))
    pd.testing.assert_frame_equal(both, again)
    extra = lambda n: fast.select("seq_id", "bin").distinct().withColumn("power_spec", F.lit(n))
    for a, b in (((fast, extra(1)), (slow, extra(2))), ((slow, extra(2)), (fast, extra(1)))):
        assert merge.melt_extra(*a, *b).first().power_spec == 2 and merge.mergesort_extra(*a, *b).first().power_spec == 2
    bare = fast.withColumn("err", F.lit(None).cast("double"))
    assert merge.mergesort(bare, slow).where("err IS NOT NULL").isEmpty()


def test_spline_passes_and_extends():
    x = np.array([0.0, 1, 2.5, 3, 4.2, 6])
    for degree in (2, 3):
        for power in range(degree + 1):
            assert np.allclose(interpolate(x, x**power, np.array([-1.0, 0.7, 5.9, 7.5]), degree), np.array([-1.0, 0.7, 5.9, 7.5]) ** power)
        assert np.allclose(interpolate(x, np.sin(x), x, degree), np.sin(x))


def test_fits_find_planted_parameters(spark):
    tau, m = np.linspace(0.2, 12, 40), MODELS["stretched_exponential"]
    rows = [(b, lambda t, b=b: m(t, A=2.0 + b, Gamma=0.3 * (b + 1), beta=0.8, B=0.1)) for b in range(3)]
    c = curves(spark, tau, rows, 0.01)
    out = fit.wide(fit.fit_multik(c, m, 1, use_err=True), m).orderBy("bin").toPandas()
    assert np.allclose(out.Gamma, [0.3, 0.6, 0.9], rtol=1e-4) and np.allclose(out.A, [2, 3, 4], rtol=1e-4) and out.success.all()
    alone = fit.wide(fit.fit_curves(c, m, params={"beta": Hint(0.8, vary=False)}), m).orderBy("bin").toPandas()
    assert np.allclose(alone.Gamma, [0.3, 0.6, 0.9], rtol=1e-4) and (alone.beta == 0.8).all()
    tied = fit.wide(fit.fit_multik(c, m, 0, fixed_params={"beta": [0.8] * 3}, fixed_params_expr={"B": ["A / 20", "A / 30", "0.1 + 0 * A"]}), m).orderBy("bin").toPandas()
    assert np.allclose(tied.B, [0.1, 0.1, 0.1], rtol=1e-3)
    with pytest.raises(ValueError):
        fit.evaluate("__import__('os')", {})
    nothing = fit.fit_curves(curves(spark, tau, [(0, lambda t: t * np.nan)]), m).first()
    assert not nothing.success


def test_lags():
    assert L.logspace_int(10, 5, True) == [1, 2, 3, 6, 10] and L.logspace_int(10, 5) == [1, 2, 3, 4, 7]
    assert L.fibonacci(1) == [1, 2] and L.fibonacci(13) == [1, 2, 3, 5, 8] and L.fibonacci(13, True)[-1] == 13


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 40), st.booleans())
def test_logspace_rises(stop, num, endpoint):
    got = L.logspace_int(stop, num, endpoint)
    assert got == sorted(set(got)) and got[0] == 1


def test_fast_lengths():
    assert [G.next_fast_len(n) for n in (13, 11, 97, 8, 0)] == [14, 11, 98, 8, 1]
    assert G.next_fast_len(13, "cpp") == 13 and G.next_fast_len(11, "cuda") == 12 and G.next_fast_len(7, "cuda", True) == 8
    assert [G.next_power_of_2(n) for n in (1, 2, 3, 9)] == [1, 2, 4, 16]


@pytest.mark.parametrize("missing", [[2], [0, 1, 5], [3, 4, 7, 11]])
def test_strategies_agree_where_frames_are_missing(cells, movie, missing):
    g, s = G.Grid.of(H, W), spectra(movie)
    some = cells.where(~F.col("t").isin(missing))
    for how in temporal.STRATEGIES:
        got = temporal.structure_function(some, g, N, [1, 2, 3, 9, 11], strategy=how)[0].toPandas()
        for lag in (1, 2, 3, 9, 11):
            pairs = [(t, t + lag) for t in range(N - lag) if t not in missing and t + lag not in missing]
            rows = got[got.lag == lag]
            assert len(rows) == (g.ny * g.nxh if pairs else 0), how
            for r in rows.itertuples():
                want = np.mean([abs(s[b, r.iy, r.ix] - s[a, r.iy, r.ix]) ** 2 for a, b in pairs])
                assert np.isclose(r.d, want, rtol=1e-9) and r.n_pairs == len(pairs), how


def test_empty_frames_are_missing_unless_filled(cells, movie):
    g = G.Grid.of(H, W)
    dark = np.where((np.arange(N) == 4)[:, None, None], 0, movie)
    s = spectra(dark)
    got = temporal.structure_function(raster.filled_frames(cells.where("t <> 4"), N), g, N, [2])[0].toPandas()
    for r in got.itertuples():
        assert r.n_pairs == N - 2 and np.isclose(r.d, (np.abs(s[2:, r.iy, r.ix] - s[:-2, r.iy, r.ix]) ** 2).mean())


def test_large_frames_take_the_fft_and_agree(cells, monkeypatch):
    g = G.Grid.of(H, W)
    small = spectral.spectrum_of(cells, g, G.blackman(H, W))
    monkeypatch.setattr(spectral, "DFT_PIXELS", 0)
    large = spectral.spectrum_of(cells, g, G.blackman(H, W))
    assert "MapInArrow" in large._jdf.queryExecution().toString() and "MapInArrow" not in small._jdf.queryExecution().toString()
    a, b = (x.orderBy("t", "iy", "ix").toPandas() for x in (small, large))
    assert np.allclose(a.re, b.re) and np.allclose(a.im, b.im)
    assert temporal.choose_strategy(N, [1, 2]) == "lead" and temporal.choose_strategy(1000, list(range(1, 60))) == "fft"


def test_pack_adds_up_repeated_cells_and_fills_gaps(spark):
    c = spark.createDataFrame([("s", 0, 0, 1, 2.0), ("s", 0, 0, 1, 3.0), ("s", 2, 1, 0, 1.0)], "seq_id string, t int, y int, x int, v double")
    assert {r.t: r.pixels for r in raster.pack(c, 2, 2).collect()} == {0: [0.0, 5.0, 0.0, 0.0], 2: [0.0, 0.0, 1.0, 0.0]}


def test_window_tables_have_the_images_shape(cells, spark):
    g = G.Grid.of(H, W)
    whole = spark.range(H * W).select(F.floor(F.col("id") / W).cast("int").alias("y"), (F.col("id") % W).cast("int").alias("x"), F.lit(2.0).alias("w"))
    twice = spectral.dft_cells(cells, g, whole).where("t = 1 AND iy = 0 AND ix = 1").first()
    once = spectral.dft_cells(cells, g).where("t = 1 AND iy = 0 AND ix = 1").first()
    assert np.isclose(twice.re, 2 * once.re)
    for bad in (whole.where("y > 0"), whole.unionByName(whole.where("y = 1")), whole.withColumn("x", F.col("x") + 1)):
        with pytest.raises(RuntimeError):
            spectral.dft_cells(cells, g, bad)
        with pytest.raises(RuntimeError):
            spectral.rfft2_cells(cells, g, bad)


def test_negative_weights_and_foreign_inputs_raise(sf):
    g = G.Grid.of(H, W)
    with pytest.raises(ValueError):
        radial.radial(*sf, g, bins=4, weight=F.col("ky"))
    nothing = radial.radial(*sf, g, bins=4, mask=F.lit(False))[0].toPandas()
    assert len(nothing) == 4 * 5 and nothing.d.isna().all() and nothing.err.isna().all() and nothing.k.notna().all()
    aa, extra, _ = radial.radial(*sf, g, bins=4)
    assert noise.noise_of(aa, extra).columns == ["seq_id", "bin", "b", "b_err"] and noise.noise_of(*sf, grid_rows=G.qgrid(aa.sparkSession, g)).columns == ["seq_id", "iy", "ix", "b", "b_err"]
    for wrong in (3, extra, sf[0]):
        with pytest.raises(TypeError):
            noise.noise_of(wrong, extra)
    table = aa.groupBy("seq_id", "bin").agg(F.lit(0.1).alias("b"), F.lit(0.0).alias("b_err"))
    for bad in (table.where("bin > 0"), table.unionByName(table.where("bin = 1"))):
        with pytest.raises(RuntimeError):
            isf.intermediate_scattering(aa, extra, bad)


def test_fits_that_run_out_of_steps_do_not_succeed():
    m, x = MODELS["stretched_exponential"], np.linspace(0.2, 12, 40)
    y = m(x, A=2.0, Gamma=0.3, beta=0.8, B=0.1)
    assert not fit.least_squares(m, x, y, dict(m.hints), steps=1)[2] and fit.least_squares(m, x, y, dict(m.hints))[2]


def test_container_round_trip(spark, sf, tmp_path):
    g = G.Grid(H, W, H, W, 0.123, 0.043)
    (path,) = container.save_sf(*sf, g, str(tmp_path), "sub/{}".format)
    got = container.load(spark, path)
    want = sf[0].toPandas().sort_values(["lag", "iy", "ix"]).d.to_numpy()
    assert np.array_equal(got.orderBy("slice", "iy", "ix").toPandas().d, want)
    assert got.where("slice = 2").select("slice").distinct().collect()[0][0] == 2
    assert container.metadata(path)["pixel_size"] == 0.123 and np.allclose(container.extras(path)["kx"], g.axes()[1])
    assert container.slice_of(path, "sf", 4).shape == (H, W // 2 + 1)
    with pytest.raises(IndexError):
        container.slice_of(path, "sf", 5)
    for where, kept in (("slice >= 3 AND slice >= 1", {3, 4}), ("slice <= 2 AND slice <= 4", {0, 1, 2}), ("slice IN (1, 2, 3) AND slice IN (2, 3, 4)", {2, 3}), ("slice > 1 AND slice < 4 AND slice <> 2", {3}), ("slice = 1 AND slice = 2", set())):
        assert {r.slice for r in got.where(where).select("slice").distinct().collect()} == kept
    plane = spectral.full_plane(sf[0].where("lag = 3"), g).toPandas()
    full = container.slice_of(path, "sf", 2, full=True)
    assert full.shape == (H, W) and all(np.isclose(full[r.iy, r.ix], r.d) for r in plane.itertuples())
    assert container.grid_of(spark, path).count() == H * (W // 2 + 1)
    aa, extra, edges = radial.radial(*sf, g, bins=4)
    (path,) = container.save_radial(aa, str(tmp_path), edges, extra)
    back = container.load(spark, path).orderBy("bin", "tau").toPandas()
    assert np.allclose(back.d, aa.orderBy("bin", "tau").toPandas().d, equal_nan=True) and np.allclose(container.extras(path)["bin_edges"], edges)
    assert np.allclose(container.slice_of(path, "aa", 1, err=True)[:5], back[back.bin == 1].err, equal_nan=True)
    f = isf.intermediate_scattering(aa, extra, "zero")
    (path,) = container.save_radial(f, str(tmp_path), edges, kind="isf")
    assert np.allclose(container.load(spark, path).orderBy("bin", "tau").toPandas().f, f.orderBy("bin", "tau").toPandas().f, equal_nan=True)
    bad = tmp_path / "x.aa.ddm"
    bad.write_bytes(b"LL" + b"\x49\x00" + b"\0" * 80)
    with pytest.raises(RuntimeError):
        container.metadata(str(bad))
    bad.write_bytes(b"LL\x16\x00\x00\x02" + b"\0" * 80)
    with pytest.raises(OSError):
        container.metadata(str(bad))
    with pytest.raises(RuntimeError):
        container.load(spark, "x.npy")
    with pytest.raises(NotImplementedError):
        container.array_format(np.int32)


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4", "f8"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    frames = [np.arange(12).reshape(3, 4).astype(dtype) + i for i in range(5)]
    path = str(tmp_path / "a.tif")
    with open(path, "wb") as f:
        f.write(tiff.tiff_bytes(frames, "made here"))
    got = tiff.read_images(spark, path, seq=[1, 3]).orderBy("t").collect()
    assert [r.t for r in got] == [1, 3] and got[1].pixels == frames[3].ravel().tolist()
    assert tiff.read_metadata(spark, path).first().tags["ImageDescription"] == "made here"


@pytest.mark.parametrize("order", ["TYX", "YXT", "XYT", "tyx", "CYX", "YCX"])
def test_axis_orders(spark, tmp_path, order):
    stack = np.random.default_rng(3).integers(0, 99, (4, 3, 5)).astype("u2")
    path = str(tmp_path / "a.tif")
    with open(path, "wb") as f:
        f.write(tiff.tiff_bytes(list(stack)))
    names = order.upper()
    want = np.transpose(stack, [names.index(a) for a in "CTYX" if a in names])
    rows = tiff.read_images(spark, path, input_order=order).collect()
    got = {(r.c if r.t == 0 and "C" in names else r.t): np.array(r.pixels).reshape(r.height, r.width) for r in rows}
    assert len(rows) == len(want) and all((got[i] == want[i]).all() for i in range(len(want)))
    assert {r.t for r in tiff.read_images(spark, path, seq=[0], input_order=order).collect()} == {0}
    for bad in ("TYXC", "YX", "TTX", "ABC"):
        with pytest.raises(RuntimeError):
            tiff.read_images(spark, path, input_order=bad)


def test_image_lists_orders_and_errors(spark, tmp_path, sf):
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"f{2 - i}.tif"))
        with open(paths[-1], "wb") as f:
            f.write(tiff.tiff_bytes([np.full((2, 2), i, "u2")]))
    assert [r.pixels[0] for r in tiff.read_images(spark, paths).orderBy("t").collect()] == [0, 1, 2]
    other = tmp_path / "other" / "f0.tif"
    other.parent.mkdir()
    other.write_bytes(tiff.tiff_bytes([np.full((2, 2), 9, "u2")]))
    assert [r.pixels[0] for r in tiff.read_images(spark, [str(other), *paths, str(other)]).orderBy("t").collect()] == [9, 0, 1, 2, 9]
    assert [r.path[-6:] for r in tiff.image_folder(spark, str(tmp_path / "f*.tif")).orderBy("t").collect()] == ["f0.tif", "f1.tif", "f2.tif"]
    other.write_bytes(tiff.tiff_bytes([np.zeros((3, 2), "u2")]))
    with pytest.raises(Exception, match="has the shape"):
        tiff.read_images(spark, [paths[0], str(other)]).collect()
    for src, error in ((str(tmp_path), NotImplementedError), (str(tmp_path / "no.tif"), FileNotFoundError)):
        with pytest.raises(error):
            tiff.read_metadata(spark, src)
    with pytest.raises(NotImplementedError):
        tiff.read_images(spark, "a.nd2")
    with pytest.raises(RuntimeError):
        tiff.read_images(spark, ("a.tif",))
    paths = tiff.save_slices(sf[0], H, W // 2 + 1, str(tmp_path), {lag: f"lag{lag}.tif" for lag in (1, 2, 3, 4, 5)})
    with open(paths[2], "rb") as f:
        raw = f.read()
    plane = tiff.page_array(raw, tiff.pages(raw)[0])
    assert plane.shape == (H, W // 2 + 1) and np.isclose(plane[2, 1], sf[0].where("lag = 3 AND iy = 2 AND ix = 1").first().d)
    with pytest.raises(RuntimeError):
        tiff.save_slices(sf[0], H, W, str(tmp_path), {1: "x"})


def test_chunks(spark):
    f = spark.range(11).select(F.col("id").cast("int").alias("t"))
    got = {}
    for r in raster.chunk_frames(f, 11, 4, 1).collect():
        got.setdefault(r.chunk, []).append(r.t)
    assert {c: sorted(v) for c, v in got.items()} == {0: [0, 1, 2, 3], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [0, 1]}
    assert raster.chunk_frames(f, 3, 10).where("t < 3").select("chunk").distinct().count() == 1


def test_streamed_sums_are_the_batch_result(spark, cells, sf, tmp_path):
    spec = spectral.dft_cells(cells, G.Grid.of(H, W)).cache()
    for i, (lo, hi) in enumerate(((0, 5), (5, 7), (7, N))):
        spec.where(f"t >= {lo} AND t < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(spec.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = lagged.lagged_sums(stream, [1, 2, 5]).writeStream.format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = lagged.total(spark.table("sums")).orderBy("lag", "iy", "ix").toPandas()
    want = sf[0].where("lag IN (1, 2, 5)").orderBy("lag", "iy", "ix").toPandas()
    assert np.allclose(got.d, want.d) and (got.n_pairs == want.n_pairs).all()


def test_fits_leave_no_valley_and_no_flat_bound():
    """Long first steps took the first to A = 117 with Gamma at its bound, and the second to a flat end at that bound, called a success."""
    x, m = np.arange(1, 31) * 0.4, MODELS["generic_exponential"]
    for planted in ({"A": 2.284, "Gamma": 0.321, "beta": 1.1, "B": 0.05}, {"A": 3.215, "Gamma": 0.687, "beta": 1.092, "B": 0.443}):
        values, _, success, s = fit.least_squares(m, x, m(x, **planted), dict(m.hints))
        assert success and s["chisqr"] < 1e-12 and np.allclose([values[p] for p in planted], list(planted.values()), rtol=1e-6)
