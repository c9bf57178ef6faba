"""Streams with late, shuffled and repeated frames; states of parts that merge; rings of many edges; melt and resample as rows; truthful fits."""

import random
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagfield import Grid
from lagfield.functions import grid as G
from lagfield.functions.models import MODELS
from lagfield.functions.spline import loglog, weights
from lagfield.operators import fit, merge, partial, radial, raster, spectral, temporal
from lagfield.sources import shared, tiff
from lagfield.streaming import stateful


def spectrum(spark, frames, seed=1):
    r = random.Random(seed)
    rows = [("s", t, iy, 0, r.uniform(-9, 9), r.uniform(-9, 9)) for t in frames for iy in range(2)]
    return spark.createDataFrame(rows, spectral.SPECTRUM)


def sums(df, *keys):
    return {tuple(r[k] for k in keys): (r.d, r.n_pairs) for r in df.collect()}


def same(got, want):
    return set(got) == set(want) and all(np.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


# Streams


def run_stream(spark, spec, batches, lags, delay="60 seconds", chunk=None, overlap=0):
    """``batches``: lists of t in the order in which they arrive, one a second of event time."""
    folder = shared.shared_dir(spark, "t")
    for k, ts in enumerate(batches):
        rows = spec.join(spark.createDataFrame([(t, n) for n, t in enumerate(ts)], "t int, n int"), "t").orderBy("n").drop("n")
        rows.select(*[f.split()[0] for f in spectral.SPECTRUM.split(", ")]).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(spec.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return stateful.run_available(stateful.lagged_sums(stream, lags, 1, delay, chunk, overlap), folder)


def test_shuffled_and_repeated_frames_give_the_batch_result(spark):
    have = [t for t in range(60) if t % 7 != 3]
    spec, shuffled = spectrum(spark, have).cache(), random.Random(4).sample(have, len(have))
    batches = [[*shuffled[:20], *shuffled[:3]], shuffled[20:35], [*shuffled[30:50], *shuffled[5:9]], shuffled[50:]]
    got = stateful.total(run_stream(spark, spec, batches, [1, 2, 9], chunk=20, overlap=5))
    whole = sums(got.where("chunk IS NULL"), "lag", "iy", "ix")
    assert same(whole, sums(temporal.by_join(spec, [1, 2, 9]), "lag", "iy", "ix"))
    chunks = raster.chunk_frames(spec, 60, 20, 5).withColumn("seq_id", F.concat("seq_id", F.lit("-"), "chunk"))
    want = sums(temporal.by_join(chunks.drop("chunk"), [1, 2, 9]), "seq_id", "lag", "iy", "ix")
    assert same({(f"s-{k[0]}", *k[1:]): v for k, v in sums(got.where("chunk IS NOT NULL AND chunk < 4"), "chunk", "lag", "iy", "ix").items()}, want)


def test_frames_later_than_the_delay_do_not_count(spark):
    """Frame 5 comes when the newest is 40 and the delay 10; frame 35 comes late but in time; the second 39 is a repeat."""
    spec = spectrum(spark, range(0, 80)).cache()
    first, last = [t for t in range(41) if t not in (5, 35)], list(range(41, 80))
    got = sums(stateful.total(run_stream(spark, spec, [first, [5, 35, 39], last], [1, 4], "10 seconds")), "lag", "iy", "ix")
    assert same(got, sums(temporal.by_join(spec.where("t <> 5"), [1, 4]), "lag", "iy", "ix"))


class Held:
    """A value state and timers, as the processor sees them."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_is_bounded_and_expires():
    p, h = stateful.LagProcessor([1, 3], 1000, None, 0), Held()
    p.init(h)
    for begin in range(0, 300, 10):
        pdf = pd.DataFrame({"t": range(begin, begin + 10), "re": 1.0, "im": 0.0})
        list(p.handleInputRows(("s", 0, 0), iter([pdf]), Mark(max(0, begin - 20) * 1000)))
        assert len(h.value[0]) <= 20 + 10 + 3 + 2 and len(h.timers) == 1
    assert h.timers == [(299 + 3 + 2) * 1000]
    list(p.handleExpiredTimer(("s", 0, 0), Mark(304_000), None))
    assert h.value is None and h.timers == []


def test_stream_arguments(spark):
    s = spectrum(spark, range(3))
    for args in ((s, [0], 1, "1 second"), (s, [], 1, "1 second")):
        with pytest.raises(RuntimeError):
            stateful.lagged_sums(*args)
    with pytest.raises(ValueError):
        stateful.lagged_sums(s, [1], 1, "1 second", 5, 5)


# Parts


def test_parts_merge_to_the_whole(spark):
    spec, lags = spectrum(spark, [t for t in range(100) if t % 9 != 4]).cache(), [1, 5, 12]
    want = sums(temporal.by_join(spec, lags), "lag", "iy", "ix")
    states = partial.part_states(spec, lags, 25).cache()
    assert states.select("part").distinct().count() == 4 and same(sums(partial.merged(states), "lag", "iy", "ix"), want)
    # One part after the other, each with the tail of the last one.
    tail, parts = spec.where("false").select("seq_id", "iy", "ix", "t", "re", "im"), []
    for begin in range(0, 100, 25):
        state, tail = partial.next_part(tail, spec.where(f"t >= {begin} AND t < {begin + 25}"), lags, 25)
        state, tail = state.cache(), tail.cache()
        assert begin + 25 - 12 - 2 <= tail.agg(F.min("t")).first()[0] <= begin + 25 - 12 + 1
        parts.append(state)
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert same(sums(partial.merged(merged), "lag", "iy", "ix"), want) and {r.part for r in merged.select("part").distinct().collect()} == {0, 1, 2, 3}


def test_ring_moments_merge(spark):
    g = Grid.of(6, 6)
    sf = spark.range(g.ny * g.nxh).select(F.lit("s").alias("seq_id"), F.lit(1).alias("lag"), F.lit(1.0).alias("tau"), F.floor(F.col("id") / g.nxh).cast("int").alias("iy"), (F.col("id") % g.nxh).cast("int").alias("ix"), (F.rand(3) + 1e6).alias("d")).cache()
    whole = partial.ring_states(sf, g, 4).orderBy("bin").collect()
    halves = partial.ring_states(sf.where("iy < 2"), g, 4).unionByName(partial.ring_states(sf.where("iy >= 2"), g, 4))
    again = partial.merge_moments(halves, ["seq_id", "lag", "bin"]).orderBy("bin").collect()
    assert [(r.bin, r.w) for r in whole] == [(r.bin, r.w) for r in again] and np.allclose([r.m2 for r in whole], [r.m2 for r in again]) and np.allclose([r["mean"] for r in whole], [r["mean"] for r in again])
    means = radial.azimuthal_average(sf, G.qgrid(spark, g), *radial.bin_edges(4, None, [float(np.hypot(a, b)) for a in g.axes()[0] for b in g.axes()[1]]), ["seq_id", "lag"]).orderBy("bin").toPandas()
    assert np.allclose(means.avg[means.avg.notna()], [r["mean"] for r in whole], rtol=1e-12)


def test_table_function(spark):
    spec = spectrum(spark, [t for t in range(40) if t % 6 != 2])
    partial.register_table_function(spark, "lags_of")
    spec.createOrReplaceTempView("spec_of_test")
    got = spark.sql("SELECT * FROM lags_of(TABLE(spec_of_test) PARTITION BY (seq_id, iy, ix) ORDER BY (t), ARRAY(7, 1, 1))")
    assert same(sums(partial.merged(got), "lag", "iy", "ix"), sums(temporal.by_join(spec, [1, 7]), "lag", "iy", "ix"))


# Rings


@pytest.mark.parametrize("edges", [[0.0, 1.0, 2.0], list(np.linspace(0.3, 5, 200)), [0.5] * 70 + [1.0, 1.0, 4.0], [1.0] * 80])
def test_rings_by_table_equal_rings_by_list(spark, monkeypatch, edges):
    low = edges[0]
    ks = [*edges, *(e + 1e-9 for e in edges), *np.random.default_rng(2).uniform(0, 6, 300), 0.0, 9.0]
    rows = spark.createDataFrame([(i, float(k)) for i, k in enumerate(ks)], "i int, k double")
    want = {i: (int(np.searchsorted(edges, k, "left")) if low <= k <= edges[-1] else None) for i, k in enumerate(ks)}
    for few in (0, 10_000):
        monkeypatch.setattr(radial, "FEW_EDGES", few)
        out = radial.rings_of(rows, [float(e) for e in edges], float(low))
        assert {r.i: r.bin for r in out.collect()} == want and out.count() == len(ks)
        assert ("filter" in out._jdf.queryExecution().optimizedPlan().toString()) == (few > 0)


def test_averages_over_many_rings(spark, monkeypatch):
    g = Grid.of(9, 8)
    sf = spark.range(2 * g.ny * g.nxh).select((F.col("id") % 2).cast("int").alias("lag"), F.floor(F.col("id") / 2 / g.nxh).cast("int").alias("iy"), (F.floor(F.col("id") / 2) % g.nxh).cast("int").alias("ix"), F.rand(5).alias("d")).cache()
    sf = sf.withColumn("tau", F.when(F.col("lag") == 1, 1.0))
    edges = [float(x) for x in np.linspace(0, 4, 90)]
    many = radial.azimuthal_average(sf, G.qgrid(spark, g), edges, 0.0, ["lag", "tau"]).orderBy("lag", "bin").toPandas()
    monkeypatch.setattr(radial, "FEW_EDGES", 1000)
    pd.testing.assert_frame_equal(many, radial.azimuthal_average(sf, G.qgrid(spark, g), edges, 0.0, ["lag", "tau"]).orderBy("lag", "bin").toPandas())
    assert len(many) == 180


def test_nan_and_null_weights_are_no_weights(spark):
    g = Grid.of(6, 6)
    sf = spark.range(g.ny * g.nxh).select(F.lit(1).alias("lag"), F.floor(F.col("id") / g.nxh).cast("int").alias("iy"), (F.col("id") % g.nxh).cast("int").alias("ix"), F.rand(5).alias("d")).cache()
    for odd in (float("nan"), None):
        weight = F.when(F.col("iy") == 2, odd).otherwise(1.5)
        got, want = (radial.azimuthal_average(sf, G.qgrid(spark, g), [0.0, 2.0, 5.0], 0.0, ["lag"], weight=w, mask=m).orderBy("bin").toPandas() for w, m in ((weight, None), (F.lit(1.5), F.col("iy") != 2)))
        pd.testing.assert_frame_equal(got, want)


# Curves


def curves(spark, tau, rings):
    rows = [("s", b, 0.5 + b, float(t), float(v), None if e is None else float(e)) for b, points in rings.items() for t, (v, e) in zip(tau, points, strict=True)]
    return spark.createDataFrame(rows, "seq_id string, bin int, k double, tau double, d double, err double")


def brute_melt(fast, slow):
    """Of (tau, v, err) arrays."""
    (ft, fv, fe), (st, sv, se) = fast, slow
    n = min(10, int((st < ft[-1]).sum()))
    cut = int(np.argmin(np.abs(ft - st[n // 2]))) + 1
    over = loglog(ft, fv, st[:n], 3)
    alpha = (over * sv[:n]).sum() / (over * over).sum()
    tail = slice(n // 2 + 1, None)
    return np.r_[ft[:cut], st[tail]], np.r_[fv[:cut] * alpha, sv[tail]], np.r_[fe[:cut] * alpha, se[tail]]


@pytest.mark.parametrize("known", [False, True])
def test_melt_equals_brute_force(spark, known):
    r = np.random.default_rng(6)
    ft, st = np.arange(1.0, 15), np.arange(3.0, 60, 3)
    rings = lambda n: {b: [(v, e) for v, e in zip(r.uniform(1, 3, n), r.uniform(0.1, 0.2, n), strict=True)] for b in range(4)}
    a, b = rings(len(ft)), rings(len(st))
    a[2], b[3] = [(np.nan, 0.1)] * len(ft), [(np.nan, 0.1)] * len(st)
    a[1] = [(v, None) for v, _ in a[1]]
    first, second = curves(spark, ft, a), curves(spark, st, b | {9: b[0]})
    for x, y, lists in ((first, second, (ft, st)), (second, first, (st, ft))):
        out = merge.melt(x, y, tau_lists=tuple(map(list, lists)) if known else None)
        assert ("Arrow" in out._jdf.queryExecution().executedPlan().toString()) != known
        got = out.orderBy("bin", "tau").toPandas()
        for ring in range(4):
            of = lambda rows: tuple(np.array([np.nan if p[k] is None else p[k] for p in rows], float) for k in (0, 1))
            t, v, e = brute_melt((ft, *of(a[ring])), (st, *of(b[ring])))
            if ring in (2, 3):
                v = e = np.full(len(t), np.nan)
            g = got[got.bin == ring]
            assert np.allclose(g.tau, t) and np.allclose(g.d, v, equal_nan=True) and np.allclose(g.err, e, equal_nan=True)
        assert set(got.bin) == {0, 1, 2, 3}


def test_melt_without_overlap_and_with_unlisted_tau(spark):
    fast, slow = curves(spark, [1.0, 2, 3, 4], {0: [(1, 0.1)] * 4}), curves(spark, [9.0, 10, 11], {0: [(2, 0.2)] * 3})
    got = merge.melt(fast, slow).orderBy("tau").toPandas()
    assert got.tau.tolist() == [1, 2, 3, 4, 10, 11] and got.d.isna().all()
    for run in (lambda: merge.melt(fast, slow, tau_lists=([1.0, 2, 3, 5], [9.0, 10, 11])), lambda: merge.resample(fast, [1.5], tau_lists=[[1.0, 2, 3, 5]])):
        with pytest.raises(Exception, match="not among those given"):
            run().collect()
    assert merge.melt(fast.where("false"), slow).isEmpty() and merge.resample(fast.where("false"), [2.0]).isEmpty()


def test_resample_with_and_without_known_lists(spark):
    r, tau, to = np.random.default_rng(7), np.arange(1.0, 12), [0.5, 1.0, 3.7, 14.0]
    c = curves(spark, tau, {b: [(v, None if b == 1 and i == 4 else e) for i, (v, e) in enumerate(zip(r.uniform(1, 3, 11), r.uniform(0.1, 0.2, 11), strict=True))] for b in range(2)})
    for lists in (None, [list(tau)]):
        got = merge.resample(c, to[::-1], tau_lists=lists).orderBy("bin", "tau").toPandas()
        rows = c.orderBy("bin", "tau").toPandas()
        for b in range(2):
            g, o = got[got.bin == b], rows[rows.bin == b]
            assert np.allclose(g.d, loglog(tau, o.d.to_numpy(), np.array(to), 2)) and g.tau.tolist() == to
            assert g.err.isna().all() if b else np.allclose(g.err, loglog(tau, o.err.to_numpy(), np.array(to), 2))
    assert np.allclose(weights(tau, tau, 2), np.eye(11), atol=1e-12)


# Fits


def test_a_fit_that_cannot_move_does_not_succeed():
    x = np.linspace(0.1, 5, 20)

    class Broken:
        def __call__(self, x, p):
            return np.full(len(x), p if p == 1.0 else np.nan)

    h = {"p": fit.Hint(1.0)}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        values, _, success, _ = fit.least_squares(Broken(), x, np.full(20, 0.5), h)
    assert values["p"] == 1.0 and not success


def test_bounds_that_hold_a_parameter_are_a_success_and_statistics_agree():
    m, x = MODELS["simple_structure_function"], np.linspace(0.2, 12, 40)
    y = m(x, A=2.0, tau=3.0, B=0.1) + np.random.default_rng(1).normal(0, 0.01, 40)
    values, err, success, s = fit.least_squares(m, x, y, dict(m.hints))
    assert success and s["n_points"] == 40 and s["n_free"] == 3 and np.isclose(s["redchi"], s["chisqr"] / 37) and np.isclose(s["chisqr"], ((m(x, **values) - y) ** 2).sum())
    assert np.allclose(np.sqrt(np.diag(s["covariance"])), [err[p] for p in s["varied"]])
    hints = dict(m.hints)
    hints["A"] = fit.replace(hints["A"], value=1.0, max=1.5)
    values, _, success, _ = fit.least_squares(m, x, y, hints)
    assert success and values["A"] == 1.5
    hints = dict(m.hints)
    hints["B"] = fit.replace(hints["B"], expr="A / 20")
    values, err, success, s = fit.least_squares(m, x, y, hints)
    assert success and set(s["varied"]) == {"A", "tau"} and np.isclose(err["B"], err["A"] / 20) and np.isclose(values["B"], values["A"] / 20)


def test_fit_rows_have_statistics(spark):
    tau = np.linspace(0.2, 9, 30)
    m = MODELS["simple_structure_function"]
    c = curves(spark, tau, {0: [(v, 0.1) for v in m(tau, A=2.0, tau=2.0, B=0.3)], 1: [(np.nan, 0.1)] * 30})
    rows = {r.bin: r for r in fit.fit_curves(c, m, estimate_simple_parameters=True).collect()}
    assert rows[0].success and rows[0].n_free == 3 and len(rows[0].covariance) == 3 and set(rows[0].varied) == {"A", "tau", "B"}
    assert not rows[1].success and len(rows[1].covariance) == 0 and rows[1].chisqr is None


# Sizes, stacks


def test_lengths_as_columns(spark):
    got = spark.range(1, 600).select("id", G.fast_len(F.col("id"), 599).alias("f"), G.power_of_2(F.col("id")).alias("p")).collect()
    assert all(r.f == G.next_fast_len(r.id) and r.p == G.next_power_of_2(r.id) for r in got)


@pytest.mark.parametrize("dtype", ["u1", "f8"])
def test_a_stack_of_pages(spark, tmp_path, dtype):
    frames = spark.createDataFrame([("s", t, 2, 3, [float(t + k) for k in range(6)]) for t in (4, 1, 9, 2)], "seq_id string, t int, height int, width int, pixels array<double>")
    path = tiff.save_stack(frames, str(tmp_path), "a.tif", dtype)
    assert [(r.t, r.pixels) for r in tiff.read_images(spark, path).orderBy("t").collect()] == [(k, [float(t + i) for i in range(6)]) for k, t in enumerate((1, 2, 4, 9))]
    assert [r.pixels[0] for r in tiff.read_images(spark, path, seq=[3]).collect()] == [9.0]
    for bad in (frames.where("false"), frames.unionByName(frames), frames.withColumn("height", F.col("t"))):
        with pytest.raises(ValueError):
            tiff.save_stack(bad, str(tmp_path), "b.tif")
    tags = tiff.read_metadata(spark, [path, path]).collect()
    assert len(tags) == 2 and tags[0].tags["ImageWidth"] == "3"
