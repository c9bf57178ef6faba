"""One query per operator over the driver's tables, and its SQL. Values are rounded to 6 places in both."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import lags as lag_lists
from ..functions.models import MODELS
from ..operators import fit, isf, merge, noise, partial, radial, raster, spectral, temporal
from ..sources import container, tiff
from ..sources.shared import kept, shared_dir
from ..streaming import stateful
from . import sql as S

LAGS, N_MONTHS, BINS = [1, 2, 3, 5, 8, 13], 83, 6
GRID = G.Grid.of(8, 8)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cube(spark: SparkSession, sf_dir: str, height: int = 8, width: int = 8) -> DataFrame:
    return raster.lineitem_cube(_table(spark, sf_dir, "lineitem"), height, width)


def _r(*names: str) -> list[Column]:
    return [(F.round(F.col(n), 6) + 0.0).alias(n) for n in names]


def _edges(grid: G.Grid = GRID, bins: int = BINS) -> tuple[list[float], float]:
    ky, kx = grid.axes()
    return radial.bin_edges(bins, None, [math.sqrt(a * a + b * b) for a in ky for b in kx])


EDGES, LOW = _edges()
TO_SF = (S.cube(), S.spectrum(GRID), S.structure(LAGS))
TO_AA = (*TO_SF, S.wave_grid(GRID), S.rings(EDGES, LOW))


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.dft_cells(_cube(spark, sf_dir), GRID)


def _sf(spark: SparkSession, sf_dir: str, strategy: str = "lead") -> tuple[DataFrame, DataFrame]:
    return temporal.structure_function(_cube(spark, sf_dir), GRID, N_MONTHS, LAGS, strategy=strategy)


def _aa(spark: SparkSession, sf_dir: str, **args) -> tuple[DataFrame, DataFrame, list[float]]:
    return radial.radial_slices(temporal.structure_slices(_cube(spark, sf_dir), GRID, N_MONTHS, LAGS), GRID, **{"bins": BINS, **args})


# Rasters, packing, chunks


@query("raster_lineitem", S.with_(S.cube()) + "SELECT t, y, x, v FROM frames")
def raster_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir).drop("seq_id")


EVENTS = """cells AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, user_id % 8 AS y, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS x, count(*) AS v FROM events GROUP BY ALL),
frames AS (SELECT CAST(h - (SELECT min(h) FROM cells) AS INTEGER) AS t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(v AS DOUBLE) AS v FROM cells)"""


@query("raster_events", S.with_(EVENTS) + "SELECT t, y, x, v FROM frames")
def raster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.event_cube(_table(spark, sf_dir, "events")).drop("seq_id")


@query("frames_pack_unpack", S.with_(S.cube()) + f"SELECT CAST(t AS INTEGER) AS t, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, coalesce(f.v, 0.0) AS v FROM range({N_MONTHS}) m, range(8) a, range(8) b LEFT JOIN frames f ON f.t = m.range AND f.y = a.range AND f.x = b.range".replace("CAST(t AS INTEGER)", "CAST(m.range AS INTEGER)"))
def frames_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.unpack(raster.pack(_cube(spark, sf_dir), 8, 8)).drop("seq_id")


@query("chunkify_frames", S.with_(S.cube()) + "SELECT CAST(c.range AS INTEGER) AS chunk, CAST(t - c.range * 15 AS INTEGER) AS t, sum(v) AS v FROM frames, range(6) c WHERE t >= c.range * 15 AND t < c.range * 15 + 20 AND (c.range * 15 + 20 < 83 OR c.range = 5 OR (c.range - 1) * 15 + 20 < 83) GROUP BY ALL")
def chunkify_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.chunk_frames(_cube(spark, sf_dir), N_MONTHS, 20, 5).groupBy("chunk", "t").agg(F.sum("v").alias("v"))


# Forms of windows and weights in SQL


def _cos_sum(var: str, n: int, c: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"{(-1) ** m * v!r} * cos(2 * pi() * {m} * {var} / {n})" for m, v in enumerate(c)) + ")"


PAD = G.Grid.of(13, 7, 0.5)
RECT = G.Grid.of(6, 9)


def _sector_sql(kind: str, theta: float, delta: float, rep: int) -> str:
    terms = []
    for n in range(rep):
        off = f"((atan2(ky, kx) - {math.radians(theta) + 2 * math.pi * n / rep!r} + pi()) - 2 * pi() * floor((atan2(ky, kx) - {math.radians(theta) + 2 * math.pi * n / rep!r} + pi()) / (2 * pi())) - pi())"
        d = math.radians(delta)
        terms.append(f"CASE WHEN pow({off} / {d!r}, 2) < 0.25 THEN 1.0 ELSE 0.0 END" if kind == "uniform" else f"exp(-0.5 * pow({off} / {d / 2!r}, 2)) / {d / 2 * math.sqrt(2 * math.pi)!r}")
    return " + ".join(terms)


# Spectra

_SPEC_OUT = f"SELECT t, iy, ix, {S.r('re', 're')}, {S.r('im', 'im')} FROM spectrum"


@query("spectrum_dft", S.with_(S.cube(), S.spectrum(GRID)) + _SPEC_OUT)
def spectrum_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).select("t", "iy", "ix", *_r("re", "im"))


@query("spectrum_arrow", S.with_(S.cube(), S.spectrum(GRID)) + _SPEC_OUT)
def spectrum_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.spectrum_arrow(_cube(spark, sf_dir), GRID).select("t", "iy", "ix", *_r("re", "im"))


@query("spectrum_windowed", S.with_(S.cube(), f"win AS (SELECT t, y, x, v * {_cos_sum('y', 8, G.BLACKMAN)} * {_cos_sum('x', 8, G.BLACKMAN)} AS v FROM frames)", S.spectrum(GRID, "win")) + _SPEC_OUT)
def spectrum_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.dft_cells(_cube(spark, sf_dir), GRID, G.blackman(8, 8)).select("t", "iy", "ix", *_r("re", "im"))


@query("spectrum_window_table", S.with_(S.cube(), "win AS (SELECT t, y, x, v * (1 + y) / (1 + x) AS v FROM frames)", S.spectrum(GRID, "win")) + _SPEC_OUT)
def spectrum_window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x")).withColumn("w", (1 + F.col("y")) / (1 + F.col("x")))
    return spectral.dft_cells(_cube(spark, sf_dir), GRID, window).select("t", "iy", "ix", *_r("re", "im"))


@query("spectrum_fft_padded", S.with_(S.cube(13, 7), f"win AS (SELECT t, y, x, v * {_cos_sum('y', 13, G.BLACKMAN_HARRIS)} * {_cos_sum('x', 7, G.BLACKMAN_HARRIS)} AS v FROM frames)", S.spectrum(PAD, "win")) + _SPEC_OUT)
def spectrum_fft_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.rfft2_cells(_cube(spark, sf_dir, 13, 7), PAD, G.blackman_harris(13, 7)).select("t", "iy", "ix", *_r("re", "im"))


@query("spectrum_pencil", S.with_(S.cube(13, 7), f"win AS (SELECT t, y, x, v * {_cos_sum('y', 13, G.BLACKMAN_HARRIS)} * {_cos_sum('x', 7, G.BLACKMAN_HARRIS)} AS v FROM frames)", S.spectrum(PAD, "win")) + _SPEC_OUT)
def spectrum_pencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.rfft2_pencil(_cube(spark, sf_dir, 13, 7), PAD, G.blackman_harris(13, 7), columns=3).select("t", "iy", "ix", *_r("re", "im"))


@query("spectrum_padded", S.with_(S.cube(13, 7), S.spectrum(PAD)) + _SPEC_OUT)
def spectrum_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.dft_cells(_cube(spark, sf_dir, 13, 7), PAD).select("t", "iy", "ix", *_r("re", "im"))


# Temporal statistics

_SF_OUT = f"SELECT lag, tau, iy, ix, {S.r('d', 'd')}, n_pairs FROM sf"
WHOLE = ("join", "lead", "prefix", "fft")
for _how in WHOLE:
    query(f"sf_{_how}", S.with_(*TO_SF) + _SF_OUT)(lambda spark, sf_dir, how=_how: _sf(spark, sf_dir, how)[0].select("lag", "tau", "iy", "ix", *_r("d"), "n_pairs"))


_GAPS = S.with_(S.cube(), "partial AS (SELECT * FROM frames WHERE t % 7 <> 3)", S.spectrum(GRID, "partial"), S.structure(LAGS)) + _SF_OUT
for _how in WHOLE:
    query(f"sf_gaps_{_how}", _GAPS)(lambda spark, sf_dir, how=_how: temporal.structure_function(_cube(spark, sf_dir).where("t % 7 <> 3"), GRID, N_MONTHS, LAGS, strategy=how)[0].select("lag", "tau", "iy", "ix", *_r("d"), "n_pairs"))


# One frame a minute, most of them missing: blocks of the time axis.
MINUTES, MINUTE_LAGS = 30 * 24 * 60, [1, 2, 5, 15, 60, 720]


def _minute_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.dft_cells(raster.event_cube(_table(spark, sf_dir, "events"), 1 / 60), G.Grid.of(8, 5))


_MINUTES_SQL = S.with_(EVENTS.replace("3600", "60"), S.spectrum(G.Grid.of(8, 5)), S.structure(MINUTE_LAGS)) + _SF_OUT
for _how in ("halo", "block_scan", "fft_blocks"):
    query(f"sf_{_how}", _MINUTES_SQL)(
        lambda spark, sf_dir, how=_how: temporal.structure_function(None, G.Grid.of(8, 5), MINUTES, MINUTE_LAGS, strategy=how, spectrum=_minute_spectrum(spark, sf_dir))[0].select("lag", "tau", "iy", "ix", *_r("d"), "n_pairs")
    )


@query("sf_merge_partials", S.with_(EVENTS, S.spectrum(G.Grid.of(8, 5)), S.structure(LAGS)) + _SF_OUT)
def sf_merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of single days, written apart and merged."""
    states = partial.part_states(spectral.dft_cells(raster.event_cube(_table(spark, sf_dir, "events")), G.Grid.of(8, 5)), LAGS, 24)
    folder = shared_dir(spark, "states")
    states.write.partitionBy("part").parquet(folder)
    return partial.merged(spark.read.parquet(folder)).select("lag", "tau", "iy", "ix", *_r("d"), "n_pairs")


@query("sf_table_function", S.with_(*TO_SF) + f"SELECT lag, iy, ix, {S.r('d', 'd')}, n_pairs FROM sf")
def sf_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial.register_table_function(spark)
    _spectrum(spark, sf_dir).createOrReplaceTempView("lagfield_spectrum")
    sums = spark.sql(f"SELECT * FROM lag_sums(TABLE(lagfield_spectrum) PARTITION BY (seq_id, iy, ix) ORDER BY (t), ARRAY({', '.join(map(str, LAGS))}))")
    return partial.merged(sums).select("lag", "iy", "ix", *_r("d"), "n_pairs")


HOURS, CHUNK, STEP = 720, 100, 75
_CHUNKS = f"""pairs AS (SELECT lag, a.iy, a.ix, a.t AS early, b.t AS late, (b.re - a.re) * (b.re - a.re) + (b.im - a.im) * (b.im - a.im) AS d
  FROM spectrum a CROSS JOIN (SELECT unnest({LAGS}) AS lag) JOIN spectrum b ON b.iy = a.iy AND b.ix = a.ix AND b.t = a.t + lag),
chunks AS (SELECT -1 AS chunk, -1 AS low, {HOURS} AS high UNION ALL SELECT range, range * {STEP}, range * {STEP} + {CHUNK} FROM range({-(-HOURS // STEP)}))"""


@query("sf_stream", S.with_(EVENTS, S.spectrum(G.Grid.of(8, 5)), _CHUNKS) + f"SELECT CAST(chunk AS INTEGER) AS chunk, CAST(lag AS INTEGER) AS lag, iy, ix, {S.r('avg(d)', 'd')}, CAST(count(*) AS INTEGER) AS n_pairs FROM pairs JOIN chunks ON early >= low AND late < high GROUP BY ALL")
def sf_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly frames that arrive up to 40 hours late, some of them twice, in six batches: the whole sequence (chunk -1) and hopping chunks."""
    folder = shared_dir(spark, "stream")
    spectrum = kept(spectral.dft_cells(raster.event_cube(_table(spark, sf_dir, "events")), G.Grid.of(8, 5)), "spectrum")
    late = F.pmod(F.hash("t"), F.lit(40))
    again = F.when(F.col("t") % 10 == 3, F.array(late, late + 30)).otherwise(F.array(late))
    arriving = spectrum.withColumn("_late", F.explode(again)).withColumn("_batch", F.floor((F.col("t") + F.col("_late")) / 120))
    for k in range(-(-(HOURS + 70) // 120)):
        arriving.where(F.col("_batch") == k).drop("_late", "_batch").coalesce(1).write.parquet(f"{folder}/arrivals/{k}")
    stream = spark.readStream.schema(spectrum.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/arrivals")
    sums = stateful.run_available(stateful.lagged_sums(stream, LAGS, 3600, "2 days", CHUNK, CHUNK - STEP), folder)
    return stateful.total(sums).select(F.coalesce("chunk", F.lit(-1)).alias("chunk"), "lag", "iy", "ix", *_r("d"), "n_pairs")


@query("sf_dark_frames", S.with_(S.cube(), f"partial AS (SELECT * FROM frames WHERE t % 7 <> 3 UNION ALL SELECT CAST(range AS INTEGER), 0, 0, 0.0 FROM range({N_MONTHS}) WHERE range % 7 = 3)", S.spectrum(GRID, "partial"), S.structure(LAGS)) + _SF_OUT)
def sf_dark_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = raster.filled_frames(_cube(spark, sf_dir).where("t % 7 <> 3"), N_MONTHS)
    return temporal.structure_function(cube, GRID, N_MONTHS, LAGS)[0].select("lag", "tau", "iy", "ix", *_r("d"), "n_pairs")


_MANY = list(range(1, 41))


@query("sf_auto_many_lags", S.with_(S.cube(), S.spectrum(GRID), S.structure(_MANY)) + _SF_OUT)
def sf_auto_many_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.structure_function(_cube(spark, sf_dir), GRID, N_MONTHS, _MANY)[0].select("lag", "tau", "iy", "ix", *_r("d"), "n_pairs")


@query("power_spectrum_and_variance", S.with_(*TO_SF) + f"SELECT iy, ix, {S.r('power_spec', 'power_spec')}, {S.r('"var"', '"var"')} FROM extra")
def power_spectrum_and_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.power_and_variance(_spectrum(spark, sf_dir)).select("iy", "ix", *_r("power_spec", "var"))


@query("sf_units", S.with_(S.cube(), S.spectrum(GRID), S.structure(LAGS, 0.043), S.wave_grid(G.Grid.of(8, 8, 0.123))) + f"SELECT lag, {S.r('tau', 'tau')}, {S.r('ky', 'ky')}, {S.r('kx', 'kx')}, {S.r('d', 'd')} FROM sf JOIN qgrid USING (iy, ix)")
def sf_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.Grid.of(8, 8, 0.123).with_frame_rate(1 / 0.043)
    sf, _ = temporal.structure_function(_cube(spark, sf_dir), g, N_MONTHS, LAGS)
    return sf.join(G.qgrid(spark, g), ["iy", "ix"]).select("lag", *_r("tau", "ky", "kx", "d"))


_FULL = """SELECT lag, CAST((CASE WHEN m = 0 THEN iy ELSE (8 - iy) % 8 END) AS INTEGER) AS iy, CAST(((CASE WHEN m = 0 THEN ix ELSE 8 - ix END) + 4) % 8 AS INTEGER) AS ix, round(d, 6) + 0.0 AS d
FROM sf, (SELECT unnest([0, 1]) AS m) WHERE m = 0 OR (ix > 0 AND ix < 4)"""


@query("sf_full_plane", S.with_(*TO_SF) + _FULL)
def sf_full_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.full_plane(_sf(spark, sf_dir)[0], GRID).select("lag", "iy", "ix", *_r("d"))


# Lag lists, grids, windows and weights at work


_LAG_LISTS = {
    "fibonacci": (lambda: lag_lists.fibonacci(720), "f(a, b) AS (SELECT 1, 2 UNION ALL SELECT b, a + b FROM f WHERE b < 720), lag_list AS (SELECT a AS lag FROM f)"),
    "logspace": (
        lambda: lag_lists.logspace_int(720, 12),
        "f(i, v, r) AS (SELECT 0, 1.0::DOUBLE, pow(720.0, 1.0 / 13) UNION ALL SELECT i + 1, CASE WHEN v * r - v >= 1 THEN v * r ELSE v + 1 END, CASE WHEN v * r - v >= 1 THEN r ELSE pow(720.0 / (v + 1), 1.0 / (13 - i - 2)) END FROM f WHERE i < 11), lag_list AS (SELECT CAST(round_even(v, 0) AS INTEGER) AS lag FROM f)",
    ),
}
for _name, (_lags, _sql) in _LAG_LISTS.items():
    _parts = (_sql, EVENTS, S.spectrum(G.Grid.of(8, 5)), S.structure([]).replace("(SELECT unnest([]) AS lag)", "lag_list"))
    query(f"lags_{_name}", "WITH RECURSIVE " + ",\n".join(_parts) + _SF_OUT)(
        lambda spark, sf_dir, lags=_lags: temporal.structure_function(raster.event_cube(_table(spark, sf_dir, "events")), G.Grid.of(8, 5), 720, lags())[0].select("lag", "tau", "iy", "ix", *_r("d"), "n_pairs")
    )


@query("fast_lengths", "WITH n AS (SELECT DISTINCT CAST(s_suppkey AS INTEGER) AS n FROM supplier), m AS (SELECT CAST(pow(2, a.range) * pow(3, b.range) * pow(5, c.range) * pow(7, d.range) * (CASE WHEN e.range = 1 THEN 11 ELSE 1 END) AS BIGINT) AS m FROM range(12) a, range(8) b, range(6) c, range(5) d, range(2) e), p AS (SELECT CAST(pow(2, range) AS BIGINT) AS p FROM range(20)) SELECT n, CAST((SELECT min(m) FROM m WHERE m.m >= n.n) AS INTEGER) AS fast, CAST((SELECT min(p) FROM p WHERE p.p >= n.n) AS INTEGER) AS power_of_2 FROM n")
def fast_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    keys = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("n")).distinct()
    most = keys.agg(F.max("n")).first()[0] or 1
    return keys.select("n", G.fast_len(n, most).cast("int").alias("fast"), G.power_of_2(n).cast("int").alias("power_of_2"))


for _name, _c, _f in (("blackman", G.BLACKMAN, G.blackman), ("blackman_harris", G.BLACKMAN_HARRIS, G.blackman_harris)):
    query(f"window_{_name}", S.with_(S.cube(6, 9)) + f"SELECT t, y, x, {S.r('v * ' + _cos_sum('y', 6, _c) + ' * ' + _cos_sum('x', 9, _c), 'v')} FROM frames")(
        lambda spark, sf_dir, f=_f: spectral.windowed(_cube(spark, sf_dir, 6, 9), f(6, 9)).select("t", "y", "x", *_r("v"))
    )


@query("qgrid", S.with_(S.cube(13, 7), S.spectrum(PAD), S.structure(LAGS), S.wave_grid(PAD)) + f"SELECT iy, ix, {S.r('ky', 'ky')}, {S.r('kx', 'kx')}, {S.r('k', 'k')}, mult, {S.r('power_spec', 'power_spec')} FROM extra JOIN qgrid USING (iy, ix)")
def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = temporal.power_and_variance(spectral.dft_cells(_cube(spark, sf_dir, 13, 7), PAD))
    return extra.join(G.qgrid(spark, PAD), ["iy", "ix"]).select("iy", "ix", *_r("ky", "kx", "k"), "mult", *_r("power_spec"))


@query("qgrid_full", S.with_(*TO_SF) + f"SELECT lag, iy, ix, {S.r('2 * pi() * (iy - 4) / 8', 'ky')}, {S.r('2 * pi() * (ix - 4) / 8', 'kx')}, d FROM ({_FULL})")
def q_grid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = spectral.full_plane(_sf(spark, sf_dir)[0], GRID)
    return plane.join(G.qgrid(spark, GRID, full=True), ["iy", "ix"]).select("lag", "iy", "ix", *_r("ky", "kx", "d"))


@query("mask_central_cross", S.with_(*TO_SF, S.wave_grid(GRID)) + f"SELECT iy, ix, ix <> 0 AND iy <> 4 AS by_index, kx <> 0 AND ky <> 0 AS by_axes, {S.r('power_spec', 'power_spec')} FROM extra JOIN qgrid USING (iy, ix)")
def mask_central_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = temporal.power_and_variance(_spectrum(spark, sf_dir)).join(G.qgrid(spark, GRID), ["iy", "ix"])
    return extra.select("iy", "ix", G.central_cross(GRID).alias("by_index"), G.central_cross(GRID, True).alias("by_axes"), *_r("power_spec"))


# Radial averages

_AA_OUT = f"SELECT bin, {S.r('k', 'k')}, tau, {S.r('d', 'd')}, {S.r('err', 'err')} FROM aa"


@query("aa_mean", S.with_(*TO_AA) + _AA_OUT)
def aa_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aa(spark, sf_dir)[0].select("bin", *_r("k"), "tau", *_r("d", "err"))


@query("aa_extra", S.with_(*TO_AA) + f"SELECT bin, {S.r('k', 'k')}, {S.r('power_spec', 'power_spec')}, {S.r('power_spec_err', 'power_spec_err')}, {S.r('"var"', '"var"')}, {S.r('var_err', 'var_err')} FROM aa_extra")
def aa_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aa(spark, sf_dir)[1].select("bin", *_r("k", "power_spec", "power_spec_err", "var", "var_err"))


def _weighted(name: str, sql: str, weight: Callable[[], Column]) -> None:
    query(name, S.with_(*TO_SF, S.wave_grid(GRID), S.rings(EDGES, LOW, "true", sql)) + _AA_OUT)(lambda spark, sf_dir: _aa(spark, sf_dir, weight=weight())[0].select("bin", *_r("k"), "tau", *_r("d", "err")))


for _kind in ("uniform", "gauss"):
    _weighted(f"weights_sector_{_kind}", _sector_sql(_kind, 10, 70, 2), lambda k=_kind: G.sector_weight(10, 70, 2, k))
# A small sphere, whose amplitude is positive over the whole grid.
_AMPLITUDE = f"0.8 * {4 / 3 * math.pi * 0.5**3!r} * CASE WHEN k = 0 THEN 1.0 / 3 ELSE (sin(k * 0.5) - k * 0.5 * cos(k * 0.5)) / pow(k * 0.5, 3) END"
for _kind, _e in (("amplitude", _AMPLITUDE), ("intensity", f"4 * pi() * pow({_AMPLITUDE}, 2)")):
    _weighted(f"form_factor_{_kind}", _e, lambda k=_kind: G.sphere_form_factor(0.5, 0.8, k))


MANY = [float(x) for x in np.linspace(LOW, EDGES[-1], 2000)]


@query("aa_many_edges", S.with_(*TO_SF, S.wave_grid(GRID), S.rings(MANY, LOW)) + _AA_OUT)
def aa_many_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aa(spark, sf_dir, bins=2000)[0].select("bin", *_r("k"), "tau", *_r("d", "err"))


LIST = [0.5, 1.0, 1.1, 2.0, 3.3]


@query("aa_edge_list", S.with_(*TO_SF, S.wave_grid(GRID), S.rings(LIST, LIST[0])) + _AA_OUT)
def aa_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radial.radial(*_sf(spark, sf_dir), GRID, bins=LIST)[0].select("bin", *_r("k"), "tau", *_r("d", "err"))


@query("aa_mask_weights", S.with_(*TO_SF, S.wave_grid(GRID), S.rings(EDGES, LOW, "ix <> 0 AND iy <> 4", _sector_sql("gauss", 10, 70, 2))) + _AA_OUT)
def aa_mask_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aa(spark, sf_dir, mask=G.central_cross(GRID), weight=G.sector_weight(10, 70, 2, "gauss"))[0].select("bin", *_r("k"), "tau", *_r("d", "err"))


# Noise

_SOME = "k >= 1.0 AND k <= 3.0"
_FIVE = "(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY tau) AS rank FROM {t})"


def _mean_sql(table: str, value: str, err: str, times: int) -> str:
    ok = lambda c: f"{c} IS NOT NULL AND NOT isnan({c})"
    return f"SELECT {times} * avg(CASE WHEN {ok(value)} THEN {value} END) AS b, {times} * sqrt(sum(CASE WHEN {ok(err)} THEN {err} * {err} END)) / count(*) AS b_err FROM {table} WHERE {_SOME}"


_ONE = {
    "zero": "SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS b_err",
    "min": "SELECT min(d) AS b, arg_min(err, d) AS b_err FROM aa WHERE tau = 1 AND NOT isnan(d)",
    "high_q": _mean_sql("aa", "d", "err", 1),
    "power_spec": _mean_sql("aa_extra", "power_spec", "power_spec_err", 2),
    "var": _mean_sql("aa_extra", '"var"', "var_err", 2),
}
_NOISE_POLY = (
    f"first AS (SELECT *, max(CASE WHEN err IS NULL OR isnan(err) THEN 1 ELSE 0 END) OVER (PARTITION BY bin) AS bad FROM {_FIVE.format(by='bin', t='aa')} WHERE rank <= 5)",
    "weighted AS (SELECT *, CASE WHEN bad = 1 THEN 1.0 ELSE 1 / err END AS wt FROM first WHERE NOT isnan(d))",
    S.quadratic("weighted", "bin", "d", "wt"),
    "noise AS (SELECT r.bin, coalesce(p.b, 'NaN'::DOUBLE) AS b, coalesce(p.b_err, 'NaN'::DOUBLE) AS b_err FROM (SELECT DISTINCT bin FROM aa) r LEFT JOIN poly p USING (bin))",
)


def _noise_parts(mode: str) -> tuple[str, ...]:
    return _NOISE_POLY if mode == "polyfit" else (f"one AS ({_ONE[mode]})", "noise AS (SELECT bin, b, b_err FROM (SELECT DISTINCT bin FROM aa), one)")


_RANGE = {"k_min": 1.0, "k_max": 3.0}
for _mode in noise.MODES:
    _args = _RANGE if _mode in ("high_q", "power_spec", "var") else {}
    query(f"noise_radial_{_mode}", S.with_(*TO_AA, *_noise_parts(_mode)) + f"SELECT bin, {S.r('b', 'b')}, {S.r('b_err', 'b_err')} FROM noise")(
        lambda spark, sf_dir, m=_mode, a=_args: noise.noise_of(*_aa(spark, sf_dir, keep=True)[:2], m, **a).select("bin", *_r("b", "b_err"))
    )

_PLANE = {
    "zero": "SELECT iy, ix, 0.0::DOUBLE AS b FROM extra",
    "min": "SELECT e.iy, e.ix, o.b FROM extra e, (SELECT min(d) AS b FROM sf JOIN qgrid USING (iy, ix) WHERE lag = 1 AND ix <> 0 AND iy <> 4) o",
    "high_q": f"SELECT e.iy, e.ix, o.b FROM extra e, (SELECT avg(d) AS b FROM sf JOIN qgrid USING (iy, ix) WHERE ix <> 0 AND iy <> 4 AND {_SOME}) o",
    "power_spec": f"SELECT e.iy, e.ix, o.b FROM extra e, (SELECT 2 * avg(power_spec) AS b FROM extra JOIN qgrid USING (iy, ix) WHERE ix <> 0 AND iy <> 4 AND {_SOME}) o",
    "var": f"SELECT e.iy, e.ix, o.b FROM extra e, (SELECT 2 * avg(\"var\") AS b FROM extra JOIN qgrid USING (iy, ix) WHERE ix <> 0 AND iy <> 4 AND {_SOME}) o",
}
for _mode in noise.MODES:
    if _mode == "polyfit":
        _sql = S.with_(*TO_SF, S.wave_grid(GRID), f"first AS (SELECT * FROM {_FIVE.format(by='iy, ix', t='sf')} WHERE rank <= 5)", S.quadratic("first", "iy, ix", "d", scaled=True)) + f"SELECT iy, ix, {S.r('b', 'b')}, {S.r('b_err', 'b_err')} FROM poly"
    else:
        _sql = S.with_(*TO_SF, S.wave_grid(GRID), f"noise AS ({_PLANE[_mode]})") + f"SELECT iy, ix, {S.r('b', 'b')}, {S.r('b', 'b_err')} FROM noise"
    _args = _RANGE if _mode in ("high_q", "power_spec", "var") else {}
    query(f"noise_plane_{_mode}", _sql)(lambda spark, sf_dir, m=_mode, a=_args: noise.noise_of(*_sf(spark, sf_dir), m, G.qgrid(spark, GRID), mask=G.central_cross(GRID), **a).select("iy", "ix", *_r("b", "b_err")))


# Correlation function


def _isf_sql(mode: str, plateau: str, tail: str = "") -> str:
    p, pe = f'2 * e."{plateau}"', f"2 * e.{plateau}_err"
    return S.with_(
        *TO_AA, *_noise_parts(mode),
        f"parts AS (SELECT a.bin, a.k, a.tau, a.d, a.err AS sd, n.b, n.b_err AS sb, {p} AS p, {pe} AS sp FROM aa a JOIN noise n USING (bin) JOIN aa_extra e USING (bin))",
        "isf AS (SELECT bin, k, tau, 1 - (d - b) / (p - b) AS f, sqrt(pow((d - b) / pow(p - b, 2) * sp, 2) + pow((p - d) / pow(p - b, 2) * sb, 2) + pow(sd / (p - b), 2)) AS err FROM parts)",
    ) + (tail or f"SELECT bin, {S.r('k', 'k')}, tau, {S.r('f', 'f')}, {S.r('err', 'err')} FROM isf")


for _mode, _plateau in (("polyfit", "var"), ("zero", "power_spec")):
    query(f"isf_{_mode}_{_plateau}", _isf_sql(_mode, _plateau))(lambda spark, sf_dir, m=_mode, p=_plateau: isf.intermediate_scattering(*_aa(spark, sf_dir, keep=True)[:2], m, p).select("bin", *_r("k"), "tau", *_r("f", "err")))

_CUSTOM = """noise AS (SELECT bin, min(d) / 2 AS b, max(err) / 4 AS b_err FROM aa GROUP BY bin), plateau AS (SELECT bin, 2 * max(d) AS p, NULL::DOUBLE AS p_err FROM aa GROUP BY bin),
parts AS (SELECT a.bin, a.k, a.tau, a.d, a.err AS sd, n.b, n.b_err AS sb, p.p, coalesce(p.p_err, p.p) AS sp FROM aa a JOIN noise n USING (bin) JOIN plateau p USING (bin))"""


@query("isf_custom_tables", S.with_(*TO_AA, _CUSTOM) + f"SELECT bin, {S.r('k', 'k')}, tau, {S.r('1 - (d - b) / (p - b)', 'f')}, {S.r('sqrt(pow((d - b) / pow(p - b, 2) * sp, 2) + pow((p - d) / pow(p - b, 2) * sb, 2) + pow(sd / (p - b), 2))', 'err')} FROM parts")
def isf_custom_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    aa, extra, _ = _aa(spark, sf_dir, keep=True)
    noise_table = aa.groupBy("seq_id", "bin").agg((F.min("d") / 2).alias("b"), (F.max("err") / 4).alias("b_err"))
    plateau = aa.groupBy("seq_id", "bin").agg((2 * F.max("d")).alias("p"), F.lit(None).cast("double").alias("p_err"))
    return isf.intermediate_scattering(aa, extra, noise_table, plateau).select("bin", *_r("k"), "tau", *_r("f", "err"))


# Models

_VALUES = {"A": 0.9, "Gamma": 0.35, "beta": 1.3, "B": 0.2, "Gamma1": 0.8, "beta1": 0.9, "Gamma2": 0.05, "beta2": 1.1, "alpha": 0.6, "sigma": 0.7, "tau": 2.5, "amplitude": 1.4}
_FIXED = {"simple_exponential": {"beta": 1.0}, "simple_exponential_isf": {"beta": 1.0}, "stretched_exponential": {"beta": 0.7}, "stretched_exponential_isf": {"beta": 0.7}, "exponential_distribution": {"sigma": 1.0}, "exponential_distribution_isf": {"sigma": 1.0}}


def _model_sql(name: str) -> str:
    v = {**_VALUES, **_FIXED.get(name, {})}
    if name == "simple_exp":
        return f"{v['amplitude']} * exp(-x / {v['tau']})"
    if name == "simple_structure_function":
        return f"{v['A']} * (1 - exp(-x / {v['tau']})) + {v['B']}"
    if "double" in name:
        f = f"({v['alpha']} * exp(-pow({v['Gamma1']} * x, {v['beta1']})) + (1 - {v['alpha']}) * exp(-pow({v['Gamma2']} * x, {v['beta2']})))"
    elif "exponential_distribution" in name or "schulz" in name:
        f = f"pow(1 + {v['sigma']} * {v['sigma']} * {v['Gamma']} * x, -1.0 / ({v['sigma']} * {v['sigma']}))"
    else:
        f = f"exp(-pow({v['Gamma']} * x, {v['beta']}))"
    return f"{v['A']} * {f}" if name.endswith("_isf") else f"{v['A']} * (1 - {f}) + {v['B']}"


for _name, _model in MODELS.items():
    query(f"model_{_name}", f"SELECT l_linenumber AS x_key, {S.r(f'sum({_model_sql(_name)})', 'y')} FROM (SELECT l_linenumber, l_quantity / 10 AS x FROM lineitem) GROUP BY l_linenumber")(
        lambda spark, sf_dir, m=_model, v={**_VALUES, **_FIXED.get(_name, {})}: _table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_quantity") / 10).alias("x")).groupBy(F.col("l_linenumber").alias("x_key")).agg(F.sum(m.column(F.col("x"), **{p: v[p] for p in m.params})).alias("y")).select("x_key", *_r("y"))
    )


# Merging, resampling

FAST, SLOW = [1, 2, 3, 5, 8, 13], [1, 2, 3, 4, 5, 6, 7]
_G85 = G.Grid.of(8, 5)
_E85 = _edges(_G85, 4)
_TWO_LISTS = ([float(x) for x in FAST], [6.0 * x for x in SLOW])


def _rate(spark: SparkSession, sf_dir: str, hours: int, n: int, lags: list[int], keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Radial averages of the event cube at one frame every so many hours."""
    g = G.Grid.of(8, 5, delta_t=float(hours))
    slices = temporal.structure_slices(raster.event_cube(_table(spark, sf_dir, "events"), hours), g, n, lags)
    return radial.radial_slices(slices, g, bins=4, keep=keep)[:2]


def _two_rates(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hourly and six-hourly radial averages, each with its extras."""
    return (*_rate(spark, sf_dir, 1, 720, FAST, keep), *_rate(spark, sf_dir, 6, 120, SLOW, keep))


def _magnitudes(aa: DataFrame, extra: DataFrame) -> DataFrame:
    """|f|, so that logarithms exist."""
    return isf.intermediate_scattering(aa, extra, "zero", "power_spec").withColumn("f", F.abs("f"))


_MAGNITUDES = "abs(1 - d / (2 * power_spec)) AS f, sqrt(pow(d / pow(2 * power_spec, 2) * 2 * power_spec_err, 2) + pow(a.err / (2 * power_spec), 2)) AS err"


def _rate_sql(hours: int, lags: list[int], out: str = "SELECT bin, k, tau, d, err FROM aa") -> str:
    return "(" + S.with_(EVENTS.replace("3600", str(3600 * hours)), S.spectrum(_G85), S.structure(lags, float(hours)), S.wave_grid(_G85), S.rings(*_E85)) + f"{out})"


_ISF_RATE = f"SELECT a.bin, a.k, tau, {_MAGNITUDES} FROM aa a JOIN aa_extra e USING (bin)"


@query("aa_mergesort", f"SELECT bin, {S.r('k', 'k')}, tau, {S.r('d', 'd')}, {S.r('err', 'err')} FROM ({_rate_sql(1, FAST)} UNION ALL {_rate_sql(6, SLOW)})")
def aa_mergesort(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, b, _ = _two_rates(spark, sf_dir)
    return merge.mergesort(a, b).select("bin", *_r("k"), "tau", *_r("d", "err"))


@query("isf_mergesort", f"SELECT bin, {S.r('k', 'k')}, tau, {S.r('f', 'f')}, {S.r('err', 'err')} FROM ({_rate_sql(1, FAST, _ISF_RATE)} UNION ALL {_rate_sql(6, SLOW, _ISF_RATE)})")
def isf_mergesort(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ea, b, eb = _two_rates(spark, sf_dir, True)
    return merge.mergesort(_magnitudes(a, ea), _magnitudes(b, eb), "f").select("bin", *_r("k"), "tau", *_r("f", "err"))


def _melt_sql(value: str, out: str) -> str:
    """Two slow times lie below the last fast one; the fast time nearest to the second is the last one, 13."""
    fast, slow = _rate_sql(1, FAST, out), _rate_sql(6, SLOW, out)
    return f"""WITH fast AS {fast}, slow AS {slow}, w AS {S.spline_weights(FAST, [6.0, 12.0], 3)},
over AS (SELECT f.bin, w.tau, exp(sum(w.w * ln(f.{value}))) AS o FROM fast f JOIN w ON w.src = f.tau GROUP BY f.bin, w.tau),
alpha AS (SELECT o.bin, sum(o.o * s.{value}) / sum(o.o * o.o) AS a FROM over o JOIN slow s ON s.bin = o.bin AND s.tau = o.tau GROUP BY o.bin),
melted AS (SELECT f.bin, f.k, f.tau, f.{value} * a.a AS v, f.err * a.a AS err FROM fast f JOIN alpha a USING (bin) UNION ALL SELECT bin, k, tau, {value}, err FROM slow WHERE tau > 12)
SELECT bin, {S.r('k', 'k')}, tau, {S.r('v', value)}, {S.r('err', 'err')} FROM melted"""


@query("aa_melt", _melt_sql("d", "SELECT bin, k, tau, d, err FROM aa"))
def aa_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, b, _ = _two_rates(spark, sf_dir)
    return merge.melt(a, b, tau_lists=_TWO_LISTS).select("bin", *_r("k"), "tau", *_r("d", "err"))


@query("isf_melt", _melt_sql("f", _ISF_RATE))
def isf_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ea, b, eb = _two_rates(spark, sf_dir, True)
    return merge.melt(_magnitudes(a, ea), _magnitudes(b, eb), "f", _TWO_LISTS).select("bin", *_r("k"), "tau", *_r("f", "err"))


_EXTRA_OUT = f"SELECT bin, {S.r('power_spec', 'power_spec')}, {S.r('power_spec_err', 'power_spec_err')}, {S.r('"var"', '"var"')}, {S.r('var_err', 'var_err')}"


@query("aa_melt_extra", f"{_EXTRA_OUT} FROM {_rate_sql(6, SLOW, 'SELECT * FROM aa_extra')}")
def aa_melt_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.melt_extra(*_two_rates(spark, sf_dir, True)).select("bin", *_r("power_spec", "power_spec_err", "var", "var_err"))


@query("aa_mergesort_extra", f"{_EXTRA_OUT} FROM {_rate_sql(6, SLOW, 'SELECT * FROM aa_extra')}")
def aa_mergesort_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.mergesort_extra(*_two_rates(spark, sf_dir, True)).select("bin", *_r("power_spec", "power_spec_err", "var", "var_err"))


TO_TAU = [1.5, 2.5, 4.0, 6.0, 10.0, 15.0]


def _resample_sql(value: str, out: str) -> str:
    return f"""WITH curves AS ({out}), w AS {S.spline_weights(LAGS, TO_TAU, 2)}
SELECT bin, w.tau, {S.r('any_value(k)', 'k')}, {S.r(f'exp(sum(w.w * ln({value})))', value)}, {S.r('exp(sum(w.w * ln(err)))', 'err')} FROM curves c JOIN w ON w.src = c.tau GROUP BY bin, w.tau"""


@query("aa_resample", _resample_sql("d", S.with_(*TO_AA) + "SELECT bin, k, tau, d, err FROM aa"))
def aa_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.resample(_aa(spark, sf_dir)[0], TO_TAU, tau_lists=[LAGS]).select("bin", *_r("k"), "tau", *_r("d", "err"))


@query("aa_resample_own_tau", S.with_(*TO_AA) + f"SELECT bin, tau, {S.r('d', 'd')} FROM aa")
def aa_resample_own_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.resample(_aa(spark, sf_dir)[0], [float(x) for x in LAGS]).select("bin", "tau", *_r("d"))


@query("isf_resample", _resample_sql("f", S.with_(*TO_AA) + _ISF_RATE))
def isf_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.resample(_magnitudes(*_aa(spark, sf_dir, keep=True)[:2]), TO_TAU, "f", [LAGS]).select("bin", *_r("k"), "tau", *_r("f", "err"))


# Fits: of the rings, and of planted curves whose parameters are aggregates


@query("fit_curves")
def fit_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MODELS["simple_structure_function"]
    return fit.wide(fit.fit_curves(_aa(spark, sf_dir)[0], m, estimate_simple_parameters=True), m)


@query("fit_multik")
def fit_multik(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MODELS["simple_exponential"]
    return fit.wide(fit.fit_multik(_aa(spark, sf_dir)[0], m, 2, use_err=True), m)


_PLANTED = {
    "simple_structure_function": {"A": "1 + avg(l_quantity) / 20", "tau": "avg(l_quantity) / 10", "B": "avg(l_discount)"},
    "generic_exponential": {"A": "1 + avg(l_quantity) / 20", "Gamma": "avg(l_quantity) / 80", "beta": "0.7 + avg(l_tax) * 10", "B": "avg(l_discount)"},
}


def _planted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A curve for each line number of each return flag, made with known parameters: a sequence for each flag."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("seq_id"), F.col("l_linenumber").cast("int").alias("bin")).agg(*[F.expr(e).alias(p) for p, e in _PLANTED[name].items()])
    rows = rows.withColumn("tau_at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: i * 0.4)))
    d = MODELS[name].column(F.col("tau_at"), **{p: F.col(p) for p in _PLANTED[name]})
    return rows.select("seq_id", "bin", F.col("bin").cast("double").alias("k"), d.alias("d"), F.col("tau_at").alias("tau"), F.lit(1.0).alias("err"))


def _planted_sql(name: str) -> str:
    return f"SELECT l_returnflag AS seq_id, CAST(l_linenumber AS INTEGER) AS bin, {', '.join(f'round({e}, 3) + 0.0 AS {p}' for p, e in _PLANTED[name].items())}, true AS success FROM lineitem GROUP BY ALL"


def _found(fits: DataFrame, name: str) -> DataFrame:
    return fit.wide(fits, MODELS[name]).select("seq_id", "bin", *[(F.round(p, 3) + 0.0).alias(p) for p in _PLANTED[name]], "success")


@query("fit_planted_curves", _planted_sql("simple_structure_function"))
def fit_planted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "simple_structure_function"
    return _found(fit.fit_curves(_planted(spark, sf_dir, name), MODELS[name], estimate_simple_parameters=True), name)


@query("fit_planted_multik", _planted_sql("generic_exponential"))
def fit_planted_multik(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "generic_exponential"
    return _found(fit.fit_multik(_planted(spark, sf_dir, name), MODELS[name], 3, use_err=True), name)


_ESTIMATES = S.with_(
    *TO_AA,
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY tau) AS r, count(*) OVER (PARTITION BY bin) AS n FROM aa)",
    S.quadratic("(SELECT bin, tau - (max(tau) OVER (PARTITION BY bin) + min(tau) OVER (PARTITION BY bin)) / 2 AS tau, d FROM ranked WHERE r <= 5)", "bin", "d"),
    "ab AS (SELECT r.bin, greatest(p.b, 0.0) AS b, greatest(max(CASE WHEN r = n THEN d END) - greatest(p.b, 0.0), 0.0) AS a FROM ranked r JOIN poly p USING (bin) GROUP BY r.bin, p.b)",
) + f"SELECT a.bin, {S.r('a.a', '"A"')}, {S.r('a.b', '"B"')}, CASE WHEN a.a > 0 THEN arg_min(r.tau, abs((r.d - a.b) / a.a - 0.5)) ELSE 1.0 END AS tau FROM ab a JOIN ranked r USING (bin) GROUP BY a.bin, a.a, a.b"


@query("fit_estimates", _ESTIMATES)
def fit_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.estimates(_aa(spark, sf_dir)[0]).select("bin", *_r("A", "B"), "tau")


@query("model_over_rings", S.with_(*TO_AA) + f"SELECT bin, tau, {S.r('1.5 * (1 - exp(-tau / 2.5)) + 0.25', 'model')} FROM aa")
def model_over_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.evaluate_model(_aa(spark, sf_dir)[0], MODELS["simple_structure_function"], A=1.5, tau=2.5, B=0.25).select("bin", "tau", *_r("model"))


# Files: written to the shared folder and read again


@query("container_sf_roundtrip", S.with_(*TO_SF) + f"SELECT CAST(list_position({LAGS}, lag) - 1 AS INTEGER) AS slice, tau, iy, ix, {S.r('d', 'd')} FROM sf WHERE lag IN (3, 5, 8)")
def container_sf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    (path,) = container.save_sf(*_sf(spark, sf_dir), GRID, shared_dir(spark, "sf"))
    return container.load(spark, path).where("slice >= 2 AND slice >= 1 AND slice < 5 AND slice IN (0, 2, 3, 4) AND slice IN (2, 3, 4, 5)").select("slice", "tau", "iy", "ix", *_r("d"))


@query("container_sf_grid", S.with_(*TO_SF, S.wave_grid(G.Grid.of(8, 8, 0.5))) + f"SELECT lag, iy, ix, {S.r('ky', 'ky')}, {S.r('kx', 'kx')}, mult, {S.r('d', 'd')} FROM sf JOIN qgrid USING (iy, ix)")
def container_sf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    (path,) = container.save_sf(*_sf(spark, sf_dir), G.Grid.of(8, 8, 0.5), shared_dir(spark, "sf"))
    lag = F.element_at(F.array(*map(F.lit, LAGS)), F.col("slice") + 1).alias("lag")
    return container.load(spark, path).join(container.grid_of(spark, path), ["iy", "ix"]).select(lag, "iy", "ix", *_r("ky", "kx"), "mult", *_r("d"))


@query("container_aa_roundtrip", S.with_(*TO_AA) + _AA_OUT + " WHERE bin >= 1 AND bin <> 3")
def container_aa_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    aa, extra, edges = _aa(spark, sf_dir, keep=True)
    (path,) = container.save_radial(aa, shared_dir(spark, "aa"), edges, extra)
    return container.load(spark, path).where("bin >= 1 AND bin >= 0 AND bin <> 3").select("bin", *_r("k"), "tau", *_r("d", "err"))


_BOTH_RATES = f"({_rate_sql(1, FAST)} UNION ALL {_rate_sql(6, SLOW)})"


@query("container_merged_roundtrip", f"SELECT bin, {S.r('k', 'k')}, tau, {S.r('d', 'd')}, {S.r('err', 'err')} FROM {_BOTH_RATES.replace(str(SLOW), str([1, 2, 3]))} UNION ALL SELECT bin, {S.r('k', 'k')}, tau, {S.r('d', 'd')}, {S.r('err', 'err')} FROM {_rate_sql(1, [3, 6, 12])}")
def container_merged_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged curves of two rates and a third one, whose lists of tau have 3, 6 and 12 in common: the file keeps the repeats."""
    fast, slow, more = (_rate(spark, sf_dir, h, n, lags)[0] for h, n, lags in ((1, 720, FAST), (6, 120, [1, 2, 3]), (1, 720, [3, 6, 12])))
    (path,) = container.save_radial(merge.mergesort(merge.mergesort(fast, slow), more), shared_dir(spark, "merged"), _E85[0])
    return container.load(spark, path).select("bin", *_r("k"), "tau", *_r("d", "err"))


# A sequence for each return flag, a container each.
_FLAGS = S.with_(
    "cells AS (SELECT l_returnflag AS seq_id, year(l_shipdate) * 12 + month(l_shipdate) AS m, l_suppkey % 8 AS y, l_partkey % 8 AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)",
    "frames AS (SELECT seq_id, CAST(m - (SELECT min(m) FROM cells) AS INTEGER) AS t, y, x, v FROM cells)",
    S.spectrum(GRID).replace("SELECT t,", "SELECT seq_id, t,").replace("GROUP BY t, jy, jx", "GROUP BY seq_id, t, jy, jx"),
    S.structure(LAGS).split("extra AS")[0].rstrip(",\n ").replace("SELECT CAST(lag", "SELECT a.seq_id, CAST(lag").replace("b.iy = a.iy", "b.seq_id = a.seq_id AND b.iy = a.iy").replace("GROUP BY lag,", "GROUP BY a.seq_id, lag,"),
)


@query("container_folder_scan", _FLAGS + f"SELECT seq_id, tau, iy, ix, {S.r('d', 'd')} FROM sf WHERE seq_id <> 'A' AND tau BETWEEN 2 AND 7")
def container_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "folder")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    cells = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("seq_id"), month.alias("m"), (F.col("l_suppkey") % 8).cast("int").alias("y"), (F.col("l_partkey") % 8).cast("int").alias("x")).agg(F.sum("l_quantity").cast("double").alias("v"))
    frames = cells.crossJoin(F.broadcast(cells.agg(F.min("m").alias("first")))).select("seq_id", (F.col("m") - F.col("first")).alias("t"), "y", "x", "v")
    container.save_sf(*temporal.structure_function(frames, GRID, N_MONTHS, LAGS), GRID, folder)
    return container.load_folder(spark, folder, "sf").where("seq_id > 'A' AND tau >= 2 AND tau <= 7").select("seq_id", "tau", "iy", "ix", *_r("d"))


@query("container_isf_roundtrip", _isf_sql("zero", "power_spec"))
def container_isf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    aa, extra, edges = _aa(spark, sf_dir, keep=True)
    (path,) = container.save_radial(isf.intermediate_scattering(aa, extra, "zero", "power_spec"), shared_dir(spark, "isf"), edges, kind="isf")
    return container.load(spark, path).select("bin", *_r("k"), "tau", *_r("f", "err"))


_FRAMES_OUT = f"SELECT CAST(m.range AS INTEGER) AS t, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, coalesce(f.v, 0.0) AS v FROM range({N_MONTHS}) m, range(8) a, range(8) b LEFT JOIN frames f ON f.t = m.range AND f.y = a.range AND f.x = b.range"


@query("tiff_roundtrip", S.with_(S.cube()) + _FRAMES_OUT)
def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tiff")
    paths = tiff.save_frames(raster.pack(_cube(spark, sf_dir), 8, 8), folder, dtype="f8")
    return raster.unpack(tiff.read_images(spark, paths)).drop("seq_id")


@query("tiff_metadata", S.with_(S.cube()) + "SELECT CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(64 AS INTEGER) AS bits, count(DISTINCT t) AS files FROM frames")
def tiff_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tiff.save_frames(raster.pack(_cube(spark, sf_dir), 8, 8), shared_dir(spark, "tiff"), dtype="f8")
    tags = tiff.read_metadata(spark, paths).select(*[F.col("tags")[tag].cast("int").alias(name) for name, tag in (("width", "ImageWidth"), ("height", "ImageLength"), ("bits", "BitsPerSample"))])
    return tags.groupBy("width", "height", "bits").agg(F.count(F.lit(1)).alias("files"))


@query("tiff_pages", S.with_(S.cube()) + _FRAMES_OUT + " WHERE m.range % 3 <> 1")
def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with a page for each month, of which the filter reads two thirds."""
    path = tiff.save_stack(raster.pack(_cube(spark, sf_dir), 8, 8), shared_dir(spark, "stack"), "stack.tif", "f8")
    months = [t for t in range(N_MONTHS) if t % 3 != 1]
    return raster.unpack(tiff.read_images(spark, path, seq=months)).drop("seq_id")


@query("tiff_slices_roundtrip", S.with_(*TO_SF) + "SELECT lag, iy, ix, round(CAST(CAST(d AS FLOAT) AS DOUBLE), 1) + 0.0 AS d FROM (" + _FULL.replace("round(d, 6) + 0.0 AS d", "d") + ")")
def tiff_slices_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tiff")
    paths = tiff.save_slices(spectral.full_plane(_sf(spark, sf_dir)[0], GRID), 8, 8, folder, {lag: f"{i:02d}.tif" for i, lag in enumerate(LAGS)})
    back = raster.unpack(tiff.read_images(spark, paths))
    return back.select(F.element_at(F.array(*map(F.lit, LAGS)), F.col("t") + 1).alias("lag"), F.col("y").alias("iy"), F.col("x").alias("ix"), (F.round("v", 1) + 0.0).alias("d"))
