"""The file sink (commit, abort, repeated tasks), containers of merged and ragged curves, folders of containers."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThanOrEqual

from lagfield import Grid
from lagfield.operators import merge
from lagfield.sources import container, shared, tiff
from lagfield.sources.writing import CommittedFiles, Written

WIRE = pa.schema([("name", pa.string()), ("pos", pa.int64()), ("v", pa.float64()), ("content", pa.binary())])


def batch(*rows):
    return pa.RecordBatch.from_pylist([dict(zip(WIRE.names, r, strict=True)) for r in rows], WIRE)


def curves(spark, rings, seq_id="s"):
    """rings: bin -> list of (tau, d, err)."""
    return spark.createDataFrame([(seq_id, b, b / 2, float(t), float(d), e) for b, points in rings.items() for t, d, e in points], "seq_id string, bin int, k double, tau double, d double, err double")


def values(df, name="d"):
    return sorted((r.bin, r.tau, r[name], r.err) for r in df.collect())


# The sink


def test_files_appear_on_commit_only(tmp_path):
    w = CommittedFiles(str(tmp_path), False)
    first = w.write(iter([batch(("a", -1, None, b"HEAD"), ("a", 1, 1.5, None)), batch(("a", 2, 2.5, None), ("a", 4, None, b"TAIL"), ("b/c", -1, None, b"x"))]))
    again = w.write(iter([batch(("a", -1, None, b"HEAD"))]))  # the same rows by a task that is run twice, and lost
    assert sorted(os.listdir(tmp_path)) == [os.path.basename(w.beside)] and again.files != first.files
    w.commit([first, None, Written([])])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and (tmp_path / "b" / "c").read_bytes() == b"x"
    raw = (tmp_path / "a").read_bytes()
    assert raw[:4] == b"HEAD" and raw[-4:] == b"TAIL" and np.array_equal(np.frombuffer(raw[4:-4]), [np.nan, 1.5, 2.5, np.nan], equal_nan=True)


def test_holes_longer_than_a_buffer(tmp_path):
    w = CommittedFiles(str(tmp_path), True, "f4")
    w.commit([w.write(iter([batch(("a", 200_000, 7.0, None), ("a", 200_003, None, b""))]))])
    got = np.frombuffer((tmp_path / "a").read_bytes(), "f4")
    assert len(got) == 200_003 and got[200_000] == 7 and np.isnan(got).sum() == 200_002


@pytest.mark.parametrize("rows", [[("a", 0, 1.0, None), ("a", 0, 2.0, None)], [("a", 3, None, b"end"), ("a", 3, 1.0, None)], [("a", 5, 1.0, None), ("a", 3, None, b"end")]])
def test_two_values_for_a_place_are_refused(tmp_path, rows):
    w = CommittedFiles(str(tmp_path), True)
    with pytest.raises(ValueError, match="position"):
        w.write(iter([batch(*rows)]))
    w.abort([None])
    assert os.listdir(tmp_path) == []


def test_append_leaves_what_is_there(tmp_path):
    (tmp_path / "a").write_bytes(b"old")
    w = CommittedFiles(str(tmp_path), False)
    done = w.write(iter([batch(("a", -1, None, b"new"), ("z", -1, None, b"new"))]))
    with pytest.raises(FileExistsError):
        w.commit([done])
    assert os.listdir(tmp_path) == ["a"] and (tmp_path / "a").read_bytes() == b"old"
    w = CommittedFiles(str(tmp_path), True)
    w.commit([w.write(iter([batch(("a", -1, None, b"new"))]))])
    assert (tmp_path / "a").read_bytes() == b"new"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    g, folder = Grid.of(4, 4), str(tmp_path / "out")
    cells = spark.range(4).select((F.col("id") + 1).cast("int").alias("lag"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("p"))
    sf = cells.select(F.lit("s").alias("seq_id"), "lag", F.col("lag").cast("double").alias("tau"), F.floor(F.col("p") / 3).cast("int").alias("iy"), (F.col("p") % 3).cast("int").alias("ix"), F.rand(1).alias("d"))
    extra = sf.where("lag = 1").select("seq_id", "iy", "ix", F.lit(1.0).alias("power_spec"), F.lit(2.0).alias("var"))
    other = lambda df: df.withColumn("seq_id", F.lit("good"))
    with pytest.raises(Exception, match="two values for position"):
        container.save_sf(sf.unionByName(sf).unionByName(other(sf)), extra.unionByName(other(extra)), g, folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    paths = container.save_sf(sf.unionByName(other(sf)), extra.unionByName(other(extra)), g, folder, "run-{}".format, np.float32)
    assert [os.path.basename(p) for p in paths] == sorted(os.listdir(folder)) == ["run-good.sf.ddm", "run-s.sf.ddm"]
    assert container.metadata(paths[0])["dtype"] == "f" and container.load(spark, paths[0]).count() == 48 and (container.extras(paths[1])["var"] == 2).all()
    assert container.save_sf(sf.where("false"), extra.where("false"), g, folder) == []


def test_saving_leaves_no_step_tables(spark, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    container.save_radial(curves(spark, {0: [(1, 1, 0.1)]}), str(tmp_path), [0.0])
    frames = spark.createDataFrame([("s", 0, 1, 1, [2.0])], "seq_id string, t int, height int, width int, pixels array<double>")
    tiff.save_frames(frames, str(tmp_path))
    assert {n for n in set(os.listdir(base)) - before if n.startswith("lagfield-")} == set() and len(os.listdir(tmp_path)) == 2


def test_missing_wavevectors_are_nan(spark, tmp_path):
    sf = spark.createDataFrame([("s", 2, 2.0, 1, 1, 5.0)], "seq_id string, lag int, tau double, iy int, ix int, d double")
    extra = spark.createDataFrame([("s", 0, 0, 3.0, 4.0)], "seq_id string, iy int, ix int, power_spec double, var double")
    (path,) = container.save_sf(sf, extra, Grid.of(2, 2), str(tmp_path))
    assert np.array_equal(container.slice_of(path, "sf", 0), [[np.nan, np.nan], [np.nan, 5]], equal_nan=True)
    assert np.array_equal(container.extras(path)["power_spec"], [[3, np.nan], [np.nan, np.nan]], equal_nan=True)


# Curves


def test_repeated_tau_are_kept(spark, tmp_path):
    a = curves(spark, {0: [(1, 10, 0.1), (2, 11, 0.2)], 3: [(1, 20, 0.3), (2, 21, 0.4)]})
    b = curves(spark, {0: [(2, 12, 0.5), (3, 13, 0.6)], 3: [(2, 20.5, None), (3, 23, 0.8)]})
    merged = merge.mergesort(a, b)
    extra = spark.createDataFrame([("s", 0, 1.0, 2.0, 0.1, None), ("s", 3, 3.0, 4.0, 0.3, 0.4)], "seq_id string, bin int, power_spec double, var double, power_spec_err double, var_err double")
    (path,) = container.save_radial(merged, str(tmp_path), [0.0, 1.0], extra)
    got = container.load(spark, path).orderBy("bin", "tau", "d").collect()
    assert [(r.bin, r.k, r.tau, r.d) for r in got] == [(0, 0.0, 1, 10), (0, 0.0, 2, 11), (0, 0.0, 2, 12), (0, 0.0, 3, 13), (1, 1.5, 1, 20), (1, 1.5, 2, 20.5), (1, 1.5, 2, 21), (1, 1.5, 3, 23)]
    errs = [r.err for r in got]
    assert errs[:5] == [0.1, 0.2, 0.5, 0.6, 0.3] and np.isnan(errs[5]) and errs[6:] == [0.4, 0.8]
    assert container.metadata(path) == {"kind": "aa", "dtype": "d", "Nk": 2, "Nt": 4, "Nextra": 2}
    x = container.extras(path)
    assert x["power_spec"].tolist() == [1, 3] and x["var"].tolist() == [2, 4] and x["tau"].tolist() == [1, 2, 2, 3]
    assert container.slice_of(path, "aa", 1, err=True)[-1] == 0.4


@pytest.mark.parametrize("rings", [{0: [(1, 1, 0.1), (2, 2, 0.1)], 1: [(1, 3, 0.1)]}, {0: [(1, 1, 0.1), (2, 2, 0.1)], 1: [(1, 3, 0.1), (3, 4, 0.1)]}, {0: [(1, 1, 0.1), (1, 2, 0.1), (2, 2, 0.1)], 1: [(1, 1, 0.1), (2, 2, 0.1), (2, 2, 0.1)]}])
def test_ragged_rings_are_refused(spark, tmp_path, rings):
    with pytest.raises(ValueError, match="differ in their lists of tau"):
        container.save_radial(curves(spark, rings), str(tmp_path), [0.0])
    assert os.listdir(tmp_path) == []


def test_curves_without_errors(spark, tmp_path):
    rows = curves(spark, {0: [(1, 1, None), (2, float("nan"), None)], 1: [(1, 3, None), (2, 4, None)]})
    (path,) = container.save_radial(rows, str(tmp_path), [0.0, 1.0])
    got = container.load(spark, path).orderBy("bin", "tau").collect()
    assert [r.err for r in got] == [None] * 4 and np.isnan(got[1].d) and [r.d for r in got][2:] == [3, 4]


def test_several_sequences_with_tau_of_their_own(spark, tmp_path):
    both = curves(spark, {0: [(1, 1, 0.1)]}, "x").unionByName(curves(spark, {0: [(5, 2, 0.1), (6, 3, 0.1)]}, "y"))
    paths = container.save_radial(both, str(tmp_path), [0.0])
    assert [container.metadata(p)["Nt"] for p in paths] == [1, 2]
    assert sorted((r.seq_id, r.tau) for r in container.load_folder(spark, str(tmp_path), "aa").collect()) == [("x", 1.0), ("y", 5.0), ("y", 6.0)]


# Folders


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"s{n}", lag, float(lag * (n + 1)), iy, ix, float(100 * n + 10 * lag + iy)) for n in range(6) for lag in (1, 2, 4) for iy in range(2) for ix in range(2)]
    sf = spark.createDataFrame(rows, "seq_id string, lag int, tau double, iy int, ix int, d double")
    extra = sf.where("lag = 1").select("seq_id", "iy", "ix", F.lit(1.0).alias("power_spec"), F.lit(2.0).alias("var"))
    container.save_sf(sf, extra, Grid.of(2, 2), str(tmp_path), "deep/{}".format)
    (tmp_path / "_writing-lost").mkdir()
    (tmp_path / "_writing-lost" / "x.sf.ddm").write_bytes(b"broken")
    return str(tmp_path)


def planned(folder, monkeypatch, *filters):
    """(files opened for planning, files and slices read, rows) of a scan."""
    opened = []
    real = shared.open_read
    monkeypatch.setattr(container, "open_read", lambda p: opened.append(p) or real(p))
    reader = container._Reader(folder, "sf", 1, True)
    left = list(reader.pushFilters(list(filters)))
    parts = reader.partitions()
    headers = len(opened)
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    assert not left and len(parts) <= 1
    return headers, len(opened) - headers, sum(len(n) for p in parts for _, n in p.files), rows


def test_only_files_and_slices_that_fit_are_opened(folder, monkeypatch):
    assert planned(folder, monkeypatch)[0] == 6 and planned(folder, monkeypatch)[2:] == (18, 72)
    assert planned(folder, monkeypatch, EqualTo(("seq_id",), "s3")) == (1, 1, 3, 12)
    assert planned(folder, monkeypatch, In(("seq_id",), ("s3", "none")), EqualTo(("slice",), 2)) == (1, 1, 1, 4)
    # tau of s0: 1, 2, 4; of s5: 6, 12, 24. Headers tell that only two files reach 20.
    assert planned(folder, monkeypatch, GreaterThanOrEqual(("tau",), 20.0))[1:] == (2, 2, 8)
    assert planned(folder, monkeypatch, GreaterThan(("tau",), 2.0), LessThanOrEqual(("tau",), 3.0)) == (6, 1, 1, 4)
    assert planned(folder, monkeypatch, GreaterThan(("tau",), 99.0)) == (6, 0, 0, 0)


def test_folder_rows(spark, folder):
    got = container.load_folder(spark, folder, "sf")
    assert got.count() == 72 and got.where("seq_id IN ('s1', 's2') AND tau > 3 AND d > 0").select("seq_id", "tau").distinct().count() == 4
    assert got.where("tau = 12").agg(F.sum("d")).first()[0] == got.toPandas().query("tau == 12").d.sum()
    with pytest.raises(RuntimeError):
        container.load_folder(spark, folder, "tif")


def test_a_stretch_of_tau_of_a_ring(spark, tmp_path, monkeypatch):
    (path,) = container.save_radial(curves(spark, {b: [(t, 10 * b + t, t / 10) for t in range(1, 9)] for b in range(3)}), str(tmp_path), [0.0])
    got = container.load(spark, path).where("tau >= 3 AND tau < 5 AND bin <> 1")
    assert values(got) == [(0, 3.0, 3.0, 0.3), (0, 4.0, 4.0, 0.4), (2, 3.0, 23.0, 0.3), (2, 4.0, 24.0, 0.4)]
    sizes, real = [], container.read_array
    monkeypatch.setattr(container, "read_array", lambda f, h, name, shape, skip=0: sizes.append((name, shape)) or real(f, h, name, shape, skip))
    reader = container._Reader(path, "aa", 1, False)
    assert not list(reader.pushFilters([GreaterThanOrEqual(("tau",), 3.0), LessThanOrEqual(("tau",), 4.0)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6 and {s for n, s in sizes if n in ("data", "err")} == {(2,)}


# TIFF


def test_tiff_sink_and_pages(spark, tmp_path):
    frames = spark.createDataFrame([("s", t, 2, 3, [float(t * 10 + k) for k in range(6)]) for t in range(4)], "seq_id string, t int, height int, width int, pixels array<double>")
    paths = tiff.save_frames(frames, str(tmp_path), dtype="u2")
    assert [os.path.basename(p) for p in paths] == [f"s-{t:06d}.tif" for t in range(4)] == sorted(os.listdir(tmp_path))
    assert [r.pixels for r in tiff.read_images(spark, paths).orderBy("t").collect()] == [[float(t * 10 + k) for k in range(6)] for t in range(4)]
    two = frames.unionByName(frames.withColumn("seq_id", F.lit("z"))).select("seq_id", F.col("t").alias("lag"), F.lit(0).alias("iy"), F.lit(0).alias("ix"), F.lit(1.0).alias("d"))
    with pytest.raises(ValueError, match="one sequence"):
        tiff.save_slices(two, 2, 3, str(tmp_path), {t: f"{t}.tif" for t in range(4)})


def test_tiled_pages_are_not_implemented():
    with pytest.raises(NotImplementedError, match="tiles"):
        tiff.page_array(b"II*\0", {"order": "<", "ImageLength": 4, "ImageWidth": 4, "BitsPerSample": 8, "TileOffsets": 8})
