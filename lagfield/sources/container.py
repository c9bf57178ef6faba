"""Binary containers .sf.ddm, .aa.ddm and .isf.ddm, version 0.3, as batch data sources.

Layout: a 64-byte header, arrays in row-major order, and 64-bit offsets at the end of the file, last array first. Readers
seek: a reader's partition is a run of slices (lags of a structure function, rings of the others), and filters on them skip the rest.
All filters on the slice number hold together; the others go back to Spark. Writers give every value its position in the file and stream it there.
"""

from __future__ import annotations

import os
import struct
import sys
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from ..functions.grid import Grid, qgrid
from .shared import Chosen, files_below, open_read, step_tables
from .writing import CommittedFiles

#: Fixed values of the format: identifiers, version, header length.
IDS = {"sf": 73, "aa": 22, "isf": 43}
VERSION, HEAD = (0, 3), 64
COUNTS = {"sf": ("Nt", "Ny", "Nx", "Nextra", "width", "height"), "aa": ("Nk", "Nt", "Nextra"), "isf": ("Nk", "Nt", "Nextra")}
ARRAYS = {"sf": ("data", "kx", "ky", "tau", "pixel_size", "delta_t", "extra"), "aa": ("data", "err", "k", "tau", "bin_edges"), "isf": ("data", "err", "k", "tau", "bin_edges")}


#: Headers that the driver reads at the same time.
HEADERS_AT_ONCE = 32


def array_format(dtype: np.dtype) -> str:
    if np.dtype(dtype) == np.float64:
        return "d"
    if np.dtype(dtype) == np.float32:
        return "f"
    raise NotImplementedError(f"containers hold float64 or float32, not {dtype}")


def file_name(path: str, kind: str) -> str:
    """Appends the extension if it is missing."""
    return path if path.endswith(f".{kind}.ddm") else f"{path}.{kind}.ddm"


@dataclass
class Header:
    kind: str
    order: str
    fmt: str
    counts: dict[str, int]
    has_err: bool
    offsets: dict[str, int]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.order + ("f8" if self.fmt == "d" else "f4"))


def file_ends(kind: str, streamed: dict[str, int], after: dict[str, np.ndarray], counts: dict[str, int], dtype: np.dtype) -> tuple[bytes, bytes, int]:
    """What stands before and after the streamed arrays (their numbers of values by name, in order): header, and the short arrays with the table of offsets; and how many values are between."""
    fmt, size = array_format(dtype), np.dtype(dtype).itemsize
    head = (b"LL" if sys.byteorder == "little" else b"BB") + struct.pack("=HBB", IDS[kind], *VERSION) + fmt.encode() + struct.pack(f"={len(COUNTS[kind])}Q", *(counts[c] for c in COUNTS[kind]))
    if kind != "sf":
        head += struct.pack("=B", streamed["err"] > 0)
    at, offsets, tail = HEAD, {}, b""
    for name, n in streamed.items():
        offsets[name] = at
        at += n * size
    for name, values in after.items():
        offsets[name] = at + len(tail)
        tail += np.ascontiguousarray(values, dtype).tobytes()
    return head.ljust(HEAD, b"\0"), tail + struct.pack(f"={len(offsets)}Q", *(offsets[n] for n in reversed(ARRAYS[kind]))), sum(streamed.values())


def read_header(f: BinaryIO, kind: str) -> Header:
    raw = f.read(HEAD)
    order = {b"LL": "<", b"BB": ">"}.get(raw[:2])
    if order is None:
        raise RuntimeError("no byte-order mark: not a container")
    ident, major, minor = struct.unpack(f"{order}HBB", raw[2:6])
    if ident != IDS[kind]:
        raise RuntimeError(f"identifier {ident} is not that of .{kind}.ddm files, {IDS[kind]}")
    if (major, minor) != VERSION:
        raise OSError(f"version {major}.{minor} is not supported, {VERSION[0]}.{VERSION[1]} is")
    names = COUNTS[kind]
    counts = dict(zip(names, struct.unpack(f"{order}{len(names)}Q", raw[7 : 7 + 8 * len(names)]), strict=True))
    has_err = kind != "sf" and bool(raw[7 + 8 * len(names)])
    n = len(ARRAYS[kind])
    f.seek(-8 * n, os.SEEK_END)
    offsets = dict(zip(ARRAYS[kind], reversed(struct.unpack(f"{order}{n}Q", f.read(8 * n))), strict=True))
    return Header(kind, order, raw[6:7].decode(), counts, has_err, offsets)


def read_array(f: BinaryIO, h: Header, name: str, shape: tuple[int, ...], skip: int = 0) -> np.ndarray:
    f.seek(h.offsets[name] + skip * h.dtype.itemsize)
    n = int(np.prod(shape))
    return np.frombuffer(f.read(n * h.dtype.itemsize), h.dtype).reshape(shape).astype(np.float64)


def slice_of(path: str, kind: str, index: int, err: bool = False, full: bool = False) -> np.ndarray:
    """Random access: lag slice of .sf.ddm (``full``: of the whole plane), ring of the others (``err``: its errors)."""
    with open_read(path) as f:
        h = read_header(f, kind)
        c = h.counts
        n, shape = (c["Nt"], (c["Ny"], c["Nx"])) if kind == "sf" else (c["Nk"], (c["Nt"] + c["Nextra"],))
        if not 0 <= index < n:
            raise IndexError(f"slice {index} of {n}")
        if err and not h.has_err:
            raise KeyError("the container holds no errors")
        out = read_array(f, h, "err" if err else "data", shape, index * int(np.prod(shape)))
        return whole_plane(out, c["width"]) if full else out


def whole_plane(half: np.ndarray, nx: int) -> np.ndarray:
    """Half plane (y shifted) to full plane (both shifted): the mirror image of a wavevector has the same value."""
    ny, last = half.shape[0], (nx - 1) // 2
    back = (ny - np.arange(ny)) % ny if ny % 2 == 0 else ny - 1 - np.arange(ny)
    return np.roll(np.hstack([half, half[back, last:0:-1]]), nx // 2, 1)


def kind_of(path: str) -> str:
    for kind in ("isf", "aa", "sf"):
        if path.endswith(f".{kind}.ddm"):
            return kind
    raise RuntimeError("a container ends in .sf.ddm, .aa.ddm or .isf.ddm")


@dataclass
class Slices(InputPartition):
    """Slices (lags of an sf, rings of the others) of some files: (path, numbers) each."""

    files: list[tuple[str, list[int]]]


def seq_id_of(path: str, kind: str) -> str:
    return path.rstrip("/").rpartition("/")[2].removesuffix(f".{kind}.ddm")


class _Reader(DataSourceReader):
    """One file, or those of a folder. Filters on the sequence choose files by name, those on slice, ring and tau are held against headers; what is left is cut into partitions."""

    def __init__(self, path: str, kind: str, parts: int, folder: bool):
        self.path, self.kind, self.parts, self.folder, self.chosen = path, kind, parts, folder, Chosen()
        self.number = "slice" if kind == "sf" else "bin"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.chosen.take(filters, self.number, "tau", *["seq_id"] * self.folder)

    def _wanted(self, path: str) -> list[int]:
        """The slices of a file that its header lets through."""
        with open_read(path) as f:
            h = read_header(f, self.kind)
            n = self.chosen.among(h.counts["Nt" if self.kind == "sf" else "Nk"], self.number)
            if n and any(c == "tau" for c, _, _ in self.chosen.tests):
                fits = [self.chosen.has("tau", x) for x in read_array(f, h, "tau", (h.counts["Nt"],)).tolist()]
                n = [i for i in n if fits[i]] if self.kind == "sf" else n if any(fits) else []
            return n

    def partitions(self) -> list[Slices]:
        paths = [p for p in files_below(self.path, f".{self.kind}.ddm") if not self.folder or self.chosen.has("seq_id", seq_id_of(p, self.kind))]
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            wanted = list(zip(paths, pool.map(self._wanted, paths), strict=True))
        size = max(1, -(-sum(len(n) for _, n in wanted) // self.parts))
        out: list[Slices] = []
        left = 0
        for path, n in wanted:
            while n:
                if not left:
                    out.append(Slices([]))
                    left = size
                out[-1].files.append((path, n[:left]))
                n, left = n[left:], left - len(n[:left])
        return out

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for path, wanted in partition.files:
            with open_read(path) as f:
                for b in self._slices(f, read_header(f, self.kind), wanted):
                    yield b.append_column("seq_id", pa.array([seq_id_of(path, self.kind)] * b.num_rows, pa.string())) if self.folder else b

    def _slices(self, f: BinaryIO, h: Header, wanted: list[int]) -> Iterator[pa.RecordBatch]:
        c = h.counts
        tau = read_array(f, h, "tau", (c["Nt"],))
        if self.kind == "sf":
            iy, ix = (a.ravel().astype(np.int32) for a in np.indices((c["Ny"], c["Nx"])))
            for i in wanted:
                d = read_array(f, h, "data", (c["Ny"], c["Nx"]), i * c["Ny"] * c["Nx"]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int32)), pa.array(np.full(len(d), tau[i])), pa.array(iy), pa.array(ix), pa.array(d)], ["slice", "tau", "iy", "ix", "d"])
            return
        k, wide = read_array(f, h, "k", (c["Nk"],)), c["Nt"] + c["Nextra"]
        name, fits = "d" if self.kind == "aa" else "f", np.flatnonzero([self.chosen.has("tau", x) for x in tau.tolist()])
        if not len(fits):
            return
        # Of a ring only the stretch from the first wanted tau to the last is read.
        first, n = int(fits[0]), int(fits[-1] - fits[0]) + 1
        for i in wanted:
            v = read_array(f, h, "data", (n,), i * wide + first)[fits - first]
            e = read_array(f, h, "err", (n,), i * wide + first)[fits - first] if h.has_err else [None] * len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(np.full(len(v), k[i])), pa.array(tau[fits]), pa.array(v), pa.array(e, pa.float64())], ["bin", "k", "tau", name, "err"])


class ContainerSource(DataSource):
    """``spark.read.format("ddm").load(path)``; option ``parts``: partitions at most. With option ``kind`` (sf, aa, isf) the path is a folder, whose files
    come with ``seq_id``, their name. Written by way of ``save_sf`` and ``save_radial``."""

    @classmethod
    def name(cls) -> str:
        return "ddm"

    def _kind(self) -> str:
        return self.options.get("kind") or kind_of(self.options["path"])

    def schema(self) -> str:
        kind = self._kind()
        own = "slice int, tau double, iy int, ix int, d double" if kind == "sf" else f"bin int, k double, tau double, {'d' if kind == 'aa' else 'f'} double, err double"
        return f"{own}, seq_id string" if "kind" in self.options else own

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._kind(), int(self.options.get("parts", 8)), "kind" in self.options)

    def writer(self, schema, overwrite: bool) -> CommittedFiles:
        return CommittedFiles(self.options["path"], overwrite, self.options.get("dtype", "f8"))


def load(spark: SparkSession, path: str, seq_id: str = "s0") -> DataFrame:
    """A container as a table, by its extension. Turns filter pushdown of Python sources on for the session."""
    kind_of(path)
    spark.dataSource.register(ContainerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("ddm").option("path", path).load().withColumn("seq_id", F.lit(seq_id))


def load_folder(spark: SparkSession, folder: str, kind: str, parts: int = 200) -> DataFrame:
    """The containers of a kind below ``folder`` as one table with ``seq_id``, their names without the suffix.

    Filters prune before anything is read: on seq_id by name, on slice, bin and tau by the headers, which the driver reads many at a time; a
    task opens only files, and reads only slices, that are left. Of a ring it reads from the first wanted tau to the last.
    """
    if kind not in IDS:
        raise RuntimeError(f"kind is {', '.join(IDS)}")
    spark.dataSource.register(ContainerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("ddm").option("path", folder).option("kind", kind).option("parts", parts).load()


def metadata(path: str) -> dict:
    kind = kind_of(path)
    with open_read(path) as f:
        h = read_header(f, kind)
        out = {"kind": kind, "dtype": h.fmt, **h.counts}
        if kind == "sf":
            out |= {k: float(read_array(f, h, k, (1,))[0]) for k in ("pixel_size", "delta_t")}
        return out


def extras(path: str) -> dict[str, np.ndarray]:
    """Power spectrum and variance, axes and edges."""
    kind = kind_of(path)
    with open_read(path) as f:
        h = read_header(f, kind)
        c = h.counts
        if kind == "sf":
            e = read_array(f, h, "extra", (c["Nextra"], c["Ny"], c["Nx"]))
            return {"power_spec": e[0], "var": e[1], "kx": read_array(f, h, "kx", (c["Nx"],)), "ky": read_array(f, h, "ky", (c["Ny"],)), "tau": read_array(f, h, "tau", (c["Nt"],))}
        out = {"k": read_array(f, h, "k", (c["Nk"],)), "tau": read_array(f, h, "tau", (c["Nt"],))}
        f.seek(0, os.SEEK_END)
        n = (f.tell() - 8 * len(ARRAYS[kind]) - h.offsets["bin_edges"]) // h.dtype.itemsize
        out["bin_edges"] = read_array(f, h, "bin_edges", (n,))
        if c["Nextra"]:
            d = read_array(f, h, "data", (c["Nk"], c["Nt"] + c["Nextra"]))[:, c["Nt"] :]
            out |= {"power_spec": d[:, 0], "var": d[:, 1]}
        return out


def _place(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def _heads(about: DataFrame, name_of: Callable[[str], str], kind: str, ends: Callable[[dict], tuple[bytes, bytes, int]]) -> DataFrame:
    """(seq_id, name, head, tail, total): one row a sequence, from the short lists of ``about``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            both = [ends(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("seq_id"), pa.array([file_name(name_of(r["seq_id"]), kind) for r in rows], pa.string()), pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.binary()), pa.array([x[2] for x in both], pa.int64())], ["seq_id", "name", "head", "tail", "total"])

    return about.mapInArrow(run, "seq_id string, name string, head binary, tail binary, total long")


def _save(values: DataFrame, heads: DataFrame, folder: str, dtype: np.dtype, keep: Callable[[DataFrame, str], DataFrame]) -> list[str]:
    """Writes (seq_id, pos, v) as one file a sequence: header, values by position (NaN where there is none), the rest. A file is written from its begin
    to its end by one task, a batch in memory at a time; it appears when the whole write is committed."""
    spark = values.sparkSession
    heads = heads.select("seq_id", "name", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.col("head").alias("content")), F.struct(F.col("total").alias("pos"), F.col("tail").alias("content")))).alias("x"))
    heads = keep(heads, "heads")
    rows = values.join(heads.select("seq_id", "name").distinct(), "seq_id").select("name", "pos", F.coalesce("v", F.lit(float("nan"))).alias("v"), F.lit(None).cast("binary").alias("content"))
    rows = rows.unionByName(heads.select("name", "x.pos", F.lit(None).cast("double").alias("v"), "x.content"))
    spark.dataSource.register(ContainerSource)
    rows.repartition("name").sortWithinPartitions("name", "pos").write.format("ddm").mode("overwrite").option("dtype", np.dtype(dtype).str).save(folder)
    return [f"{folder}/{r['name']}" for r in heads.select("name").distinct().orderBy("name").collect()]


def save_sf(sf: DataFrame, extra: DataFrame, grid: Grid, folder: str, name_of: Callable[[str], str] = str, dtype: np.dtype = np.float64) -> list[str]:
    """One .sf.ddm a sequence in ``folder``, which all tasks share; ``name_of(seq_id)`` names it. Files of the same name are replaced.

    A wavevector without a value is NaN; two values for one lag and wavevector raise ``ValueError``.
    """
    with step_tables(sf.sparkSession) as keep:
        return _save_sf(sf, extra, grid, folder, name_of, dtype, keep)


def _save_sf(sf: DataFrame, extra: DataFrame, grid: Grid, folder: str, name_of: Callable[[str], str], dtype: np.dtype, keep: Callable[[DataFrame, str], DataFrame]) -> list[str]:
    array_format(dtype)
    plane = grid.ny * grid.nxh
    lags = _place(sf.select("seq_id", "lag", "tau").distinct(), ["seq_id"], ["lag"], "place")
    lags = keep(lags, "lags")
    about = extra.select("seq_id").distinct().join(lags.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("place", "tau"))).alias("taus")), "seq_id", "left").withColumn("taus", F.coalesce("taus.tau", F.array().cast("array<double>")))
    at = lambda place: place * plane + F.col("iy") * grid.nxh + F.col("ix")
    ky, kx = grid.axes()

    def ends(r: dict) -> tuple[bytes, bytes, int]:
        n = len(r["taus"])
        after = {"kx": kx, "ky": ky, "tau": r["taus"], "pixel_size": [grid.pixel_size], "delta_t": [grid.delta_t]}
        return file_ends("sf", {"data": n * plane, "extra": 2 * plane}, after, {"Nt": n, "Ny": grid.ny, "Nx": grid.nxh, "Nextra": 2, "width": grid.nx, "height": grid.ny}, dtype)

    data = sf.join(lags.select("seq_id", "lag", "place"), ["seq_id", "lag"]).select("seq_id", at(F.col("place")).alias("pos"), F.col("d").alias("v"))
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(("power_spec", "var"))])).alias("x")
    last = extra.select("seq_id", "iy", "ix", both).join(about.select("seq_id", F.size("taus").alias("n")), "seq_id").select("seq_id", at(F.col("n") + F.col("x.k")).alias("pos"), "x.v")
    return _save(data.unionByName(last), _heads(about, name_of, "sf", ends), folder, dtype, keep)


def save_radial(curves: DataFrame, folder: str, edges: list[float], extra: DataFrame | None = None, kind: str = "aa", name_of: Callable[[str], str] = str, dtype: np.dtype = np.float64) -> list[str]:
    """One .aa.ddm or .isf.ddm a sequence, as ``save_sf``; ``extra`` gives the two last columns of an .aa.ddm.

    A ring's points lie by tau, repeated ones (of merged curves) all kept, those by value. The format has one list of tau: sequences
    whose rings differ in it raise ``ValueError``.
    """
    with step_tables(curves.sparkSession) as keep:
        return _save_radial(curves, folder, edges, extra, kind, name_of, dtype, keep)


def _save_radial(curves: DataFrame, folder: str, edges: list[float], extra: DataFrame | None, kind: str, name_of: Callable[[str], str], dtype: np.dtype, keep: Callable[[DataFrame, str], DataFrame]) -> list[str]:
    value, cols = ("d" if kind == "aa" else "f"), ["power_spec", "var"]
    array_format(dtype)
    more = 0 if extra is None else len(cols)
    rows = _place(curves.select("seq_id", "bin", "k", "tau", F.col(value).cast("double").alias("v"), F.col("err").cast("double").alias("err")), ["seq_id", "bin"], ["tau", "v", "err"], "place")
    rings = rows.groupBy("seq_id", "bin").agg(F.first("k").alias("k"), F.sort_array(F.collect_list("tau")).alias("taus"), F.count("err").alias("errs"))
    rings = keep(_place(rings, ["seq_id"], ["bin"], "ring"), "rings")
    about = rings.groupBy("seq_id").agg(F.collect_set("taus").alias("lists"), F.sort_array(F.collect_list(F.struct("ring", "k"))).alias("ks"), F.sum("errs").alias("errs"))
    # Checked before any file is begun.
    ragged = about.where(F.size("lists") > 1).select("seq_id").first()
    if ragged:
        raise ValueError(f"the rings of sequence {ragged['seq_id']} differ in their lists of tau")
    about = about.select("seq_id", F.col("lists")[0].alias("taus"), F.col("ks.k").alias("ks"), "errs")

    def ends(r: dict) -> tuple[bytes, bytes, int]:
        nt, nk = len(r["taus"]), len(r["ks"])
        values = nk * (nt + more)
        return file_ends(kind, {"data": values, "err": values if r["errs"] else 0}, {"k": r["ks"], "tau": r["taus"], "bin_edges": edges}, {"Nk": nk, "Nt": nt, "Nextra": more}, dtype)

    shape = about.select("seq_id", F.size("taus").alias("nt"), F.size("ks").alias("nk"), "errs")
    parts = rows.select("seq_id", "bin", "place", "v", "err")
    if extra is not None:
        one = lambda k, c: F.struct(F.lit(k).cast("long").alias("k"), F.col(c).cast("double").alias("v"), F.col(f"{c}_err").cast("double").alias("err"))
        last = extra.select("seq_id", "bin", F.explode(F.array(*[one(k, c) for k, c in enumerate(cols)])).alias("x")).join(shape.select("seq_id", "nt"), "seq_id")
        parts = parts.unionByName(last.select("seq_id", "bin", (F.col("nt") + F.col("x.k")).alias("place"), "x.v", "x.err"))
    parts = parts.join(rings.select("seq_id", "bin", "ring"), ["seq_id", "bin"]).join(shape, "seq_id")
    wide = F.col("nt") + more
    pos = F.col("ring") * wide + F.col("place")
    each = F.explode(F.filter(F.array(F.struct(pos.alias("pos"), F.col("v").alias("v")), F.when(F.col("errs") > 0, F.struct((pos + F.col("nk") * wide).alias("pos"), F.col("err").alias("v")))), lambda x: x.isNotNull())).alias("x")
    return _save(parts.select("seq_id", each).select("seq_id", "x.pos", "x.v"), _heads(about, name_of, kind, ends), folder, dtype, keep)


def grid_of(spark: SparkSession, path: str) -> DataFrame:
    """qgrid of a saved structure function."""
    m = metadata(path)
    return qgrid(spark, Grid(m["height"], m["width"], m["height"], m["width"], m["pixel_size"], m["delta_t"]))
