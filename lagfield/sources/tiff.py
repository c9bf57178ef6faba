"""Uncompressed TIFF: pages, tags and a writer, in the standard library; sequences as a batch data source of packed frames.

Grey pages of 8 to 64 bit, whole or floating; colour as interleaved or planar samples. Compressed files raise ``NotImplementedError``.
Files are read by seeking: the driver reads the page directory, a task the strips of its own pages. Pixels never pass the driver.
"""

from __future__ import annotations

import io
import os
import struct
import warnings
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from ..operators.raster import pack, rank_frames
from .shared import Chosen, open_read, step_tables
from .writing import CommittedFiles

#: Fixed values of the format: field types (code: struct letter), tag numbers.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
TAGS = {256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 339: "SampleFormat"}


def _opened(source: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(source) if isinstance(source, bytes) else source


def _order(f: BinaryIO) -> str:
    f.seek(0)
    raw = f.read(4)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 4 or struct.unpack(f"{order}H", raw[2:])[0] != 42:
        raise RuntimeError("not a TIFF file")
    return order


def _at(f: BinaryIO, order: str, where: int, form: str) -> tuple:
    f.seek(where)
    return struct.unpack(f"{order}{form}", f.read(struct.calcsize(f"{order}{form}")))


def pages(source: bytes | BinaryIO) -> list[dict]:
    """Tags of every page, by name (unknown ones by number), and ``order``, the byte order. Only the directory is read."""
    f = _opened(source)
    order = _order(f)
    (at,) = _at(f, order, 4, "I")
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = _at(f, order, at, "H")
        f.seek(at + 2)
        raw, tags = f.read(12 * n + 4), {"order": order}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", raw, 12 * i)
            letter = TYPES.get(kind)
            if letter is None:
                continue
            form = f"{count}s" if letter == "s" else letter * count
            size, inline = struct.calcsize(f"{order}{form}"), 12 * i + 8
            got = struct.unpack_from(f"{order}{form}", raw, inline) if size <= 4 else _at(f, order, struct.unpack_from(f"{order}I", raw, inline)[0], form)
            value = got[0].split(b"\0")[0].decode("utf-8", "replace") if letter == "s" else got[0] if len(got) == 1 else list(got)
            tags[TAGS.get(tag, str(tag))] = value
        out.append(tags)
        (at,) = struct.unpack_from(f"{order}I", raw, 12 * n)
    return out


def page_shape(tags: dict) -> tuple[int, ...]:
    """(y, x) of a grey page, (c, y, x) of a coloured one."""
    plane, n = (tags["ImageLength"], tags["ImageWidth"]), tags.get("SamplesPerPixel", 1)
    return plane if n == 1 else (n, *plane)


def page_array(source: bytes | BinaryIO, tags: dict) -> np.ndarray:
    """The pixels of a page, in its shape; only its strips are read."""
    f = _opened(source)
    if tags.get("Compression", 1) != 1:
        raise NotImplementedError("only uncompressed TIFF is read")
    if "StripOffsets" not in tags:
        raise NotImplementedError("only TIFF in strips is read, not in tiles")
    each = lambda v: v if isinstance(v, list) else [v]
    bits, form, shape = each(tags.get("BitsPerSample", 1))[0], each(tags.get("SampleFormat", 1))[0], page_shape(tags)
    if bits % 8:
        raise NotImplementedError(f"{bits} bits a sample")
    data = []
    for offset, count in zip(each(tags["StripOffsets"]), each(tags["StripByteCounts"]), strict=True):
        f.seek(offset)
        data.append(f.read(count))
    flat = np.frombuffer(b"".join(data), np.dtype(f"{tags['order']}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}"))
    if len(shape) == 2 or tags.get("PlanarConfiguration", 1) == 2:
        return flat.reshape(shape)
    return np.moveaxis(flat.reshape(*shape[1:], shape[0]), -1, 0)


def tiff_bytes(frames: list[np.ndarray], description: str = "") -> bytes:
    """Little-endian grey pages, one strip each."""
    out, link, at = bytearray(b"II*\0\0\0\0\0"), 4, 8
    for a in frames:
        form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        data, text = np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes(), description.encode() + b"\0"
        data += b"\0" * (len(data) % 2)
        text += b"\0" * (len(text) % 2)
        where = len(out)
        out += data + text
        at = len(out)
        entries = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, a.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, where), (277, 3, 1), (278, 4, a.shape[0]), (279, 4, a.nbytes), (339, 3, form)]
        if len(description.encode()) > 3:
            entries.append((270, 2, where + len(data)))
        entries.sort()
        out += struct.pack("<H", len(entries))
        for tag, kind, value in entries:
            out += struct.pack("<HHII", tag, kind, len(description.encode()) + 1 if kind == 2 else 1, value)
        struct.pack_into("<I", out, link, at)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


class _Pages(InputPartition):
    def __init__(self, pages: list[tuple[int, dict]]):
        self.pages = pages


class _TiffReader(DataSourceReader):
    def __init__(self, path: str, seq_id: str, parts: int):
        self.path, self.seq_id, self.parts, self.chosen = path, seq_id, parts, Chosen()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.chosen.take(filters, "t")

    def partitions(self) -> list[_Pages]:
        with open_read(self.path) as f:
            tags = pages(f)
        wanted = [(t, tags[t]) for t in self.chosen.among(len(tags), "t")]
        size = max(1, -(-len(wanted) // self.parts))
        return [_Pages(wanted[i : i + size]) for i in range(0, len(wanted), size)]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        with open_read(self.path) as f:
            for t, tags in partition.pages:
                a = page_array(f, tags)
                for c, plane in enumerate(a) if a.ndim == 3 else [(None, a)]:
                    numbers = [pa.array([x], pa.int32()) for x in (t, c, *plane.shape)]
                    pixels = pa.ListArray.from_arrays(pa.array([0, plane.size], pa.int32()), pa.array(plane.astype(np.float64).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([self.seq_id], pa.string()), *numbers, pixels], ["seq_id", "t", "c", "height", "width", "pixels"])


class TiffSource(DataSource):
    """``spark.read.format("tiff_pages").load(path)``: frames_packed with ``c`` (null for grey pages); filters on t choose pages."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return "seq_id string, t int, c int, height int, width int, pixels array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options["path"], self.options.get("seq_id", "s0"), int(self.options.get("parts", 8)))

    def writer(self, schema, overwrite: bool) -> CommittedFiles:
        return CommittedFiles(self.options["path"], overwrite)


def read_pages(spark: SparkSession, path: str, frames: list[int] | None = None, seq_id: str = "s0") -> DataFrame:
    """The pages of a file as frames. Turns filter pushdown of Python sources on for the session."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("tiff_pages").option("path", path).option("seq_id", seq_id).load()
    return df if frames is None else df.where(F.col("t").isin(*frames))


def _bare(path: Column) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def image_files(spark: SparkSession, paths: list[str], channels: list[int] | None = None, seq_id: str = "s0") -> DataFrame:
    """One image a file, in the list's order: frames_packed, and ``c`` for coloured images (``channels`` picks by number).

    Files are told apart by their whole path. All must have the first one's shape: another one raises ``RuntimeError`` in its task.
    """
    named = [p if ":" in p.split("/")[0] else os.path.abspath(p) for p in paths]
    order = spark.createDataFrame(list(enumerate(named)), "t int, _name string").select("t", _bare(F.col("_name")).alias("_path"))
    raw = lambda some: spark.read.format("binaryFile").load(some)
    schema = pa.schema([("seq_id", pa.string()), ("t", pa.int32()), ("c", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.list_(pa.float64()))])

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"shape": [list(page_shape(pages(x)[0])) for x in b.column("content").to_pylist()]}, pa.schema([("shape", pa.list_(pa.int32()))]))

    first = tuple(raw(named[:1]).select("content").mapInArrow(shapes, "shape array<int>").first()["shape"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, content in zip(b.column("t").to_pylist(), b.column("content").to_pylist(), strict=True):
                a = page_array(content, pages(content)[0])
                if a.shape != first:
                    raise RuntimeError(f"image {t} has the shape {a.shape}, the first one {first}")
                planes = [(None, a)] if a.ndim == 2 else [(c, a[c]) for c in (range(a.shape[0]) if channels is None else channels)]
                yield pa.RecordBatch.from_pylist([{"seq_id": seq_id, "t": t, "c": c, "height": p.shape[0], "width": p.shape[1], "pixels": p.astype(float).ravel().tolist()} for c, p in planes], schema)

    files = raw(sorted(set(named))).select(_bare(F.col("path")).alias("_path"), "content").join(order, "_path")
    return files.select("t", "content").mapInArrow(run, "seq_id string, t int, c int, height int, width int, pixels array<double>")


def image_folder(spark: SparkSession, pattern: str, seq_id: str = "s0") -> DataFrame:
    """(seq_id, t, path) of the files that match, t being the rank of the path."""
    return rank_frames(spark.read.format("binaryFile").load(pattern).select(F.lit(seq_id).alias("seq_id"), "path"))


def _ordered(spark: SparkSession, path: str, input_order: str, seq_id: str) -> DataFrame:
    """Frames of a file whose axes are named by ``input_order`` (of C, T, Y, X; axes of length 1 left out)."""
    with open_read(path) as f:
        tags = pages(f)
    sizes = [("page", len(tags)), *zip(("c", "y", "x")[-len(page_shape(tags[0])) :], page_shape(tags[0]), strict=True)]
    names, axes = input_order.upper(), [a for a, n in sizes if n > 1]
    if len(names) < len(axes) or len(names) > len(sizes):
        axes = []
    elif len(names) > len(axes):
        axes = [a for a, _ in sizes][-len(names) :]
    if not axes or len(set(names)) != len(names) or not set(names) <= set("CTYX") or not {"Y", "X"} <= set(names):
        raise RuntimeError("input_order names each axis once, of C, T, Y, X")
    to, length = dict(zip(names, axes, strict=True)), dict(sizes)
    read = read_pages(spark, path, seq_id=seq_id).withColumnRenamed("t", "page")
    number = lambda axis: F.col(to[axis]).cast("int") if axis in to else F.lit(None if axis == "C" else 0).cast("int")
    if (to["Y"], to["X"]) == ("y", "x"):
        return read.select("seq_id", number("T").alias("t"), number("C").alias("c"), "height", "width", "pixels")
    # A frame's pixels lie in several pages: they meet by frame.
    cells = read.select("seq_id", "page", "c", "width", F.posexplode("pixels").alias("_p", "v"))
    cells = cells.withColumns({"y": F.floor(F.col("_p") / F.col("width")).cast("int"), "x": (F.col("_p") % F.col("width")).cast("int")})
    cells = cells.select("seq_id", number("T").alias("t"), number("C").alias("c"), number("Y").alias("y"), number("X").alias("x"), "v")
    return pack(cells, length[to["Y"]], length[to["X"]], ["c"]).select("seq_id", "t", "c", "height", "width", "pixels")


def read_images(spark: SparkSession, src: str | list[str], seq: list[int] | None = None, color_seq: list[int] | None = None, input_order: str | None = None, seq_id: str = "s0") -> DataFrame:
    """A list of files is one image each; ``.tif`` is a file of pages; ``.nd2`` is a closed format and not supported; all else raises ``RuntimeError``."""
    if isinstance(src, list):
        return image_files(spark, src, color_seq, seq_id)
    if not isinstance(src, str):
        raise RuntimeError("src is a path or a list of paths")
    if src.endswith(".nd2"):
        raise NotImplementedError("nd2 is a closed format; export it to TIFF")
    if not src.endswith(".tif"):
        warnings.warn("the suffix is not .tif; read as TIFF all the same", stacklevel=2)
    out = read_pages(spark, src, seq_id=seq_id) if input_order is None else _ordered(spark, src, input_order, seq_id)
    out = out if seq is None else out.where(F.col("t").isin(*seq))
    return out if color_seq is None else out.where(F.col("c").isin(*color_seq))


def read_metadata(spark: SparkSession, src: str | list[str]) -> DataFrame:
    """(path, tags) of the first page of a file, or of each of a list, which tasks read. A folder is not implemented, a missing file is not found, another suffix raises ``RuntimeError``."""
    for path in [src] if isinstance(src, str) else src:
        if isinstance(src, str) and os.path.isdir(path):
            raise NotImplementedError("metadata of a folder")
        if isinstance(src, str) and ":" not in path.split("/")[0] and not os.path.exists(path):
            raise FileNotFoundError(path)
        if path.endswith(".nd2"):
            raise NotImplementedError("nd2 is a closed format")
        if not path.endswith(".tif"):
            raise RuntimeError("metadata are read from .tif files")
    schema = pa.schema([("path", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                with open_read(path) as f:
                    rows.append({"path": path, "tags": [(k, str(v)) for k, v in pages(f)[0].items() if k != "order"]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    paths = [(p,) for p in ([src] if isinstance(src, str) else src)]
    return spark.createDataFrame(paths, "path string").mapInArrow(run, "path string, tags map<string,string>")


def _save(images: DataFrame, folder: str, names: DataFrame) -> list[str]:
    """Writes (keys of ``names``, content) as the files that ``names`` gives; they appear once all are written."""
    spark, keys = images.sparkSession, [c for c in names.columns if c != "name"]
    spark.dataSource.register(TiffSource)
    rows = images.join(names, keys).select("name", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("double").alias("v"), "content")
    rows.write.format("tiff_pages").mode("overwrite").save(folder)
    return [f"{folder.rstrip('/')}/{r['name']}" for r in names.select("name").orderBy("name").collect()]


def _images(frames: DataFrame, dtype) -> DataFrame:
    """(seq_id, t, content): each frame as a grey TIFF of one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shape = b.column("height")[i].as_py(), b.column("width")[i].as_py()
                page = np.asarray(b.column("pixels")[i].values, np.float64).astype(dtype).reshape(shape)
                yield pa.RecordBatch.from_arrays([b.column("seq_id").slice(i, 1), b.column("t").slice(i, 1), pa.array([tiff_bytes([page])], pa.binary())], ["seq_id", "t", "content"])

    return frames.select("seq_id", F.col("t").cast("int").alias("t"), "height", "width", "pixels").mapInArrow(run, "seq_id string, t int, content binary")


def save_frames(frames: DataFrame, folder: str, name_of: Callable[[str, int], str] = "{}-{:06d}.tif".format, dtype=np.float64) -> list[str]:
    """frames_packed to one grey single-page TIFF a frame in ``folder``, which all tasks share; ``name_of(seq_id, t)`` names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name_of(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.string())], ["seq_id", "t", "name"])

    names = frames.select("seq_id", F.col("t").cast("int").alias("t")).distinct().mapInArrow(run, "seq_id string, t int, name string")
    with step_tables(frames.sparkSession) as keep:
        return _save(_images(frames, dtype), folder, keep(names, "names"))


def save_stack(frames: DataFrame, folder: str, name: str, dtype=np.float64) -> str:
    """frames_packed of one sequence as the pages of one TIFF, in order of t: one task strings the pages together, a page in memory at a time.

    The page directory is worked out beforehand, since frames are of one size (another one raises ``ValueError``): each page is a row of the sink, at its place in the file.
    """
    shape = frames.agg(F.count(F.lit(1)), F.min("height"), F.max("height"), F.min("width"), F.max("width"), F.count_distinct("seq_id"), F.count_distinct("t")).first()
    n, height, _, width, _, sequences, times = shape
    if not n or shape[1] != shape[2] or shape[3] != shape[4] or sequences != 1 or times != n:
        raise ValueError("a stack holds one sequence, each frame once, all of one size")
    one = tiff_bytes([np.zeros((height, width), dtype)])
    size = len(one) - 8
    if 8 + size * n >= 1 << 32:
        raise NotImplementedError("a TIFF file holds 4 GB at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k = b.column("k")[i].as_py()
                page = np.asarray(b.column("pixels")[i].values, np.float64).astype(dtype).reshape(height, width)
                content = moved(tiff_bytes([page])[8:], 8 + size * k, k == n - 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([content], pa.binary())], ["k", "content"])

    def moved(page: bytes, to: int, last: bool) -> bytes:
        """A page of a file of its own, at another place: offsets go with it, and its end names the next page."""
        raw = bytearray(page)
        at = struct.unpack_from("<I", one, 4)[0] - 8
        (entries,) = struct.unpack_from("<H", raw, at)
        for e in range(at + 2, at + 2 + 12 * entries, 12):
            tag, kind, count, value = struct.unpack_from("<HHII", raw, e)
            if tag == 273 or count * struct.calcsize(TYPES[kind]) > 4:
                struct.pack_into("<I", raw, e + 8, value - 8 + to)
        struct.pack_into("<I", raw, at + 2 + 12 * entries, 0 if last else to + size + at)
        return bytes(raw)

    spark = frames.sparkSession
    spark.dataSource.register(TiffSource)
    order = frames.select("t").withColumn("k", F.row_number().over(Window.orderBy("t")) - 1)
    rows = frames.join(order, "t").select(F.col("k").cast("long").alias("k"), "pixels").mapInArrow(run, "k long, content binary")
    head = spark.createDataFrame([(-1, one[:4] + struct.pack("<I", struct.unpack_from("<I", one, 4)[0]))], "k long, content binary")
    wire = rows.unionByName(head).select(F.lit(name).alias("name"), (F.col("k") - n - 1).alias("pos"), F.lit(None).cast("double").alias("v"), "content")
    wire.repartition(1).sortWithinPartitions("pos").write.format("tiff_pages").mode("overwrite").save(folder)
    return f"{folder.rstrip('/')}/{name}"


def save_slices(sf: DataFrame, height: int, width: int, folder: str, names: dict[int, str]) -> list[str]:
    """Lag slices as float32 TIFF in ``folder``, the whole plane each; ``names`` gives a file for every lag. Several sequences raise ``ValueError``: their planes would meet in one file."""
    have = {r["lag"] for r in sf.select("lag").distinct().collect()}
    if have != set(names):
        raise RuntimeError("there must be one file name for each lag")
    if sf.select("seq_id").distinct().limit(2).count() > 1:
        raise ValueError("one sequence at a time")
    planes = pack(sf.select("seq_id", F.col("lag").alias("t"), F.col("iy").alias("y"), F.col("ix").alias("x"), F.col("d").alias("v")), height, width)
    return _save(_images(planes, np.float32).drop("seq_id"), folder, sf.sparkSession.createDataFrame(list(names.items()), "t int, name string"))
