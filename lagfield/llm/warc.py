"""WARC archives: a writer with payload de-duplication and a sequential, incremental reader.

Each record is a gzip member of its own. The reader inflates in pieces of ``PIECE`` bytes, frames by
Content-Length, and checks the payload digest of every response; it never holds more than a piece and one header, which holds the URL whole.

Defined results: null html is an empty payload; payloads of under ``MIN_REVISIT`` bytes are always responses; of equal
longer payloads those rows with the smallest id are the response (all of them, were that id repeated); null ids come back null and are a
response only if all ids of that payload are null; a null or odd URL is left out or percent-encoded, a long one passes whole; columns beside id, URL and html are not read, whatever their names; an empty table makes no
archive and no row. A broken member, length or digest raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, read, shared_dir, written
from .files import bounded_batches, one_task_each, open_fs, replacing

MIN_REVISIT, PIECE = 100, 1 << 18
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member: WARC header, HTTP header, and the payload unless the record is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + END + block + END) + pack.flush()


class _Inflated:
    """Bytes of the present gzip member, inflated as they are asked for."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.raw, self.data, self.unpack, self.ended = stream, b"", b"", None, True

    def next_member(self) -> bool:
        while not self.ended or self.data:
            if self.data:
                raise ValueError("bytes after the end of a record")
            self.more()
        self.raw = self.raw or self.stream.read(PIECE)
        if not self.raw:
            return False
        self.unpack, self.ended = zlib.decompressobj(31), False
        return True

    def more(self) -> bool:
        """Inflates a piece; False at the end of the member."""
        while not self.ended:
            held = self.unpack.unconsumed_tail or self.raw or self.stream.read(PIECE)
            if not held:
                raise ValueError("the archive ends within a record")
            self.raw = b""
            try:
                got = self.unpack.decompress(held, PIECE)
            except zlib.error as e:
                raise ValueError(f"broken gzip member: {e}") from e
            if self.unpack.eof:
                self.ended, self.raw = True, self.unpack.unused_data
            if got:
                self.data += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes up to ``mark``, which goes. Only what is new is searched, and pieces are joined once: linear in a header of any length."""
        held, tail = [], b""
        while (at := (tail + self.data).find(mark)) < 0:
            held.append(self.data)
            tail = (tail + self.data)[-len(mark) + 1 :]
            self.data = b""
            if not self.more():
                raise ValueError("a header has no end")
        whole = b"".join([*held, self.data])
        end = len(whole) - len(self.data) - len(tail) + at
        self.data = whole[end + len(mark) :]
        return whole[:end]

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            yield piece


def _fields(header: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in header.decode("utf-8").split("\r\n")[1:])}


def read_warc(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive in order, digests verified."""
    source = _Inflated(stream)
    while source.next_member():
        head = source.until(END)
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        warc = _fields(head)
        length = int(warc["content-length"])
        http_head = source.until(END)
        http, rest = _fields(http_head), length - len(http_head) - len(END)
        if rest < 0:
            raise ValueError("the HTTP header is longer than the record")
        digest, n = hashlib.sha256(), 0
        for piece in source.pieces(rest):
            digest.update(piece)
            n += len(piece)
        if b"".join(source.pieces(len(END))) != END:
            raise ValueError("a record does not end where its Content-Length says")
        said, kind = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"]
        if kind == "response" and (digest.hexdigest() != said or n != int(http["content-length"])):
            raise ValueError(f"payload digest or length of {warc['warc-record-id']} does not agree")
        number = lambda x: int(y) if (y := x.removeprefix("<urn:page:").removesuffix(">")) else None
        yield {"page_id": number(warc["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": said, "record_type": kind, "refers_to": number(warc["warc-refers-to"]) if "warc-refers-to" in warc else None}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        for page_id, url, html, digest, kind, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "kind", "ref")), strict=True):
            yield record_bytes(page_id, url, html or b"", digest, kind, ref)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[tuple[str, int]]:
    """Writes the archives below ``folder``, one a task; returns (path, records) of each."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "utf-8").alias("html"))
    marks = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.length("html").alias("n"))
    groups = marks.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("page_id").alias("first"), F.max("n").alias("n")).where(f"rows > 1 AND n >= {MIN_REVISIT}")
    groups = written(groups.select("digest", "rows", "first"), "warc-groups")
    rows = attach_by_key(rows.withColumn("digest", F.sha2("html", 256)), groups, "digest", "rows", max(1, marks.count()), ["page_id", "url"])
    is_first = F.col("rows").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull())
    rows = rows.select("page_id", "url", "html", "digest", F.when(is_first, "response").otherwise("revisit").alias("kind"), F.when(~is_first, F.col("first")).alias("ref"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        records = _records(batches)
        if (head := next(records, None)) is None:
            return
        with replacing(path) as out:
            out.write(head)
            n = 1
            for r in records:
                out.write(r)
                n += 1
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return [tuple(r) for r in rows.mapInArrow(write, "path string, records long").collect()]


def read_archives(spark: SparkSession, archives: list[tuple[str, int]]) -> DataFrame:
    """The records of all archives, one task an archive."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in names])
        for b in batches:
            for path in b.column("path").to_pylist():
                system, at = open_fs(path)
                with system.open_input_stream(at, compression=None) as stream:
                    held = []
                    for r in read_warc(stream):
                        held.append(r)
                        if len(held) == 5000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema)

    return one_task_each(spark, archives, "path string, records long").mapInArrow(load, RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(read(spark, sf_dir, "pages"), shared_dir(spark, "warc")))


SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM g"""
}
