"""Files in folders that driver and executors share (local, HDFS, S3, ...), filters that a source applies itself, and tables kept for reuse."""

from __future__ import annotations

import operator
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import Filter

#: Comparisons that the sources take over, by the name of Spark's filter.
TESTS = {"EqualTo": operator.eq, "In": lambda x, among: x in among, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le}


class Chosen:
    """The values of some columns that all pushed filters together let through."""

    def __init__(self) -> None:
        self.tests: list[tuple] = []

    def take(self, filters: list[Filter], *columns: str) -> Iterator[Filter]:
        """Keeps the filters on ``columns``, gives the others back to Spark."""
        for f in filters:
            if type(f).__name__ in TESTS and len(f.attribute) == 1 and f.attribute[0] in columns and f.value is not None:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def has(self, column: str, value) -> bool:
        return all(TESTS[name](value, bound) for c, name, bound in self.tests if c == column)

    def among(self, n: int, column: str) -> list[int]:
        return [i for i in range(n) if self.has(column, i)]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def open_read(path: str) -> BinaryIO:
    """A seekable file: only what is asked for is read."""
    system, at = file_system(path)
    return system.open_input_file(at)


def files_below(path: str, suffix: str) -> list[str]:
    """The files of a folder whose names end in ``suffix``, by name; folders that begin with _ are left out. A path that is a file is the only one."""
    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    inner = lambda p: p[len(at.rstrip("/")) + 1 :]
    names = sorted(inner(i.path) for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))
    return [f"{path.rstrip('/')}/{n}" for n in names if not any(x.startswith("_") for x in n.split("/"))]


def shared_dir(spark: SparkSession, name: str) -> str:
    """The name of a new folder below ``spark.checkpoint.dir``. Where that is unset a temporary folder takes its place, but only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lagfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lagfield-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def step_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``kept`` for tables that nobody reads afterwards: they are removed at the end."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(shared_dir(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            system, at = file_system(path)
            if system.get_file_info(at).type != fs.FileType.NotFound:
                system.delete_dir(at)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder: whatever is derived from it reads it there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
