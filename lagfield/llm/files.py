"""Files that tasks write into and read from the shared folder, through Arrow's file systems (local, HDFS, S3, ...)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@contextmanager
def replacing(path: str) -> Iterator:
    """Writes beside ``path`` and moves the whole file there at the end, so that a task that is run again leaves one whole file."""
    system, at = open_fs(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        yield out
    try:
        system.move(part, at)
    except OSError:
        system.delete_file(at)
        system.move(part, at)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file, unless it is there already: of several writers one gets True. Exclusive creation is the file system's own."""
    system, at = open_fs(path)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(at.rpartition("/")[0], recursive=True)
        # The text is whole before the name is there.
        part = f"{at}.{uuid.uuid4().hex}.part"
        with open(part, "w") as out:
            out.write(text)
        try:
            os.link(part, at)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = store.create(target, False)
    except Py4JJavaError:
        if store.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches to Python hold so many rows and bytes at most, from here on in the session: long texts must not meet by the thousand in one worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def one_task_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of files, one task for each; the list has one row per written file."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)
