"""Helpers that the corpus operators share: paths, written tables, text rules, skew-safe look-ups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a bit table are 64 for each of at most 2 ** FILTER_BITS words: a broadcast of 16 MB at most, whatever the data.
FILTER_BITS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lists that take up every new ``Scratch``; see ``tables_of``.
_WATCHED: list[list[Scratch]] = []


@contextmanager
def tables_of() -> Iterator[list[Scratch]]:
    """What is written to the shared folder by way of ``Scratch`` meanwhile, for a caller that removes it once the result is kept elsewhere."""
    made: list[Scratch] = []
    _WATCHED.append(made)
    try:
        yield made
    finally:
        _WATCHED.remove(made)


class Scratch:
    """Tables written in the shared folder, which cut the lineage; ``clear`` removes those that no result reads any more, ``remove`` all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_dir(spark, name)
        self.names: list[str] = []
        for made in _WATCHED:
            made.append(self)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(name)
        path = f"{self.folder}/{len(self.names)}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *keep: str) -> None:
        for k, name in enumerate(self.names, 1):
            if name and name not in keep:
                self._delete(f"{self.folder}/{k}-{name}")
                self.names[k - 1] = ""

    def remove(self) -> None:
        self._delete(self.folder)
        self.names = [""] * len(self.names)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it again."""
    return Scratch(df.sparkSession, name).written(df, name)


def maybe_among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, str]:
    """``rows`` with a flag, and the flag's column: false means that the key is surely not among ``wanted``. No exchange of ``rows``.

    Keys are hashed to the bits of a table of at most 2 ** ``FILTER_BITS`` words, which is broadcast. The more keys are wanted the more rows are
    flagged for nothing (about wanted / 2 ** (FILTER_BITS + 6) of them); what is decided later does not depend on it.
    """
    flag = unused(rows.columns, "maybe")
    word, bits = unused(rows.columns, "word"), unused(rows.columns, "bits")
    at = lambda c: (F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), F.shiftrightunsigned(F.xxhash64(c), FILTER_BITS).bitwiseAND(F.lit(63)).cast("int"))
    one = lambda n: F.expr(f"shiftleft(CAST(1 AS BIGINT), {n})")
    table = wanted.select(at(wanted_key)[0].alias(word), at(wanted_key)[1].alias("_n")).groupBy(word).agg(F.bit_or(one("_n")).alias(bits))
    found = rows.withColumn(word, at(key)[0]).join(F.broadcast(table), word, "left")
    found = found.withColumn(flag, F.col(bits).isNotNull() & (F.getbit(F.coalesce(F.col(bits), F.lit(0).cast("long")), at(key)[1]) == 1))
    return found.drop(word, bits), flag


def keep_one(docs: DataFrame, key: Column, groups: DataFrame, total: int) -> DataFrame:
    """``docs`` without the rows that their group does not keep.

    ``groups`` (key, size, keep_id, keep_key) has a row for every key of a group of two or more rows, ``key`` being a string. Of a group stays the
    row with keep_key and keep_id (null-safe), one if there are several alike. Rows whose key has no group pass without an exchange.
    """
    k = unused(docs.columns, "group_key")
    rows, flag = maybe_among(docs.withColumn(k, key), F.col(k), groups, F.col("key"))
    names = {c: unused([*rows.columns], f"of_group_{c}") for c in ("size", "keep_id", "keep_key")}
    found = attach_by_key(rows.where(F.col(flag)), groups.withColumnsRenamed({"key": k, **names}), k, names["size"], total, ["doc_id", "text"])
    alone = F.col(names["size"]).isNull()
    first = found.where(~alone & (F.col(k) == F.col(names["keep_key"])) & F.col("doc_id").eqNullSafe(F.col(names["keep_id"]))).dropDuplicates([k])
    return rows.where(~F.col(flag)).select(docs.columns).unionByName(found.where(alone).select(docs.columns)).unionByName(first.select(docs.columns))


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``columns`` has it (letter case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for every row, and the key's column. Written, so that a row has the same key whenever it is read."""
    key = unused(docs.columns, "row_key")
    return written(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as the empty text. Where all characters are ASCII the quicker ``lower`` does the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def attach_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, row_id: list[str], parts: int = 500) -> DataFrame:
    """Left-joins one row per ``key`` of ``groups`` to ``rows`` when some keys hold a large part of the rows.

    A key with over 1/``parts`` of all ``total`` rows is hot: there are fewer than ``parts`` such keys whatever
    the data, so they are broadcast. The others meet in a shuffled join, in which the rows of hot keys
    are dealt out by ``row_id`` and match nothing.
    """
    extra = [c for c in groups.columns if c != key]
    hot_key, hot, meet, cold_key, cold = (unused(rows.columns, f"{n}_of_{key}") for n in ("hot_key", "hot", "meet", "cold_key", "cold"))
    is_hot = (F.col(size) > 1) & (F.col(size) * parts > total)
    few = groups.where(is_hot).select(F.col(key).alias(hot_key), F.struct(*extra).alias(hot))
    others = groups.where(~is_hot).select(F.col(key).cast("string").alias(cold_key), F.struct(*extra).alias(cold))
    out = rows.join(F.broadcast(few), F.col(key) == F.col(hot_key), "left")
    own = F.concat(F.lit("\x00"), F.xxhash64(*row_id).cast("string"))
    out = out.withColumn(meet, F.when(F.col(hot_key).isNull(), F.col(key).cast("string")).otherwise(own))
    out = out.join(others, F.col(meet) == F.col(cold_key), "left")
    return out.withColumns({c: F.coalesce(F.col(f"{hot}.{c}"), F.col(f"{cold}.{c}")) for c in extra}).drop(hot_key, hot, meet, cold_key, cold)
