"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes one small table of signed sums per group, under a name of its own. It is committed by a
marker file with the batch's id, which names the table; totals are the sum over committed batches. ``compact`` folds batches into one table, together with the ids of
just these batches, under a name of its own, and publishes it by the next numbered marker.

Concurrent writers: a marker is created exclusively, so of two that apply one batch id, one commits and the other gets False; of two that compact at once one
publishes, and the other begins again from what is there then. One that dies leaves a table that no marker names: it counts for nothing, and ``clean`` removes it.
``clean`` and readers with an older view, or writers that are about to commit, exclude one another: call it when there are none. Ids stay a table, the driver lists only markers that are not cleaned yet.

Changes: kind (insert, delete, revise), source, lang, tokenizer, tokens (null: 0), old_tokens (what a revision replaces; null: 0).
Defined results: null sources, languages and versions are groups of their own; a group whose documents and tokens all went stays with zeros; repeated
changes in one batch count as often as they are there; other kinds raise; an empty batch commits and changes nothing; no batch gives no rows; other columns are not read, whatever their names; very long texts pass whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import word_cached
from .common import read, shared_dir, written
from .files import bounded_batches, create_new, open_fs

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def signed_sums(changes: DataFrame) -> DataFrame:
    """One row of signed sums per group, pre-aggregated before the shuffle."""
    kind, now, old = F.col("kind"), F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    documents = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(kind == "insert", now).when(kind == "delete", -now).when(kind == "revise", now - old)
    return changes.groupBy(*KEYS).agg(F.sum(documents).cast("long").alias("documents"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))


class TokenCounts:
    """Totals in ``folder``, a path that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _names(self, folder: str = "") -> list[str]:
        system, at = open_fs(f"{self.folder}/{folder}".rstrip("/"))
        if system.get_file_info(at).type != fs.FileType.Directory:
            return []
        return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)))

    def _text(self, name: str) -> str:
        system, at = open_fs(f"{self.folder}/{name}")
        with system.open_input_file(at) as f:
            return f.read().decode()

    def _last(self) -> tuple[int, str | None]:
        """The number of the latest fold, and its table; (-1, None) before the first one."""
        n = max((int(x.removeprefix("published-")) for x in self._names() if x.startswith("published-") and not x.endswith(".part")), default=-1)
        return n, self._text(f"published-{n}") if n >= 0 else None

    def _ids(self, fold: str | None) -> DataFrame:
        """The ids of the batches in a fold."""
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/tables/{fold}/batches") if fold else self.spark.createDataFrame([], "batch string")

    def _markers(self) -> DataFrame:
        return self.spark.createDataFrame([(x.removeprefix("batch-"),) for x in self._names() if x.startswith("batch-") and not x.endswith(".part")], "batch string")

    def committed(self) -> DataFrame:
        """The ids of all committed batches."""
        return self._ids(self._last()[1]).unionByName(self._markers()).distinct()

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it was committed before."""
        if not batch_id.replace("_", "").replace("-", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        if not self.committed().where(F.col("batch") == batch_id).isEmpty():
            return False
        table = f"batch-{uuid.uuid4().hex}"
        signed_sums(changes).write.parquet(f"{self.folder}/tables/{table}")
        # Meanwhile the batch may have come by another writer, and have been folded and cleaned.
        if self._ids(self._last()[1]).where(F.col("batch") == batch_id).isEmpty() and create_new(self.spark, f"{self.folder}/batch-{batch_id}", table):
            return True
        self._remove(f"tables/{table}")
        return False

    def _state(self) -> tuple[int, str | None, list[tuple[str, str]]]:
        """One view: the latest fold, and the batches beside it with their tables."""
        n, fold = self._last()
        beside = [r[0] for r in self._markers().join(self._ids(fold), "batch", "left_anti").collect()]
        return n, fold, [(b, self._text(f"batch-{b}")) for b in sorted(beside)]

    def _sum(self, fold: str | None, batches: list[tuple[str, str]]) -> DataFrame:
        parts = [f"{self.folder}/tables/{t}" for _, t in batches] + [f"{self.folder}/tables/{f}/totals" for f in [fold] if f]
        if not parts:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*parts).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        _, fold, batches = self._state()
        return self._sum(fold, batches)

    def _fold(self, fold: str | None, batches: list[tuple[str, str]]) -> str:
        """Writes totals and ids of one view as a new table."""
        table = f"fold-{uuid.uuid4().hex}"
        self._sum(fold, batches).write.parquet(f"{self.folder}/tables/{table}/totals")
        new = self.spark.createDataFrame([(b,) for b, _ in batches], "batch string")
        self._ids(fold).unionByName(new).write.parquet(f"{self.folder}/tables/{table}/batches")
        return table

    def compact(self) -> None:
        """Folds the batches of one view; if another fold is published first, those that it left."""
        while True:
            n, fold, batches = self._state()
            if not batches:
                return
            table = self._fold(fold, batches)
            if create_new(self.spark, f"{self.folder}/published-{n + 1}", table):
                return
            self._remove(f"tables/{table}")

    def _remove(self, name: str) -> None:
        system, at = open_fs(f"{self.folder}/{name}")
        kind = system.get_file_info(at).type
        if kind != fs.FileType.NotFound:
            (system.delete_dir if kind == fs.FileType.Directory else system.delete_file)(at)

    def clean(self) -> None:
        """Removes what the latest fold holds already, and tables that no marker names. For when there is no other reader or writer."""
        n, fold, batches = self._state()
        beside = {b for b, _ in batches}
        for name in self._names():
            if (name.startswith("batch-") and name.removeprefix("batch-") not in beside) or (name.startswith("published-") and name != f"published-{n}"):
                self._remove(name)
        for table in self._names("tables"):
            if table not in {fold, *(t for _, t in batches)}:
                self._remove(f"tables/{table}")


def bpe_count(spark: SparkSession, text: Column, tokenizer: str) -> Column:
    bounded_batches(spark)

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = word_cached(tokenizer)
        for texts in parts:
            yield pd.Series([len(x) // 4 for x in bpe.encode_batch(texts.tolist())], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in with a provisional count (a quarter of their bytes), are revised to the real one, and
    a seventh of them goes and comes back; the batch of revisions is sent twice. source, lang, tokenizer, documents, tokens."""
    import public_tokenizers

    name = "byte_bpe_50k"
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = docs.select("doc_id", "source", "lang", F.lit(name).alias("tokenizer"), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).alias("rough"), bpe_count(spark, F.col("text"), str(public_tokenizers.path(f"{name}.json"))).alias("exact"))
    rows = written(rows, "token-counts")
    counts = TokenCounts(spark, shared_dir(spark, "rollup"))
    change = lambda kind, now, old=None: rows.select(*KEYS, "doc_id", F.lit(kind).alias("kind"), F.col(now).alias("tokens"), (F.col(old) if old else F.lit(0)).alias("old_tokens"))
    seventh = F.coalesce(F.pmod("doc_id", F.lit(7)) == 3, F.lit(False))
    counts.apply("1-insert", change("insert", "rough"))
    counts.apply("2-revise", change("revise", "exact", "rough"))
    counts.apply("3-delete", change("delete", "exact").where(seventh))
    counts.apply("2-revise", change("revise", "exact", "rough"))
    counts.compact()
    counts.apply("4-return", change("insert", "exact").where(seventh))
    return counts.totals()


SQL: dict[str, str] = {}
