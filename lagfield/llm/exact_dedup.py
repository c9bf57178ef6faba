"""Exact duplicates by a 128-bit content hash, with the bytes of every group compared.

Two texts are equal when identical after lower-casing A-Z. Defined results: a null text counts as the
empty one; rows that repeat an id stay rows of their own group and count in ``group_size``; an
empty table gives an empty result; a null id never stays while another id is there, and where all ids of a text are
null keep_id is null and no row is marked kept (the operator tells rows by id; the pipeline stage keeps one of them). Columns of the input other
than id and text are not read.

Plan: one pass computes (id, md5, sha256) and writes this narrow table. Partial aggregation by md5 gives
size and staying id, so that a group of any size reaches the shuffle as one row a task. A second pass compares bytes: a broadcast bit table of the
hashes of groups leaves out single texts before the exchange, and the others move as the grouping key of a partial aggregation (one row
for each distinct text and task). A hash that stands for two texts is resolved by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, attach_by_key, keep_one, maybe_among, read


def _hash(norm: Column) -> Column:
    return F.unhex(F.md5(F.encode(norm, "utf-8")))


def _compared(source: DataFrame, groups: DataFrame, best, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(texts, clash): the distinct texts (h, norm) of hashes of two or more rows with their sizes and ids, and the hashes that stand for several texts."""
    twice = groups.where("group_size > 1")
    hashed, flag = maybe_among(source.withColumn("h", _hash(F.col("norm"))), F.col("h"), twice, F.col("h"))
    texts = hashed.where(F.col(flag)).groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    clash = texts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return texts, scratch.written(clash.select(F.col("h").alias("ch")), "clash")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. ``keep``: min or max, the id that stays."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.min if keep == "min" else F.max
    scratch = Scratch(docs.sparkSession, "exact")
    source = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    marks = scratch.written(source.select("doc_id", _hash(F.col("norm")).alias("h"), F.unhex(F.sha2(F.encode("norm", "utf-8"), 256)).alias("sha")), "marks")
    total = marks.count()
    groups = scratch.written(marks.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id")), "groups")
    texts, clash = _compared(source, groups, best, scratch)
    cols = ["doc_id", "keep_id", "group_size", "sha"]
    by_hash = groups.withColumn("key", F.hex("h")).drop("h")
    if clash.isEmpty():
        out = attach_by_key(marks.withColumn("key", F.hex("h")), by_hash, "key", "group_size", total, ["doc_id", "h"])
    else:
        # Collisions: the rows of those hashes are grouped by their text.
        split = texts.join(clash, F.col("h") == F.col("ch"), "left_semi").select(F.col("h").alias("h2"), F.col("norm").alias("n2"), "group_size", "keep_id")
        good = attach_by_key(marks.join(clash, F.col("h") == F.col("ch"), "left_anti").withColumn("key", F.hex("h")), by_hash, "key", "group_size", total, ["doc_id", "h"])
        bad = source.withColumn("h", _hash(F.col("norm"))).join(clash, F.col("h") == F.col("ch"), "left_semi").join(split, (F.col("h") == F.col("h2")) & (F.col("norm") == F.col("n2")))
        out = good.select(cols).unionByName(bad.withColumn("sha", F.unhex(F.sha2(F.encode("norm", "utf-8"), 256))).select(cols))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest id stays: one row, were the id repeated; one without an id only if no other has one."""
    scratch = Scratch(spark, "exact-stage")
    norm = ascii_lower(F.col("text"))
    source = docs.select("doc_id", norm.alias("norm"))
    groups = source.groupBy(_hash(F.col("norm")).alias("h")).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
    groups = scratch.written(groups, "groups")
    texts, clash = _compared(source, groups, F.max, scratch)
    total, key = max(1, docs.count()), F.hex(_hash(norm))
    rows = groups.select(F.hex("h").alias("key"), F.col("group_size").alias("size"), "keep_id")
    if not clash.isEmpty():
        # Rows of a hash that stands for several texts are told apart by the text.
        rows = texts.where("group_size > 1").select(F.concat_ws(":", F.hex("h"), "norm").alias("key"), F.col("group_size").alias("size"), "keep_id")
        key = F.concat_ws(":", F.hex(_hash(norm)), norm)
    return keep_one(docs, key, rows.withColumn("keep_key", F.col("key")), total)


SQL = {
    "op2_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""
}
