"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source's documents are shuffled by a hash of their id and queued up to ``max_epochs`` times. A copy's virtual
finish time is the cumulated size of its source up to it, divided by the source's target; all copies are taken in this
order until the total budget is used up. Targets share the budget by weight, a source takes at most
``max_epochs`` times its size, and what it leaves is shared again by weight (the water level is found in closed form).

Running sums have two levels, so that no task holds a source or the whole order: rows fall into slots by range of the
order, slot totals are summed up (``SLOTS`` rows a source, or in all), and a window adds within one slot. The targets come from one row a source in
one window: sources may be many thousands (crawls, sites), not a row's own.

Defined results: null text has size 0; a null source is a source, last in the order; documents of size 0 are never
taken and move nothing; rows that repeat an id are rows of their own; ties in the hash go by id and size;
an empty table, or one without a word, gives targets and taken of 0. Further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, keyed, read, word_count

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, 17
#: Three hex digits of the shuffle's hash.
SLOTS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """``sizes``: source, size. One row per source: source, source_size, target."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    w = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumns({"cap": F.col("source_size") * float(max_epochs), "budget": F.sum("source_size").over(everything) * float(share), "all_weight": F.sum("weight").over(everything)})
    rising = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # The water level, were this source the first that is not filled up; the first whose own limit lies above it is.
    w = w.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    w = w.withColumn("water", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.row_number().over(rising).alias("i"), F.col("level")))).over(everything)["level"])
    return w.select("source", "source_size", F.when(F.col("water").isNull() | (F.col("water") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), copies; and row, the key in ``row_col``."""
    own = ["row"] if row_col else []
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = rows.withColumn("at", F.substring(F.md5(F.concat_ws("-", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary")), 1, 16))
    rows = scratch.written(rows.withColumn("slot", F.conv(F.substring("at", 1, 3), 16, 10).cast("int")), "sizes")
    targets = scratch.written(source_targets(rows, weights, max_epochs, share), "targets")
    by_slot = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("in_slot")).select("source", "slot", F.coalesce(F.sum("in_slot").over(by_slot), F.lit(0)).alias("base"))
    slots = slots.withColumnsRenamed({"source": "_s", "slot": "_t"})
    in_slot = Window.partitionBy("source", "slot").orderBy("at", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("within", F.sum("size").over(in_slot)).join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_t")))
    queued = queued.withColumn("upto", F.col("base") + F.col("within")).drop("_s", "_t", "base", "within", "at", "slot")
    t = targets.withColumnsRenamed({"source": "_s"})
    queued = scratch.written(queued.join(F.broadcast(t) if t.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "queue")
    scratch.clear("queue")
    # Virtual finish times of all copies; beyond 1 + the largest step no copy can be within the budget.
    copies = queued.where("size > 0 AND target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    limits = queued.agg(F.sum("size").alias("s")).first()
    budget = float(limits["s"] or 0) * float(share)
    # Times run from 0 to max_epochs * source_size / target; the slots of the order are cut by quantiles of x / (1 + x).
    copies = copies.withColumn("slot", F.floor(F.col("finish") / (1 + F.col("finish")) * SLOTS))
    totals = copies.groupBy("slot").agg(F.sum("size").alias("in_slot"))
    totals = totals.withColumn("base", F.coalesce(F.sum("in_slot").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = totals.where((F.col("base") <= budget) & (F.col("base") + F.col("in_slot") > budget)).select("slot", "base").first()
    if cut is None:
        taken = copies
    else:
        in_order = Window.partitionBy("slot", "fine").orderBy("finish", "source", "doc_id", "size", "epoch").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.where(F.col("slot") == cut["slot"])
        edge = edge.withColumn("fine", F.floor((F.col("finish") / (1 + F.col("finish")) * SLOTS - F.col("slot")) * SLOTS))
        fine = edge.groupBy("slot", "fine").agg(F.sum("size").alias("in_fine"))
        fine = fine.select(F.col("fine").alias("_f"), F.coalesce(F.sum("in_fine").over(Window.orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("fine_base"))
        edge = edge.withColumn("within", F.sum("size").over(in_order)).join(F.broadcast(fine), F.col("fine") == F.col("_f"))
        edge = edge.where(F.lit(cut["base"]) + F.col("fine_base") + F.col("within") <= budget)
        taken = copies.where(F.col("slot") < cut["slot"]).select("source", "doc_id", "size", "upto").unionByName(edge.select("source", "doc_id", "size", "upto"))
    # A copy is known by its place in its source's queue: (source, upto) is unique among rows with words.
    counts = taken.groupBy("source", "doc_id", "size", "upto").agg(F.count(F.lit(1)).alias("copies"))
    counts = counts.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_z"), F.col("upto").alias("_u"), "copies")
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z")) & (F.col("upto") == F.col("_u"))
    out = queued.join(counts, same, "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *own)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it."""
    rows, key = keyed(docs, "mix-rows")
    took = mix(rows, row_col=key).where("copies > 0").select(F.col("row").alias(key), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.join(took.select(key), key).select(docs.columns)


SQL = {
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
l AS (SELECT *, (budget - cap_before) / (all_weight - weight_before) AS level FROM r),
f AS (SELECT *, (SELECT arg_min(level, i) FROM l WHERE level <= cap / weight) AS water FROM l),
t AS (SELECT source, source_size, budget, CASE WHEN water IS NULL OR water * weight >= cap THEN cap ELSE water * weight END AS target FROM f),
q AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, t.budget, row_number() OVER () AS row, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5('17-' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '-' || d.size), 1, 16), d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(epoch * source_size + upto AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, doc_id NULLS FIRST, size, epoch ROWS UNBOUNDED PRECEDING) AS so_far FROM c),
k AS (SELECT row, count(*) AS copies FROM o WHERE so_far <= budget GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (row)"""
}
