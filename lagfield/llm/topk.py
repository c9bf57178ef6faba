"""Exact top-k inner products by columnar branch-and-bound.

Queries and candidates are cut into blocks; each pair of blocks is one group of a co-grouped map, so that a task holds one block of
each kind and nothing is broadcast. In a group the candidates lie dimension by dimension. Scores grow by ``STEP`` dimensions at a time, for each
query in the order of its own largest components; what a candidate can still gain or lose is bounded by the query's and the candidate's remaining
mass (Cauchy-Schwarz). Every query has survivors of its own: candidates that cannot reach its k-th score so far are compacted away before the
next dimensions. Each group returns k rows a query at most; a window over those picks the final k.

Defined results: components are floor(256 * x) as whole numbers; null vectors, and those with a null or
non-finite component, take no part; vectors of unlike length are never compared; ties go to the smaller
id; a query never meets a row of its own id; every row of ``queries`` is a query with ranks of its own, repeated ids too; rows that repeat an id are
candidates of their own; fewer than k candidates give fewer rows; an empty table gives none; columns beside id and vector are not read, whatever their names. Arithmetic is exact: in doubles for vectors whose
sums stay below 2^52, in Python's whole numbers for the others; scores beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

STEP, QUERY_BLOCK, ROW_BLOCK, CHUNK = 16, 4096, 16384, 256
OUT = "query_row long, query_id long, vec_id long, score long"
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.floor(256.0 * np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), len(vectors.iloc[0])))


def _survivors(q_id: int, q: np.ndarray, order: np.ndarray, c_ids: np.ndarray, columns: np.ndarray, squares: np.ndarray, total: np.ndarray, score: np.ndarray, mass: np.ndarray, k: int, work: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One query's candidates that no bound excludes, and their whole scores.

    ``score`` and ``mass`` have the products and the candidates' squares of the first ``STEP`` dimensions of ``order``. ``work`` counts products by step.
    """
    other = np.flatnonzero(c_ids != q_id)
    if len(other) <= k:
        return other, (q @ columns[:, other]) if len(other) else np.zeros(0)
    # Whole scores of the most promising candidates are a first threshold.
    most = other[np.argpartition(-score[other], min(4 * k, len(other) - 1))[: 4 * k]]
    floor = np.partition(q @ columns[:, most], -k)[-k]
    work[0] += len(c_ids) * min(STEP, len(q))
    alive, score, mass = other, score[other], mass[other]
    for n, at in enumerate(range(STEP, len(q), STEP), 1):
        gain = np.sqrt((q[order[at:]] ** 2).sum() * np.maximum(total[alive] - mass, 0)) * (1 + 1e-12)
        floor = max(floor, np.partition(score - gain, -k)[-k])
        live = score + gain >= floor
        alive, score, mass = alive[live], score[live], mass[live]
        part = order[at : at + STEP]
        work[n] += len(alive) * len(part)
        place = np.ix_(part, alive)
        score, mass = score + q[part] @ columns[place], mass + squares[place].sum(0)
    return alive, score


def block_topk(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, work: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (query, candidate) and scores of each query's k best in this block. ``work``, if given, gets the products made at each step."""
    if q.shape[1] == 0:
        q, c = np.zeros((len(q), 1)), np.zeros((len(c), 1))
    limit = np.sqrt(2.0**52 / q.shape[1])
    q_fits, c_fits = (np.abs(m).max(1) < limit for m in (q, c))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    few, many = np.flatnonzero(q_fits), np.flatnonzero(c_fits)
    if len(few) and len(many):
        qs, columns = q[few], np.ascontiguousarray(c[many].T)
        squares = columns * columns
        total = squares.sum(0)
        work = np.zeros(-(-q.shape[1] // STEP), np.int64) if work is None else work
        for at in range(0, len(few), CHUNK):
            some = qs[at : at + CHUNK]
            order = np.argsort(-np.abs(some), 1, kind="stable")
            early = np.zeros(some.shape)
            np.put_along_axis(early, order[:, :STEP], 1.0, 1)
            begun, masses = (some * early) @ columns, early @ squares
            for i in range(len(some)):
                alive, whole = _survivors(q_ids[few[at + i]], some[i], order[i], c_ids[many], columns, squares, total, begun[i], masses[i], k, work)
                found.append((np.full(len(alive), few[at + i]), many[alive], whole.astype(np.int64)))
    # Vectors of huge components, on either side.
    for rows, cols in ((np.flatnonzero(~q_fits), np.arange(len(c))), (few, np.flatnonzero(~c_fits))):
        if len(rows) and len(cols):
            a, b = (np.array([[int(x) for x in v] for v in m], dtype=object) for m in (q[rows], c[cols]))
            score = np.clip(a @ b.T, LOWEST, HIGHEST).astype(np.int64)
            i, j = np.nonzero(q_ids[rows][:, None] != c_ids[cols][None])
            found.append((rows[i], cols[j], score[i, j]))
    return _best(c_ids, *(np.concatenate(x) for x in zip(*found, strict=True)), k)


def _best(c_ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # ~score falls as the score rises, without overflow.
    order = np.lexsort((c_ids[cols], ~score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[place < k], cols[place < k], score[place < k]


def exact_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``rows`` with the largest inner products for each of ``queries``."""
    scratch = Scratch(rows.sparkSession, "topk")

    def usable(df: DataFrame, name: str) -> DataFrame:
        """Written with a number a row, so that blocks are even and stay the same whatever repeats."""
        whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dims"), whole.alias("_w")).where("id IS NOT NULL AND v IS NOT NULL AND _w")
        return scratch.written(df.drop("_w").withColumn("row", F.monotonically_increasing_id()), name)

    q, c = usable(queries, "queries"), usable(rows, "rows")
    spread = rows.sparkSession.sparkContext.defaultParallelism
    blocks = lambda n, most, least: max(1, -(-n // most), min(spread, n // least))
    nq, nc = blocks(q.count(), QUERY_BLOCK, QUERY_BLOCK), blocks(c.count(), ROW_BLOCK, 2048)
    place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", place(nq)).withColumn("cb", each(nc))
    c = c.withColumn("cb", place(nc)).withColumn("qb", each(nq))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("query_row", "query_id", "vec_id", "score")})
        qi, ci = left["id"].to_numpy(), right["id"].to_numpy()
        a, b, s = block_topk(qi, _matrix(left["v"]), ci, _matrix(right["v"]), k)
        return pd.DataFrame({"query_row": left["row"].to_numpy()[a], "query_id": qi[a], "vec_id": ci[b], "score": s})

    keys = ["dims", "qb", "cb"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(near, OUT)
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(rows.where("vec_id % 50 = 0"), rows, 5)


SQL = {
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(greatest(least(list_inner_product(q.v, c.v), 9.2e18), -9.2e18) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
