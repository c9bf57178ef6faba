"""Quality classifier from compression: dictionaries of good and of bad text, their size difference, a calibrated score.

A bounded sample of labelled texts trains two Zstandard dictionaries, one on good and one on bad text. A text is
compressed with either, in pieces of ``PIECE`` bytes so that the dictionary and not the text's own past tells; d = (bad - good) / (bad + good)
over all pieces. Repeated text has no d to speak of, since either dictionary makes it vanish; the compressed share of the text
shows it. A logistic curve on d, that share and the length, cross-fitted on the sample, turns them into a score.

Defined results: a null text counts as empty; empty texts get the curve's value for no evidence; repeated rows each get a row; a null id
belongs to no held-out part (its remainder is null: false); labels other than 0 and 1, or null, are not learnt from; a label for a missing
id or an id with several labels adds what the join gives; an empty table gives an empty result; with fewer than
``LEAST_ROWS`` labelled texts of a class there is nothing to learn from: every text scores the share of good labels (0.5 without any),
and the pipeline stage rejects nothing. Texts of any length are scored whole; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, unused
from .files import bounded_batches

#: Bounds of the fit: rows of each class, bytes of a text that may take part in it. Scoring has none.
SAMPLE_ROWS, SAMPLE_BYTES, LEAST_ROWS = 2000, 32_768, 4
DICT_BYTES, PIECE, LEVEL, THRESHOLD = 112_640, 2048, 3, 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]
    constant: float | None = None


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.packs = []
        if model.constant is not None:
            return
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.packs.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.empty = [len(p.compress(b"")) for p in self.packs]

    def sizes(self, text: bytes) -> tuple[int, int]:
        """Compressed bytes with the good and the bad dictionary, frames not counted."""
        pieces = [text[k : k + PIECE] for k in range(0, len(text), PIECE)]
        return tuple(sum(len(p.compress(x)) for x in pieces) - e * len(pieces) for p, e in zip(self.packs, self.empty, strict=True))

    def features(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([self.sizes(t) for t in texts], float).reshape(-1, 2)
        n = np.array([len(t) for t in texts], float)
        return _features(sizes[:, 0], sizes[:, 1], n)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return _curve(self.features(texts), self.model)


def _features(good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    both = np.maximum(good + bad, 1)
    d = np.where(n > 0, (bad - good) / both, 0.0)
    share = np.where(n > 0, both / np.maximum(2 * n, 1), 0.35)
    length = np.log1p(n)
    return np.stack([np.clip(d, -0.2, 0.2), np.minimum(share, 0.35), np.minimum(share, 0.2), length, np.clip(d, -0.2, 0.2) * length], 1)


def _curve(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.clip(np.column_stack([np.ones(len(x)), (x - m.mean) / m.scale]) @ np.array(m.weights), -30, 30)
    return 1 / (1 + np.exp(-z))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[bytes], labels: list[int], weights: list[float]) -> Model:
    """Cross-fitted: dictionaries of either half of the rows give the features of the other half, on which the curve is fitted;
    the dictionaries that score are then trained on all rows. ``weights`` undo the sample's class balance."""
    halves: dict[tuple[int, int], list[int]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for q in (0, 1):
        for k, i in enumerate(i for i, y in enumerate(labels) if y == q):
            halves[q, k % 2].append(i)
    if any(len(halves[q, 0]) + len(halves[q, 1]) < LEAST_ROWS for q in (0, 1)):
        total = sum(weights)
        return Model(b"", b"", [], [], [], sum(w * y for w, y in zip(weights, labels, strict=True)) / total if total else 0.5)

    def dictionary(rows: list[int]) -> bytes:
        samples = [p for i in rows for k in range(0, len(texts[i]), PIECE) if len(p := texts[i][k : k + PIECE]) >= 8]
        while 0 < sum(map(len, samples)) < 20 * 1024 or 0 < len(samples) < 16:
            samples = samples * 2
        size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 4))
        return zstandard.train_dictionary(size, samples).as_bytes()

    parts, order = [], []
    for h in (0, 1):
        part = Scorer(Model(dictionary(halves[1, h]), dictionary(halves[0, h]), [], [], []))
        rows = halves[0, 1 - h] + halves[1, 1 - h]
        parts.append(part.features([texts[i] for i in rows]))
        order += rows
    x, y, w = np.concatenate(parts), np.array([labels[i] for i in order], float), np.array([weights[i] for i in order])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    coef = _logistic((x - mean) / scale, y)
    # The intercept takes the classes' real shares, which the sample has evened out.
    coef[0] += np.log(w[y == 1].mean() / w[y == 0].mean())
    return Model(dictionary(halves[1, 0] + halves[1, 1]), dictionary(halves[0, 0] + halves[0, 1]), mean.tolist(), scale.tolist(), coef.tolist())


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most ``SAMPLE_ROWS`` labelled rows of each class, those with the lowest hash of their id among texts of ``SAMPLE_BYTES`` at most."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    short = docs.where(size <= SAMPLE_BYTES)
    rows = labels.where(learn_from & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    rows = rows.join(short.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    shares = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    order = F.xxhash64(F.lit(11), "_id")
    some = rows.where("_y = 1").orderBy(order, "_id").limit(SAMPLE_ROWS).unionByName(rows.where("_y = 0").orderBy(order, "_id").limit(SAMPLE_ROWS))
    # At most 2 * SAMPLE_ROWS ids: broadcast.
    short = short.select(F.col(id_col).alias("_d"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("_t"))
    got = short.join(F.broadcast(some), F.col("_d") == F.col("_id")).select("_id", "_y", "_t").collect()
    got = sorted(((r["_id"], r["_y"], bytes(r["_t"])) for r in got), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[2]))
    drawn = {q: max(1, sum(y == q for _, y, _ in got)) for q in (0, 1)}
    return train([t for _, _, t in got], [y for _, y, _ in got], [shares[y] / drawn[y] for _, y, _ in got])


def score_column(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """The score of a text column, as an Arrow-batched function: other columns stay with Spark."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(shared.value)
        for texts in parts:
            yield pd.Series(s.scores([t.encode() for t in texts]), dtype="float64")

    return scored(F.coalesce(F.col(text_col), F.lit("")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    scored = docs.withColumn("score", score_column(spark, model))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents (score below the threshold) go."""
    model = fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    if model.constant is not None:
        return docs
    score = unused(docs.columns, "_score")
    return docs.withColumn(score, score_column(spark, model)).where(F.col(score) >= THRESHOLD).drop(score)


SQL: dict[str, str] = {}
