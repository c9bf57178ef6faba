"""Periodic runs of words: masking by repeated k-grams, Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q and length of at least max(``LEAST_LENGTH``, 2 q) that no neighbouring word extends.

1. Masking. Shifted by q a run repeats all but q of its words: length - q >= max(LEAST_LENGTH - q, q), so LEAST_LENGTH / 2 = k words at least, and the two
   copies cover it. A word outside all k-grams that the text has twice is therefore in no run. The k-grams are chosen by hashes; one chosen for nothing
   costs time and changes no result.
2. Surviving segments are halved down to LEAST_LENGTH (Main and Lorentz, 1984). A run lies in a smallest part that holds all of it, and there it crosses the middle m: then its period q has
   words m and m + q (or m - q and m) alike, and the stretch of words alike to the right plus that to the left is q words at least.
   All parts of one depth, of all texts of a batch, are asked at once.
3. How far two places agree is exact: blocks of 2^j words have equal numbers just when their words are equal, and 2^j falls from the longest segment down.

Stretches found with a multiple of their smallest period have the same ends, so the least period of a stretch is its run's.

Defined results: null, empty and wordless texts have no run and stay empty; a text without a run comes back as its words joined by one space; repeated
rows and null ids are rows of their own; an empty table gives an empty result; very long texts pass whole (memory of a text: its words times the logarithm of the longest surviving segment);
columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .files import bounded_batches
from .words import covered, maybe_repeated, numbered

LEAST_LENGTH = 12
#: Words of surviving segments that are asked together; a longer segment goes alone.
TOGETHER = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Agreement:
    """How far the words from two places on, or before two places, are alike. ``codes``: numbers of words."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.ranks = [np.unique(codes, return_inverse=True)[1].ravel().astype(np.int32)]
        while (step := 1 << (len(self.ranks) - 1)) * 2 <= min(longest, len(codes)):
            last = self.ranks[-1].astype(np.int64)
            pairs = last[:-step] * (int(last.max()) + 1) + last[step:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].ravel().astype(np.int32))

    def _reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        found = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            step, rank = 1 << level, self.ranks[level]
            some = np.flatnonzero(found + step <= most)
            at = -(found[some] + step) if back else found[some]
            found[some] += step * (rank[i[some] + at] == rank[j[some] + at])
        return found

    def after(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._reach(i, j, most, False)

    def before(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._reach(i, j, most, True)


def _crossing(codes: np.ndarray, agree: Agreement, parts: np.ndarray, least: int) -> np.ndarray:
    """Stretches (start, end, period) that cross the middle of a part; ``parts``: rows of begin, end, and the segment's begin and end."""
    begin, end, low, high = parts.T
    mid, found = (begin + end) // 2, []
    for size, side in ((end - mid, 0), (mid - begin, 1)):
        node = np.repeat(np.arange(len(parts)), size)
        q = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + 1
        i = mid[node] - side * q
        j = i + q
        lo, hi = low[node], high[node]
        # One of the two words at the places, or before them, must be alike.
        same = np.zeros(len(node), bool)
        inside = j < hi
        same[inside] = codes[i[inside]] == codes[j[inside]]
        inside = i > lo
        same[inside] |= codes[i[inside] - 1] == codes[j[inside] - 1]
        i, j, q, lo, hi = i[same], j[same], q[same], lo[same], hi[same]
        right, left = agree.after(i, j, hi - j), agree.before(i, j, i - lo)
        long = (right + left >= q) & (right + left + q >= least)
        found.append(np.column_stack([i - left, j + right, q])[long])
    return np.concatenate(found)


def main_lorentz(codes: np.ndarray, segments: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """All runs (start, end, period) within the ``segments`` (rows of begin, end) of ``codes``, sorted by start and end. Different segments share no number of ``codes``, or a number stands between them."""
    longest = int((segments[:, 1] - segments[:, 0]).max(initial=0))
    if longest < least:
        return np.zeros((0, 3), np.int64)
    agree, found = Agreement(codes, longest), []
    parts = np.column_stack([segments, segments])
    while len(parts := parts[parts[:, 1] - parts[:, 0] >= least]):
        found.append(_crossing(codes, agree, parts, least))
        mid = (parts[:, 0] + parts[:, 1]) // 2
        left, right = parts.copy(), parts.copy()
        left[:, 1], right[:, 0] = mid, mid
        parts = np.concatenate([left, right])
    runs = np.unique(np.concatenate(found), axis=0)
    # Of equal stretches the first has the least period.
    first = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)][: len(runs)]
    return runs[first]


def surviving(codes: np.ndarray, k: int, least: int) -> np.ndarray:
    """Stretches (begin, end) of at least ``least`` words whose every word lies in a k-gram that occurs twice."""
    alive = np.r_[False, covered(maybe_repeated(codes, k), k, len(codes)), False]
    edge = np.flatnonzero(alive[1:] != alive[:-1]).reshape(-1, 2)
    return edge[edge[:, 1] - edge[:, 0] >= least]


def runs_of(texts: list[list[bytes]], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """The runs (start, length, period) of every list of words, by start and period."""
    # Every text has numbers of its own, and one between it and the next.
    parts, starts, first = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        parts += [numbered(words, known) + first, np.array([first + len(known)])]
        starts.append(len(words) + 1)
        first += len(known) + 1
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts = np.cumsum([0, *starts])
    segments, found = surviving(codes, -(-least // 2), least), [np.zeros((0, 3), np.int64)]
    size = segments[:, 1] - segments[:, 0]
    group = np.cumsum(size) // TOGETHER
    for g in np.unique(group):
        some = segments[group == g]
        # The segments alone, each followed by a number of its own.
        lens = some[:, 1] - some[:, 0]
        to = np.cumsum(lens + 1) - lens - 1
        place = np.repeat(some[:, 0], lens + 1) + np.arange((lens + 1).sum()) - np.repeat(to, lens + 1)
        own = codes[np.minimum(place, len(codes) - 1)]
        own[to + lens] = first + np.arange(len(some))
        runs = main_lorentz(own, np.column_stack([to, to + lens]), least)
        shift = (some[:, 0] - to)[np.searchsorted(to, runs[:, 0], "right") - 1]
        found.append(np.column_stack([runs[:, 0] + shift, runs[:, 1] - runs[:, 0], runs[:, 2]]))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    at = np.searchsorted(runs[:, 0], starts)
    return [runs[a:b] - [s, 0, 0] for a, b, s in zip(at, at[1:], starts, strict=False)]


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words).decode()
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the text without the repetitions) of every row."""
    bounded_batches(docs.sparkSession)
    fields = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.split() for t in b.column("text").to_pylist()]
            found = runs_of(words, least)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), runs, pa.array([_collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_tails(text: Column, h: Column) -> Column:
    """Texts whose ``h`` is divisible by 10, from word a = g % n on made of its next p words again and again (g = h / 10, p = 1 + (n - a) / (3 + g % 8)); others as they are."""

    @F.pandas_udf("string")
    def tailed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hashes in parts:
            out = []
            for t, x in zip(texts, hashes, strict=True):
                words = t.encode().split() if t is not None else []
                if words:
                    g, n = int(x) // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words = words[:a] + [words[a + i % p] for i in range(n - a)]
                out.append(b" ".join(words).decode() if words else None)
            yield pd.Series(out, dtype=object)

    return F.coalesce(tailed(F.when(h % 10 == 0, text), F.coalesce(h, F.lit(0))), text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bounded_batches(spark)
    docs = docs.select("doc_id", with_tails(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    out = periodic_runs(docs).withColumn("top", longest)
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.q")).alias("period"),
        F.expr("1000 * top.length div -top.q").alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL: dict[str, str] = {}
