"""Quality rules from tokeniser fertility: characters per token, byte-fallback share and token entropy, with rejection bands per language or script.

Two public vocabularies measure the words of a text: a byte-level BPE (A) and a piece BPE with byte fallback (B). Words are encoded one by one, A with
a space before them, so that a word is measured about once per worker and white space takes no part. Per text: characters per token of A and of B, the
share of B's tokens that are byte pieces, and the entropy of B's tokens over the logarithm of their number.

Bands: texts of one language (without one: of one script) give the quartiles of each measure. Every different text counts once and
base failures do not count, so that copies do not move a band. A text is rejected where a measure lies more than ``BELOW`` spreads under or ``ABOVE`` spreads over its language's
median; the spread is the quartiles' distance as a standard deviation, at least the measure's ``FLOOR``, and wider for short texts, whose measures stray.
Quartiles come from a histogram of fixed bins, so that reruns agree and no group's rows meet in a task.

Base rules beside it: fewer than ``LEAST_WORDS`` words, or over ``MOST_REPEATED`` percent of them in eight-word windows that the text has twice.

Defined results: null, empty and wordless texts have no words and fail the base rules; languages with fewer than ``LEAST_TEXTS`` different texts have no
band and reject nothing; repeated rows and null ids are rows of their own; a null language is replaced by the script of most words; very long texts and words pass whole;
an empty table gives an empty result; columns beside id, text and language are not read, whatever their names.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, attach_by_key, read
from .files import bounded_batches
from .words import covered, numbered, repeated

WINDOW, LEAST_WORDS, MOST_REPEATED, SYMBOLS, SPACES = 8, 20, 30, "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Bands: spreads under and over the median, words that a text needs for a spread of its language's own size, texts that a band needs.
BELOW, ABOVE, SHORT_WORDS, LEAST_TEXTS = 4.0, 6.0, 60, 50
#: Least spread of each measure: a share of the median, and an absolute part.
FLOOR = {"chars_per_token_a": (0.015, 0.0), "chars_per_token_b": (0.015, 0.0), "byte_share": (0.0, 0.02), "entropy": (0.08, 0.0)}
#: Histogram bins of one unit, and the highest bin.
BIN, LAST_BIN = 200, 4000
KEPT_WORDS, KEPT_BYTES = 400_000, 1 << 26
MEASURES = "doc_id long, lang string, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token_a double, chars_per_token_b double, byte_share double, entropy double"


class Vocabularies:
    """Tokens of words in either vocabulary: ``a`` their number in A, ``b`` and ``byte`` in B, ``ids`` those of B from ``at`` on; ``script`` numbers their script."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte_level, self.pieces = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.byte_level.encode_special_tokens = True
        self.size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.scripts: dict[str, int] = {}
        self.a = self.b = self.byte = self.script = np.zeros(0, np.int32)
        self.at, self.ids, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def _script(self, word: str) -> int:
        letter = next((c for c in word if c.isalpha()), "")
        return self.scripts.setdefault(unicodedata.name(letter, "NONE").split()[0] if letter else "NONE", len(self.scripts))

    def numbers(self, words: list[list[bytes]]) -> list[np.ndarray]:
        """Numbers of the words of each text; words not yet known are measured."""
        if len(self.known) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.clear()
        before = len(self.known)
        out = [numbered(w, self.known) for w in words]
        if len(self.known) > before:
            new = [w.decode() for w in list(self.known)[before:]]
            pieces = self.pieces.encode(new, num_threads=1)
            counts = np.fromiter(map(len, pieces), np.int32, len(new))
            ids = np.fromiter((i for p in pieces for i in p), np.int32, int(counts.sum()))
            at = np.r_[0, np.cumsum(counts)].astype(np.int64)
            a = [len(e) for e in self.byte_level.encode_batch_fast([f" {w}" for w in new], add_special_tokens=False)]
            self.a, self.b = np.r_[self.a, np.array(a, np.int32)], np.r_[self.b, counts]
            self.byte = np.r_[self.byte, np.diff(np.r_[0, np.cumsum(self.is_byte[ids])][at]).astype(np.int32)]
            self.at, self.ids = np.r_[self.at, self.at[-1] + at[1:]], np.r_[self.ids, ids]
            self.script = np.r_[self.script, np.array([self._script(w) for w in new], np.int32)]
            self.bytes += sum(map(len, new)) + 4 * len(ids)
        return out

    def entropy(self, doc: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
        """Entropy of B's tokens in each text over the logarithm of their number (0 with fewer than two); ``doc`` and ``word`` have an entry a word."""
        pair, times = np.unique(doc * np.int64(len(self.known)) + word, return_counts=True)
        d, w = pair // len(self.known), pair % len(self.known)
        lens = self.b[w].astype(np.int64)
        place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(self.at[w], lens)
        token, back = np.unique(np.repeat(d, lens) * np.int64(self.size) + self.ids[place], return_inverse=True)
        count, of = np.bincount(back.ravel(), np.repeat(times, lens)), token // self.size
        total = np.bincount(of, count, n_docs)
        share = count / total[of]
        bits = -np.bincount(of, share * np.log2(share), n_docs)
        return np.divide(bits, np.log2(np.maximum(total, 2)), where=total > 1, out=np.zeros(n_docs))


_OF: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(byte_level: str, pieces: str) -> Vocabularies:
    """One for each worker, whose known words later tasks find."""
    if (byte_level, pieces) not in _OF:
        _OF[byte_level, pieces] = Vocabularies(byte_level, pieces)
    return _OF[byte_level, pieces]


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, where=b > 0, out=np.zeros(len(a)))


def _measured_batch(batch: pa.RecordBatch, v: Vocabularies) -> pa.RecordBatch:
    texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
    n = len(texts)
    words = v.numbers([t.encode().split() for t in texts])
    n_words = np.array([len(w) for w in words], np.int64)
    chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    repeats = np.array([int(covered(repeated(w, WINDOW), WINDOW, len(w)).sum()) for w in words], np.int64)
    doc, word = np.repeat(np.arange(n), n_words), np.concatenate(words) if n else np.zeros(0, np.int64)
    total = lambda per_word: np.bincount(doc, per_word[word], n)
    a, b, byte = total(v.a), total(v.b), total(v.byte)
    if any(x is None for x in langs):
        names = sorted(v.scripts, key=v.scripts.get)
        by_script = np.bincount(doc * len(names) + v.script[word], minlength=n * len(names)).reshape(n, -1) if names else np.zeros((n, 1))
        most = by_script.argmax(1) if names else np.zeros(n, int)
        langs = [x if x is not None else f"script {names[m]}" if k else None for x, m, k in zip(langs, most, n_words, strict=True)]
    measures = [_ratio(chars, a), _ratio(chars, b), _ratio(byte, b), v.entropy(doc, word, n)]
    columns = [batch.column("doc_id"), pa.array(langs, pa.string()), batch.column("key"), n_words, chars, symbols, np.array([_dup_lines(t) for t in texts], np.int64), repeats, *measures]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in MEASURES.split(", ")])


def measure(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and fertility measures of every row: ``MEASURES``; ``lang`` is the language or, without one, the script; ``key`` is the text's md5."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(byte_level, pieces)
        for b in batches:
            yield _measured_batch(b, v)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.unhex(F.md5(F.encode(text, "utf-8"))).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(measures: DataFrame) -> DataFrame:
    """lang, texts, and for each measure its median and spread. One row a language; texts that fail the base rules or repeat another one take no part."""
    texts = measures.where(~base_failed() & F.col("lang").isNotNull()).groupBy("lang", "key").agg(*[F.first(c).alias(c) for c in FLOOR])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.least(F.floor(F.col(c) * BIN), F.lit(LAST_BIN)).cast("int").alias("bin")) for c in FLOOR]))
    bins = texts.select("lang", each.alias("x")).groupBy("lang", "x.name", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    # At most LAST_BIN + 1 rows a language and measure.
    all_of = Window.partitionBy("lang", "name")
    bins = bins.withColumns({"upto": F.sum("n").over(all_of.orderBy("bin")), "texts": F.sum("n").over(all_of)})
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("texts") * q, (F.col("bin") + 0.5) / BIN))
    rows = bins.groupBy("lang", "name").agg(F.max("texts").alias("texts"), quartile(0.25).alias("low"), quartile(0.5).alias("median"), quartile(0.75).alias("high")).where(F.col("texts") >= LEAST_TEXTS)
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    columns = []
    for name, (share, least) in FLOOR.items():
        spread = F.greatest((of(name, "high") - of(name, "low")) / 1.349, of(name, "median") * share, F.lit(least))
        columns += [of(name, "median").alias(f"{name}_median"), spread.alias(f"{name}_spread")]
    return rows.groupBy("lang").agg(F.max("texts").alias("texts"), *columns)


def inside_bands() -> Column:
    """Whether all measures lie in their bands; true without bands."""
    wider = F.sqrt(1 + SHORT_WORDS / F.greatest(F.col("n_words"), F.lit(1)))
    ok = F.lit(True)
    for name in FLOOR:
        off = (F.col(name) - F.col(f"{name}_median")) / (F.col(f"{name}_spread") * wider)
        ok = ok & F.coalesce(off.between(-BELOW, ABOVE), F.lit(True))
    return ok


def quality_rules(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row with its counts, measures, the bands of its language, base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "fertility")
    rows = scratch.written(measure(docs, byte_level, pieces, id_col, text_col, lang_col), "measures")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    limits = scratch.written(bands(rows).join(sizes, "lang"), "bands")
    out = attach_by_key(rows, limits, "lang", "rows", max(1, rows.count()), ["doc_id", "key"])
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside_bands())


def op13_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = quality_rules(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL: dict[str, str] = {}
