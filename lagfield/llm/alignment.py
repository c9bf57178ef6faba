"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes, their groups, and which ids go together in the corpus.

A is a byte-level BPE (of a space and the text), B a piece BPE (which puts the space there itself). Both token lists cut the same bytes into intervals.

1. Blocks. A partition's texts are taken in blocks of about ``BLOCK_BYTES``. Texts are cut where neither vocabulary has a token across (a single space or line feed
   between two plain characters), and every different piece of a block is encoded once. The pieces' bytes lie one after the other: running sums of the
   ends of A's, of B's and of both's tokens over these bytes give the first and last B token that each A token overlaps (the links) and the groups. Links by
   piece times pieces by document give the linked id pairs of each document.
2. Counts. Each block gives one partial count for each of its id pairs (how many of its documents hold the pair); Spark adds them up, and takes each A id's highest count (a
   row an id: as many as A's vocabulary, hence broadcast).
3. Back. The counts of a block's pairs go back to the block, not to each document: a row for each pair and block is exchanged twice, and
   documents meet them as positions in the block's list of pairs.

Defined results: null and empty texts, and texts whose tokens do not give back the space and the text (a U+2581 in it), have no tokens: zeros and no groups; special tokens'
strings are plain text; repeated rows and null ids are rows of their own and count as documents of their own; an empty table gives an empty result; texts pass
whole, a text larger than a block is a block of its own (memory: measured 32 bytes a byte of a text of 26 MB); columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import _MARKS, WORDS_A_CALL, WordCachedBpe, _byte_letters
from .common import Scratch, read
from .files import bounded_batches

BLOCK_BYTES, KEPT_PIECES, KEPT_WORDS = 3 << 20, 600_000, 600_000
MARK, PLAIN = "▁", "!-~À-ɏ"
#: Texts of plain words with single spaces or line feeds between; where any other text may be cut; pieces of one plain word.
PLAIN_TEXT = re.compile(f"[{PLAIN}]+(?:[ \n][{PLAIN}]+)*")
CUT = re.compile(f"(?<=[{PLAIN}])(?=[ \n][{PLAIN}])")
PLAIN_PIECE_RE2 = rf"\A[ \n][{PLAIN}]+\z"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = f"block long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups string, at array<int>, n array<int>, pairs array<long>, documents array<int>"

def _places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... of every k, ``count[k]`` of them."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums between neighbouring ends."""
    return np.diff(np.r_[0, np.cumsum(values)][ends])


@dataclass
class Lists:
    """Lists of numbers, one after the other: list k has those from at[k] to at[k + 1]."""

    values: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, count: np.ndarray) -> Lists:
        return cls(values, np.r_[0, np.cumsum(count)])

    @classmethod
    def of_lists(cls, lists: Sequence[Sequence[int]]) -> Lists:
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        return cls.of(np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.at)

    def take(self, k: np.ndarray) -> Lists:
        count = self.count[k]
        return Lists.of(self.values[_places(self.at[k], count)], count)

    def then(self, *others: Lists) -> Lists:
        both = (self, *others)
        return Lists.of(np.concatenate([x.values for x in both]), np.concatenate([x.count for x in both]))


NONE = Lists(np.zeros(0, np.int64), np.zeros(1, np.int64))


class Kept:
    """What has been learned of different strings: ``of`` lists of numbers for each."""

    def __init__(self, of: int):
        self.forgotten = (pa.array([], pa.large_string()), (NONE,) * of)
        self.names, self.lists = self.forgotten

    def find(self, names: pa.Array, learn: Callable[[pa.Array], tuple[Lists, ...]], most: int) -> list[Lists]:
        """Those of different strings; all are forgotten once there are more than ``most``."""
        if len(self.names) > most:
            self.names, self.lists = self.forgotten
        at = pc.index_in(names, self.names)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if missing.any():
            new = names.filter(pa.array(missing))
            at[missing] = len(self.names) + np.arange(len(new))
            self.names, self.lists = pa.concat_arrays([self.names, new]), tuple(x.then(y) for x, y in zip(self.lists, learn(new), strict=True))
        return [x.take(at) for x in self.lists]


def _texts(of: pa.Array) -> list[str]:
    return of.to_numpy(zero_copy_only=False).tolist()


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        byte_of = {chr(c): b for b, c in enumerate(_byte_letters())}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.raw_a = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(t[3:-1], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        self.raw_a, self.raw_b = (pa.array(raw, pa.large_binary()) for raw in (self.raw_a, self.raw_b))
        self.decimal = pa.array(map(str, range(max(len(self.raw_a), len(self.raw_b)))), pa.string())
        inner = [t for t in names if len(t) > 1 and not t.startswith("<0x")]
        if any(MARK in t.lstrip(MARK) for t in inner) or any("\n" in t for t in names):
            raise ValueError("a piece of B goes on after a space, or has a line feed in it")
        self.words, self.special = WordBpe(byte_level), [t.content for t in self.a.get_added_tokens_decoder().values()]
        self.kept = Kept(2)

    def pieces_of(self, text: str) -> list[str]:
        """Pieces of a space and the text; none for a text that B cannot give back."""
        if not text or MARK in text:
            return []
        if PLAIN_TEXT.fullmatch(text):
            return f" {text}".replace(" ", "\0 ").replace("\n", "\0\n")[1:].split("\0")
        return CUT.split(f" {text}")

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and where each text's end."""
        plain = [PLAIN_TEXT.fullmatch(t) is not None for t in texts]
        split = [f" {t}".replace(" ", "\0 ").replace("\n", "\0\n")[1:] for t, ok in zip(texts, plain, strict=True) if ok]
        found = pc.split_pattern(pa.array(split, pa.large_string()), "\0").cast(pa.large_list(pa.large_string()))
        if len(split) < len(texts):
            others = pa.array([self.pieces_of(t) for t, ok in zip(texts, plain, strict=True) if not ok], pa.large_list(pa.large_string()))
            found = pa.concat_arrays([found, others]).take(pa.array(np.argsort(np.argsort(~np.array(plain), kind="stable"))))
        return found.flatten(), np.r_[0, np.cumsum(pc.list_value_length(found).to_numpy())].astype(np.int64)

    def _learn(self, pieces: pa.Array) -> tuple[Lists, Lists]:
        """A piece begins with the space that B adds by itself, or with a line feed: then B gives back a space of its own, which goes."""
        texts = _texts(pieces)
        fast = pc.match_substring_regex(pieces, PLAIN_PIECE_RE2).to_numpy(zero_copy_only=False)
        joined = "\n".join(texts)
        if any(s in joined for s in self.special):
            fast &= np.array([not any(s in p for s in self.special) for p in texts], bool)
        a, fast = self.words.lists(pieces, fast)
        others = [texts[k] for k in np.flatnonzero(~fast).tolist()]
        slow = Lists.of_lists([e.ids for e in self.a.encode_batch_fast(others, add_special_tokens=False)])
        a = a.then(slow).take(np.argsort(np.r_[np.flatnonzero(fast), np.flatnonzero(~fast)]))
        line = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        b = Lists.of_lists(self.b.encode([p if x else p[1:] for p, x in zip(texts, line.tolist(), strict=True)], num_threads=1))
        if line.any():
            b = Lists.of(b.values[_places(b.at[:-1] + line, b.count - line)], b.count - line)
        if not (same := self._same(pieces, a, b)).all():
            # A piece that does not come back has no tokens.
            a, b = (Lists.of(x.values[np.repeat(same, x.count)], x.count * same) for x in (a, b))
        return a, b

    def encode(self, pieces: pa.Array) -> list[Lists]:
        return self.kept.find(pieces, self._learn, KEPT_PIECES)

    def _same(self, pieces: pa.Array, a: Lists, b: Lists) -> np.ndarray:
        """Which pieces come back from the tokens of both."""
        back = [_joined(raw, t) for raw, t in ((self.raw_a, a), (self.raw_b, b))]
        want = pieces.cast(pa.large_binary())
        return np.logical_and(*[pc.equal(x, want).to_numpy(zero_copy_only=False) for x in back])

    def _overlaps(self, a: Lists, b: Lists) -> tuple[Lists, pa.Array, np.ndarray]:
        """For every piece: its links (A id << 32 | B id), its group string and the number of its groups.

        Both token lists cut the same bytes, all pieces' one after the other: how many tokens end up to a byte is a running sum over those bytes.
        """
        stop_a, stop_b = np.cumsum(self.size_a[a.values]), np.cumsum(self.size_b[b.values])
        n = int(stop_a[-1]) if len(stop_a) else 0
        ends_a, ends_b = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        ends_a[stop_a], ends_b[stop_b] = 1, 1
        both = np.cumsum(ends_a & ends_b)
        upto = np.cumsum(ends_b)
        # Of B: those that end after the A token's begin, up to the first that ends at the A token's end or later.
        first, last = upto[stop_a - self.size_a[a.values]], upto[stop_a - 1]
        count = (last - first + 1).astype(np.int64)
        links = (np.repeat(a.values, count) << 32) | b.values[_places(first.astype(np.int64), count)]
        of_links = Lists(links, np.r_[0, np.cumsum(count)][a.at])
        # A group ends where both do: the tokens of one have as many such ends before their own last byte.
        total = int(both[-1])
        ids = [pc.binary_join(_list(self.decimal.take(pa.array(t.values)), np.searchsorted(both[stop - 1], np.arange(total + 1)), pa.string()), ",") for t, stop in ((a, stop_a), (b, stop_b))]
        groups = pc.binary_join_element_wise(*ids, "|")
        ends = np.r_[0, both[stop_a]][a.at]
        return of_links, pc.binary_join(_list(groups, ends, pa.string()), ";"), np.diff(ends)

    def block(self, texts: list[str]) -> dict:
        """Counts and group strings of each text, and the linked pairs: ``held`` (text, position, times) over ``pairs`` and ``documents``."""
        pieces, ends = self._cut(texts)
        found = pieces.dictionary_encode()
        place = found.indices.to_numpy().astype(np.int64)
        a, b = self.encode(found.dictionary)
        if not (some := a.count > 0).all():
            # A piece without tokens takes its texts out.
            length = np.diff(ends)
            whole = _sums(~some[place], ends) == 0
            place, ends = place[np.repeat(whole, length)], np.r_[0, np.cumsum(length * whole)]
        links, groups, n_groups = self._overlaps(a, b)
        counts = {c: _sums(v[place], ends) for c, v in {"n_a": a.count, "n_b": b.count, "n_groups": n_groups, "n_links": links.count}.items()}
        of_texts = pc.binary_join(_list(groups.cast(pa.large_string()).take(pa.array(place)), ends, pa.large_string()), pa.scalar(";", pa.large_string()))
        pairs, number = np.unique(links.values, return_inverse=True)
        wide = max(1, len(pairs))
        # A text's different pieces, with how often it has them; their links as numbers (text, pair, times), sorted: those of a text's pair are neighbours.
        both, times = np.unique(np.repeat(np.arange(len(texts)), np.diff(ends)) * max(1, len(some)) + place, return_counts=True)
        doc, piece = np.divmod(both, max(1, len(some)))
        count, limit = links.count[piece], int(times.max(initial=0)) + 1
        held, n = np.divmod(np.sort((np.repeat(doc, count) * wide + Lists(number, links.at).take(piece).values) * limit + np.repeat(times, count)), limit)
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
        doc, at = np.divmod(held[first], wide)
        documents = np.bincount(at, minlength=len(pairs))
        listed = documents > 0
        at = (np.cumsum(listed) - 1)[at] if len(at) else at
        return counts | {"groups": of_texts.to_pylist(), "held": {"doc": doc, "place": at, "n": np.add.reduceat(n, first) if len(first) else n}, "pairs": pairs[listed], "documents": documents[listed]}


class WordBpe(WordCachedBpe):
    """Ids of many words of letters and marks at a call."""

    def __init__(self, path: str):
        super().__init__(path)
        self.stems = Kept(1)

    def lists(self, pieces: pa.Array, plain: np.ndarray) -> tuple[Lists, np.ndarray]:
        """Ids of those pieces of letters and marks that are ``plain``, and which they are: the ids of the letters, then those of the marks."""
        stems = pc.utf8_rtrim(pieces, _MARKS)
        fast = plain & pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, 1)).to_numpy(zero_copy_only=False)
        pieces, stems = pieces.filter(pa.array(fast)), stems.filter(pa.array(fast))
        tails = pa.array([p[len(s) :] for p, s in zip(_texts(pieces), _texts(stems), strict=True)], pa.large_string()).dictionary_encode()
        stems = stems.dictionary_encode()
        (of,) = self.stems.find(stems.dictionary, self._learn_stems, KEPT_WORDS)
        of = of.then(Lists.of_lists([np.frombuffer(self.whole(t), "<u4").tolist() if t else [] for t in _texts(tails.dictionary)]))
        parts = of.take(np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)], 1).ravel().astype(np.int64))
        return Lists(parts.values, parts.at[::2]), fast

    def _learn_stems(self, stems: pa.Array) -> tuple[Lists]:
        """Letters after a space, or after a line feed, which is a token of its own."""
        words = _texts(stems)
        line = np.array([w[0] == "\n" for w in words], bool)
        of = self._letters([w for w in words if w[0] == " "]).then(self._letters([w[1:] for w in words if w[0] != " "]), Lists.of_lists([np.frombuffer(self.line, "<u4").tolist(), []]))
        place = np.argsort(np.r_[np.flatnonzero(~line), np.flatnonzero(line)])
        parts = of.take(np.stack([len(words) + ~line, place], 1).ravel())
        return (Lists(parts.values, parts.at[::2]),)

    def _letters(self, words: list[str]) -> Lists:
        """Ids of letters, or a space and letters, which the pre-tokenizer leaves whole: line feeds between."""
        out = NONE
        for k in range(0, len(words), WORDS_A_CALL):
            some = words[k : k + WORDS_A_CALL]
            joined = self.letters[np.frombuffer("\n".join(some).encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.words_only.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            is_line = ids == self.line_id
            count = np.diff(np.r_[-1, np.flatnonzero(is_line), len(ids)]) - 1
            if len(count) != len(some):
                raise ValueError("words and line feeds do not agree")
            out = out.then(Lists.of(ids[~is_line], count))
        return out


def _joined(raw: pa.Array, of: Lists) -> pa.Array:
    """The bytes of each list's tokens."""
    data = raw.take(pa.array(of.values))
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1)[of.at] if len(data) else np.zeros(len(of.at), np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of.at) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), data.buffers()[2]])


_OF: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each worker."""
    if (byte_level, pieces) not in _OF:
        _OF[byte_level, pieces] = Aligner(byte_level, pieces)
    return _OF[byte_level, pieces]


def _list(values: np.ndarray | pa.Array, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(np.asarray(values), kind))


def _block_rows(ids: list, texts: list[str], number: int, of: Aligner, keep_groups: bool) -> pa.RecordBatch:
    """A row a document, and one of the block with its pairs (doc_id and counts null)."""
    x, n = of.block(texts), len(ids)
    groups = x["groups"] if keep_groups else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x["groups"]]
    ends = np.r_[np.searchsorted(x["held"]["doc"], np.arange(n + 1)), len(x["held"]["doc"])]
    last = np.r_[np.zeros(n + 1, np.int64), len(x["pairs"])]
    columns = [pa.array([number] * (n + 1), pa.int64()), pa.array([*ids, None], pa.int64()), *(pa.array([*x[c].tolist(), None], pa.int64()) for c in COUNTS), pa.array([*groups, None], pa.string())]
    columns += [_list(x["held"]["place"], ends, pa.int32()), _list(x["held"]["n"], ends, pa.int32()), _list(x["pairs"], last, pa.int64()), _list(x["documents"], last, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ALIGNED.split(", ")])


def aligned_blocks(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """``ALIGNED``: rows of documents, and one for each block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, number, ids, texts, size = aligner(byte_level, pieces), TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if texts and size + len(t) > BLOCK_BYTES:
                    yield _block_rows(ids, texts, number, of, keep_groups)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t) + 100
        if texts:
            yield _block_rows(ids, texts, number, of, keep_groups)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, ALIGNED)


def _with_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with what the corpus says of their pairs; ``right`` has position, count and whether it is its A id's highest."""
    size = len(right)
    count, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    at = right.column("at").to_numpy()
    count[at], best[at] = right.column("documents").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    lists, times = left.column("at").combine_chunks(), left.column("n").combine_chunks()
    ends = lists.offsets.to_numpy()
    place, n = lists.values.to_numpy()[ends[0] : ends[-1]], times.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
    ends = ends - ends[0]
    upto = lambda v: np.diff(np.r_[0, np.cumsum(v)][ends])
    return left.drop_columns(["block", "at", "n"]).append_column("n_best", pa.array(upto(n * best[place]))).append_column("count_sum", pa.array(upto(n * count[place])))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents: doc_id, n_a, n_b, n_groups, n_links, groups (the ids of both in each group; without ``keep_groups`` the sha256 of that, some
    four times the text's size), n_best, count_sum. Pairs: a, b, documents (how many hold the pair linked), best (the count is its A id's highest)."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "align")
    blocks = scratch.written(aligned_blocks(docs, byte_level, pieces, id_col, text_col, keep_groups), "blocks")
    partial = blocks.where("n_a IS NULL").select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("held"))
    counts = partial.groupBy("pair").agg(F.sum("held").alias("documents")).withColumn("a", F.shiftright("pair", 32))
    counts = scratch.written(counts, "counts")
    top = counts.groupBy("a").agg(F.max("documents").alias("most"))
    counts = counts.join(F.broadcast(top), "a").select("pair", "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "documents", (F.col("documents") == F.col("most")).alias("best"))
    back = partial.join(counts.select("pair", "documents", "best"), "pair").select("block", "at", "documents", "best")
    of_docs = blocks.where("n_a IS NOT NULL").select("block", "doc_id", *COUNTS, "groups", "at", "n")
    out = of_docs.groupBy("block").cogroup(back.toDF(*back.columns).groupBy("block")).applyInArrow(_with_counts, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups string, n_best long, count_sum long")
    return out, counts.select("a", "b", "documents", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out, _ = align(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")), keep_groups=False)
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


SQL: dict[str, str] = {}
