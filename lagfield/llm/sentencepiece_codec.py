"""SentencePiece encoding and decoding of whole texts by a shared-prefix dynamic programme over marked words.

The distinct marked words of a batch are sorted, so that neighbours share prefixes, and walked depth-first as a
trie: the state of every prefix (its last piece and where that begins) stays on a stack and is used again by all words that go on
from it. The ids are read off backwards once a word ends, so memory grows with the length of a word (24 bytes a character) and not with its square.

The public model is a BPE model, for which the best-scoring Viterbi path is not the library's result. The forward state here
is therefore the one exact for BPE: the last piece of a prefix's encoding. A piece p that ends a prefix is the right one just when
the piece before it (the state where p begins) and p, merged by the model's own rules, stay these two pieces; exactly one p does. The ids
equal the library's. A ``unigram`` table of scores may be given instead, for which the state is the classic Viterbi score.

Defined results: null text counts as empty and has no ids; ``▁`` in a text is a space to the model and comes back as
one (``round_trip`` says false); characters that the model lacks become byte pieces; repeated rows and null ids are rows of their own;
texts of any length pass whole; an empty table gives an empty result; columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .files import bounded_batches

MARK, KEPT_WORDS, KEPT_BYTES = "▁", 600_000, 1 << 27
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _shared(a: str, b: str) -> int:
    """Length of the common prefix: doubling, then halving, of steps that are compared as a whole."""
    most, at, step = min(len(a), len(b)), 0, 1
    while at < most and a[at : at + step] == b[at : at + step] and at + step <= most:
        at, step = at + step, 2 * step
    while step:
        if at + step <= most and a[at : at + step] == b[at : at + step]:
            at += step
        step //= 2
    return at


class TrieCodec:
    """Vocabulary: ``pieces`` (piece, score) by id; ``plain`` ids may be merged; ``byte_ids[b]`` is the piece of byte b."""

    def __init__(self, pieces: list[tuple[str, float]], plain: list[int], byte_ids: list[int], kind: str = "bpe"):
        self.ids = {pieces[i][0]: i for i in plain}
        self.score = [s for _, s in pieces]
        self.piece = [p for p, _ in pieces]
        self.byte_ids, self.kind = byte_ids, kind
        self.longest = max(map(len, self.ids), default=1)
        self.raw = [p.replace(MARK, " ").encode() for p, _ in pieces]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if kind == "bpe" and not joined <= self.ids.keys():
            raise ValueError("a character of a longer piece is not a piece itself")
        self.line_alone = "\n" not in joined
        self.fits: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    @classmethod
    def from_model(cls, path: str) -> TrieCodec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        plain = [i for i in n if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in n], plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def _merge(self, text: str) -> list[str]:
        """The model's own rule: join the best-scoring pair of neighbours, the leftmost of equals, while there is one."""
        parts = list(text)
        while True:
            joins = [(-self.score[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not joins:
                return parts
            k = min(joins)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fit(self, before: int, piece: int) -> bool:
        """Whether ``piece`` may follow ``before`` (-1: nothing that could merge)."""
        if (known := self.fits.get((before, piece))) is None:
            ends = [self.piece[before], self.piece[piece]] if before >= 0 else [self.piece[piece]]
            known = self.fits[before, piece] = self._merge("".join(ends)) == ends
        return known

    def _extend(self, word: str, end: int, last: array, begin: array, total: array) -> None:
        """The state of ``word[:end]`` from those of the shorter prefixes: its last piece (-1: a character in bytes) and where that begins."""
        best = None
        for n in range(1, min(self.longest, end) + 1):
            i = self.ids.get(word[end - n : end])
            if i is None:
                continue
            if self.kind == "bpe":
                if self._fit(last[end - n], i):
                    best = (i, end - n, 0.0)
                    break
            elif best is None or total[end - n] + self.score[i] > best[2]:
                best = (i, end - n, total[end - n] + self.score[i])
        if best is None:
            best = (-1, end - 1, total[end - 1] - 100.0 * len(word[end - 1].encode()))
        last.append(best[0])
        begin.append(best[1])
        total.append(best[2])

    def _path(self, word: str, last: array, begin: array) -> array:
        """The ids of ``word``, from its end back to its start."""
        out, end = array("i"), len(word)
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[end - 1].encode()))
            end = begin[end]
        out.reverse()
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes marked words in sorted order, a depth-first walk of their trie."""
        last, begin, total = array("q", [-1]), array("q", [0]), array("d", [0.0])
        before = ""
        for word in sorted(words):
            shared = _shared(before, word)
            del last[shared + 1 :], begin[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                self._extend(word, end, last, begin, total)
            self.kept[word] = np.asarray(self._path(word, last, begin), "<i4").tobytes()
            self.kept_bytes += len(self.kept[word]) + len(word)
            before = word

    def segments(self, text: str) -> list[str]:
        """Marked words: no piece reaches across their borders."""
        marked = MARK + text.replace(" ", MARK)
        if self.line_alone and MARK * 2 not in marked and MARK not in text:
            return [w for w in (MARK + text).replace("\n", " \n").replace(" ", f" {MARK}").replace(f"{MARK}\n", "\n").split(" ") if w]
        return _SEGMENT.findall(marked)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit bytes."""
        cut = [self.segments(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS or self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
        if len(self.fits) > KEPT_WORDS:
            self.fits.clear()
        self.learn(list(set().union(*cut).difference(self.kept)))
        kept = self.kept
        return [b"".join([kept[w] for w in c]) for c in cut]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_OF: dict[str, TrieCodec] = {}


def codec(path: str) -> TrieCodec:
    """One for each worker, whose known words later tasks find."""
    if path not in _OF:
        _OF[path] = TrieCodec.from_model(path)
    return _OF[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (the decoded ids are the text) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = b.column("text").to_pylist()
            raw = c.encode_batch(texts)
            sizes = np.array([len(x) // 4 for x in raw], np.int64)
            values = np.frombuffer(b"".join(raw), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, pa.int32()))
            same = [c.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(raw, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(sizes), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(ids: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids (null stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField("decoded", T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), default_model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: ids of every document."""
    return encode(docs, default_model())


SQL: dict[str, str] = {}
