"""Token ids in a binary format with Re-Pair grammars: frequent id pairs become nonterminals, shard by shard.

A file holds blocks of about ``BLOCK_IDS`` ids, each with its own grammar over the ids that occur in it. Round by round the pairs of neighbours in
a block are counted (never across two documents); those of at least ``SHARE`` of the top count, and of ``LEAST`` occurrences, are replaced, where two
overlap the more frequent one and else the left one. Rounds go on until no pair occurs ``LEAST`` times. A block stores its rules,
the expansion length of each nonterminal and, per document, its place in the compressed sequence, so that any document decodes alone.

Block layout, little-endian: magic, width of a symbol in bytes, counts of documents, rules, symbols and distinct ids (the first nonterminal); then
document ids (int64, and a byte that marks null), places (uint64), token counts (uint64), distinct ids (uint32), rules (2 symbols each), expansion
lengths (uint32), symbols.

Order: by id, then by a hash of the text; rows alike in both have the same ids, so that ``start`` is fixed. Files are cut by range of
(id, hash, row), about ``FILE_BYTES`` of text each, so that a repeated id is no file of its own kind.

Defined results: null text counts as empty and gives the end id alone; rows that repeat an id stay rows, next to each
other in the order; null ids come first; an empty table writes no file and returns no row; long texts pass whole (a block holds one document at least); columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import word_cached
from .common import read, shared_dir
from .files import bounded_batches, one_task_each, open_fs, replacing

BLOCK_IDS, LEAST, SHARE, LOW, END_ID = 1 << 19, 8, 0.1, 4, 2
FILE_BYTES, TEXT_BYTES, TABLE_IDS = 128 << 20, 4 << 20, 1 << 24
MAGIC = b"RPGRAM02"
HEAD = struct.Struct("<8sBQIQI")


def _round(seq: np.ndarray, inside: np.ndarray, places: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Chooses among the pairs that begin at ``places`` (rising; all if None) and lie ``inside`` a document: where (never two that overlap), by which of the round's rules, these rules' pairs, and
    the places of all frequent pairs if the round has looked at all of them. Nothing once no pair occurs ``least`` times."""
    wide, bits = (np.uint32, 16) if seq.dtype == np.uint16 else (np.uint64, 32)
    none = np.zeros(0, np.int64)
    if not len(inside) or (places is not None and not len(places)):
        return none, none, np.zeros((0, 2), wide), None
    keys = (seq[:-1] if places is None else seq[places]).astype(wide)
    keys <<= wide(bits)
    keys |= seq[1:] if places is None else seq[places + 1]
    if places is None:
        keys[~inside] = np.iinfo(wide).max
    ordered = np.sort(keys)
    cut = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(ordered)]
    counts = np.diff(cut)
    if ordered[-1] == np.iinfo(wide).max:
        counts[-1] = 0
    top = counts.max()
    if top < least:
        return none, none, np.zeros((0, 2), wide), None
    enough = max(least, int(top * SHARE))
    # Once the top is low, all frequent pairs are looked up, for the rounds to come; before that only those that this round may replace.
    known = least if places is not None or enough <= LOW * least else enough
    often = np.flatnonzero(counts >= known)
    pairs, weights = ordered[cut[often]], counts[often]
    # A table of 2^18 slots gives a key's pair; the few pairs that share a slot with another one are searched for.
    slot = lambda k: (k * wide(0x9E3779B1)) >> wide(2 * bits - 18)
    table = np.zeros(1 << 18, np.int32)
    table[slot(pairs)] = np.arange(1, len(pairs) + 1)
    rule = table[slot(keys)]
    some = np.flatnonzero(rule)
    rule, found = rule[some] - 1, keys[some]
    wrong = np.flatnonzero(pairs[rule] != found)
    hidden = np.flatnonzero(table[slot(pairs)] != np.arange(1, len(pairs) + 1))
    rule[wrong] = -1
    if len(hidden) and len(wrong):
        which = np.minimum(np.searchsorted(pairs[hidden], found[wrong]), len(hidden) - 1)
        rule[wrong] = np.where(pairs[hidden][which] == found[wrong], hidden[which], -1)
    hit = rule >= 0
    at, rule = some[hit] if places is None else places[some[hit]], rule[hit]
    frequent = at if known == least else None
    if known < enough:
        may = weights[rule] >= enough
        at, rule = at[may], rule[may]
    w, touch = weights[rule], np.diff(at) == 1
    beaten = np.r_[touch & (w[1:] > w[:-1]), False] | np.r_[False, touch & (w[:-1] > w[1:])]
    # Of overlapping pairs of one weight every second one, from the left.
    tied = np.r_[False, touch & (w[:-1] == w[1:])]
    number = np.arange(len(at))
    take = ((number - np.maximum.accumulate(np.where(tied, 0, number))) % 2 == 0) & ~beaten
    at, rule = at[take], rule[take]
    used = np.bincount(rule, minlength=len(pairs))
    # Pairs that lost most places to others wait for a later round; one at least goes on.
    good = used >= max(1, least // 2)
    if not good.any():
        good = used == used.max()
    stay = good[rule]
    low = (wide(1) << wide(bits)) - wide(1)
    return at[stay], (np.cumsum(good) - 1)[rule[stay]], np.stack([pairs[good] >> wide(bits), pairs[good] & low], 1), frequent


def compress(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts``: where documents begin in ``ids``. Returns symbols, starts in them, rules (n, 2) and the distinct ids; symbols below their number stand for them.

    Once a round has looked at all frequent pairs, later ones count only around what it replaced and at the frequent pairs that it left: no other pair
    can have become frequent.
    """
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    n = len(alphabet)
    seq = (np.cumsum(seen) - 1).astype(np.uint16 if n < 1 << 16 else np.uint32)[ids]
    first, rules = np.zeros(len(seq) + 1, bool), []
    first[starts] = True
    near: np.ndarray | None = None
    while True:
        inside = ~first[1:-1]
        at, rule, pairs, frequent = _round(seq, inside, None if near is None else near[inside[near]], least)
        if not len(pairs):
            break
        if n + len(pairs) >= 1 << 16:
            seq = seq.astype(np.uint32)
        seq[at] = rule + n
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        if frequent is not None:
            mark = np.zeros(len(seq), bool)
            mark[frequent] = mark[at] = True
            mark = mark[stay]
            new = at - np.arange(len(at))  # one symbol went for every earlier replacement
            mark[np.maximum(new - 1, 0)] = True
            near = np.flatnonzero(mark[:-1])
        seq, first = seq[stay], np.r_[first[:-1][stay], False]
        rules.append(pairs)
        n += len(pairs)
    return seq, np.flatnonzero(first), np.concatenate(rules).astype(seq.dtype) if rules else np.zeros((0, 2), seq.dtype), alphabet


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion lengths of the nonterminals."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, "<u4")


class Grammar:
    """Expands symbols: by a table of all expansions, or, where that would be large, level by level."""

    def __init__(self, alphabet: np.ndarray, rules: np.ndarray):
        self.alphabet, self.rules, base = alphabet, rules, len(alphabet)
        self.lengths = _lengths(rules, base)
        self.table = None
        if self.lengths.sum(dtype=np.int64) <= TABLE_IDS:
            raw, parts = alphabet.tobytes(), []
            whole = lambda x: parts[x - base] if x >= base else raw[4 * x : 4 * x + 4]
            for a, b in rules.tolist():
                parts.append(whole(a) + whole(b))
            self.table = np.concatenate([alphabet, np.frombuffer(b"".join(parts), "<u4")])
            self.offsets = np.r_[np.arange(base), base + np.cumsum(np.r_[0, self.lengths.astype(np.int64)])].astype(np.int64)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        if self.table is None:
            base, seq = len(self.alphabet), seq.astype(np.int64)
            while (high := seq >= base).any():
                pair, ends = self.rules[seq[high] - base], np.cumsum(np.where(high, 2, 1))
                seq = np.repeat(seq, np.where(high, 2, 1))
                seq[ends[high] - 2], seq[ends[high] - 1] = pair[:, 0], pair[:, 1]
            return self.alphabet[seq]
        lengths = self.offsets[seq + np.int64(1)] - self.offsets[seq]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.table[np.repeat(self.offsets[seq] - (ends - lengths), lengths) + np.arange(total)]


def write_block(out: BinaryIO, doc_ids: list[int | None], texts_ids: list[np.ndarray]) -> None:
    sizes = np.array([len(x) for x in texts_ids], np.uint64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    seq, places, rules, alphabet = compress(np.concatenate(texts_ids), starts)
    out.write(HEAD.pack(MAGIC, seq.itemsize, len(doc_ids), len(rules), len(seq), len(alphabet)))
    out.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes())
    out.write(places.astype("<u8").tobytes() + sizes.astype("<u8").tobytes() + alphabet.tobytes() + rules.tobytes() + _lengths(rules, len(alphabet)).tobytes())
    out.write(seq.tobytes())


class Block:
    """One block of a file; ``document(i)`` expands that document alone."""

    def __init__(self, stream: BinaryIO, head: bytes):
        magic, width, n, n_rules, n_seq, base = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        take = lambda kind, k: np.frombuffer(stream.read(np.dtype(kind).itemsize * k), kind)
        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.places, self.sizes = take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        symbol, alphabet = f"<u{width}", take("<u4", base)
        self.grammar = Grammar(alphabet, take(symbol, 2 * n_rules).reshape(-1, 2))
        lengths = take("<u4", n_rules)
        self.seq = take(symbol, n_seq)
        if not np.array_equal(self.grammar.lengths, lengths):
            raise ValueError("expansion lengths do not agree with the rules")

    def document(self, i: int) -> np.ndarray:
        end = self.places[i + 1] if i + 1 < len(self.places) else len(self.seq)
        ids = self.grammar.expand(self.seq[self.places[i] : end])
        if len(ids) != self.sizes[i]:
            raise ValueError("a document's expansion has another length than stored")
        return ids

    def documents(self) -> list[np.ndarray]:
        """All documents of the block, expanded at once."""
        ids, ends = self.grammar.expand(self.seq), np.cumsum(self.sizes)
        if len(ids) != ends[-1]:
            raise ValueError("the documents' expansion has another length than stored")
        return np.split(ids, ends[:-1])


def blocks(stream: BinaryIO) -> Iterator[Block]:
    while head := stream.read(HEAD.size):
        yield Block(stream, head)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``TEXT_BYTES`` at least, none without rows: each different piece of a batch is looked up once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= TEXT_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Encodes and writes the documents in ascending order of their ids; returns (path, ids before it) for each file in this order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = ["doc_id", "_hash", "_row"]
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = word_cached(tokenizer), TaskContext.get().partitionId()
        path, some = f"{folder}/part-{part:05d}.ids", _gathered(batches)
        rows = next(some, None)
        if rows is None:
            return
        total = 0
        with replacing(path) as out:
            ids, held, size = [], [], 0
            while rows is not None:
                encoded, at = bpe.encode(rows.column("text"), END_ID)
                for d, x in zip(rows.column("doc_id").to_pylist(), np.split(encoded, at[1:-1]), strict=True):
                    ids.append(d)
                    held.append(x)
                    size += len(x)
                    if size >= BLOCK_IDS:
                        write_block(out, ids, held)
                        total += size
                        ids, held, size = [], [], 0
                rows = next(some, None)
            if ids:
                write_block(out, ids, held)
                total += size
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "ids": [total]})

    files = sorted(rows.mapInArrow(write, "part long, path string, ids long").collect())
    before = np.cumsum([0, *(f["ids"] for f in files)]).tolist()
    return [(f["path"], b) for f, b in zip(files, before, strict=False)]


def read_ids(spark: SparkSession, files: list[tuple[str, int]], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files; one task a file."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                system, at = open_fs(path)
                with system.open_input_stream(at) as stream:
                    for block in blocks(stream):
                        out: dict = {k: [] for k in schema.names}
                        for d, ids in zip(block.doc_ids, block.documents(), strict=True):
                            out["doc_id"].append(d)
                            out["start"].append(start)
                            out["n_tokens"].append(len(ids))
                            out["ids_crc32"].append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                            if with_ids:
                                out["ids"].append(ids.astype(np.int32))
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict(out, schema)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return one_task_each(spark, files, "path string, before long").mapInArrow(load, kind)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(spark, write_ids(read(spark, sf_dir, "documents"), shared_dir(spark, "ids"), str(public_tokenizers.path("byte_bpe_50k.json"))))


SQL: dict[str, str] = {}
