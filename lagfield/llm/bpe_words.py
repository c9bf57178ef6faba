"""Byte-level BPE of whole texts through the tokenizers library, with the ids of recurring words kept.

The pre-tokenizer never joins what lies on the two sides of a space or line feed between words, so texts are cut there, all of a call at once in Arrow:
each different piece of a call is looked up once, and its letters go to the library about once per worker. Texts for which this cut is not known to be
safe (longer runs of white space, characters outside Latin letters and punctuation, a special token's string) go to the library as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts to be kept whole, a line feed being put before each: those with other characters than those on which all Unicode versions and both regex engines
#: agree about letters, numbers and white space, or with three of white space together, or two at the end.
_SPACE = r"[\t-\r \x{a0}]"
WHOLE_RE2 = rf"[^\t-\r\x20-\x7e\x{{a0}}-\x{{24f}}\x{{2010}}-\x{{2027}}]|{_SPACE}{_SPACE}(?:{_SPACE}|\z)|\A{_SPACE}(?:{_SPACE}|\z)"
KEPT_WORDS, KEPT_BYTES, WORDS_A_CALL = 700_000, 1 << 27, 1 << 14
_MARKS = ".,;:!?%$&*#|()[]{}\"/-_+=<>@~^"


def _byte_letters() -> np.ndarray:
    """Code points of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return np.array([hidden.get(b, b) for b in range(256)], dtype="<u4")


def _texts(of: pa.Array) -> list[str]:
    return of.to_numpy(zero_copy_only=False).tolist()


class WordCachedBpe:
    """``encode(texts)`` gives the ids of an Arrow array of texts, ``encode_batch(texts)`` each text's as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words_only, self.letters_only = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.words_only.pre_tokenizer = pre_tokenizers.Split(chr(self.letters[10]), "isolated")
        self.letters_only.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(chr(self.letters[10]))
        # A letter of the byte-level alphabet is one byte.
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.whole_re2 = "|".join([WHOLE_RE2, *map(re.escape, self.special)])
        self.line = self.whole("\n")
        self.line_id = int(np.frombuffer(self.line, "<u4")[0])
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of letters, or a space and letters, which the pre-tokenizer leaves whole: many at a call, with line feeds between."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_A_CALL):
            joined = np.frombuffer("\n".join(words[at : at + WORDS_A_CALL]).encode(), np.uint8)
            letters = self.letters[joined].tobytes().decode("utf-32-le")
            ids = np.array(self.letters_only.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
            # A word ends with the token that ends at its last byte, line feeds left out.
            lines = np.flatnonzero(joined == 10)
            last, upto = np.r_[lines - np.arange(len(lines)), len(joined) - len(lines)], np.cumsum(self.sizes[ids])
            ends = np.searchsorted(upto, last)
            if ends[-1] >= len(upto) or not np.array_equal(upto[ends], last):
                raise ValueError("words and line feeds do not agree")
            raw, ends = ids.tobytes(), 4 * (ends + 1)
            out += map(raw.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))
        return out

    def _learn(self, names: list[str]) -> None:
        """Letters after a space or a line feed are encoded many at a call, other pieces one at a time."""
        kept, plain = self.kept, [n[1:].isalpha() for n in names]
        words = [n for n, x in zip(names, plain, strict=True) if x and n[0] != "\n"]
        lines = [n for n, x in zip(names, plain, strict=True) if x and n[0] == "\n"]
        kept.update(zip(words, self._plain(words), strict=True))
        kept.update(zip(lines, map(self.line.__add__, self._plain([n[1:] for n in lines])), strict=True))
        kept.update({n: self.whole(n) for n, x in zip(names, plain, strict=True) if not x})
        # A word's ids take about as many bytes as four of its letters each, at most.
        self.kept_bytes += 5 * sum(map(len, names))

    def _bound(self) -> None:
        if len(self.kept) > KEPT_WORDS or self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.tails.clear()
            self.kept_bytes = 0

    def _of(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces as bytes: a piece of letters and marks is the ids of both, one after the other, any other piece is kept as it is."""
        stems = pc.ascii_rtrim(pieces, _MARKS)
        plain = pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, 1))
        names = pc.if_else(plain, stems, pieces).dictionary_encode()
        texts = _texts(names.dictionary)
        found = list(map(self.kept.get, texts))
        gaps = [k for k, x in enumerate(found) if x is None]
        self._learn([texts[k] for k in gaps])
        for k in gaps:
            found[k] = self.kept[texts[k]]
        ids = pa.array(found, pa.large_binary()).take(names.indices)
        marked = pc.and_(plain, pc.less(pc.binary_length(stems), pc.binary_length(pieces)))
        if not pc.any(marked).as_py():
            return ids
        tails = pa.array([p[len(s) :] for p, s in zip(_texts(pieces.filter(marked)), _texts(stems.filter(marked)), strict=True)], pa.large_string()).dictionary_encode()
        for t in (kinds := _texts(tails.dictionary)):
            if t not in self.tails:
                self.tails[t] = self.whole(t)
                self.kept_bytes += 5 * len(t)
        which = np.zeros(len(pieces), np.int64)
        which[marked.to_numpy(zero_copy_only=False)] = tails.indices.to_numpy() + 1
        after = pa.array([b"", *map(self.tails.__getitem__, kinds)], pa.large_binary()).take(pa.array(which))
        return pc.binary_join_element_wise(ids, after, pa.scalar(b"", pa.large_binary()))

    def _cut(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """A line feed goes before each text; then every space and line feed begins a piece, and pieces lie in the joined bytes as they are."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        _, starts, data = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar("\n", pa.large_string())).buffers()
        starts = np.frombuffer(starts, np.int64, len(texts) + 1)
        raw = np.frombuffer(data, np.uint8, starts[-1])
        begin = np.flatnonzero((raw == 32) | (raw == 10))
        pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.r_[begin, len(raw)]), data).dictionary_encode()
        found = self._of(pieces.dictionary).take(pieces.indices)
        at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[np.searchsorted(begin, starts)] // 4
        ids = np.frombuffer(found.buffers()[2], "<u4", at[-1]).copy()
        if end is None:
            return np.delete(ids, at[:-1]), at - np.arange(len(at))
        # What comes after a text takes the place of the line feed before the next one.
        ids[at[:-1]] = end
        return np.r_[ids[1:], ids[:1]], at

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and where each text's begin (and the last's end). The id ``end``, if given, comes after each text's."""
        self._bound()
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, self.whole_re2)
        ids, at = self._cut(texts.filter(pc.invert(whole)), end)
        if not pc.any(whole).as_py():
            return ids, at
        after = b"" if end is None else np.array([end], "<u4").tobytes()
        cut = map(ids.__getitem__, map(slice, at[:-1].tolist(), at[1:].tolist()))
        others = (np.frombuffer(self.whole(t) + after, "<u4") for t in _texts(texts.filter(whole)))
        all_ids = [next(others) if w else next(cut) for w in whole.to_pylist()]
        return np.concatenate(all_ids), np.cumsum([0, *map(len, all_ids)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), (4 * at).tolist()
        return list(map(raw.__getitem__, map(slice, ends[:-1], ends[1:])))


_OF: dict[str, WordCachedBpe] = {}


def word_cached(path: str) -> WordCachedBpe:
    """One for each worker, whose known words later tasks find."""
    if path not in _OF:
        _OF[path] = WordCachedBpe(path)
    return _OF[path]
