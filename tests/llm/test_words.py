"""Operators on words and tokens (periodic runs, quality rules) against brute force, on odd and on empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lagfield.llm import alignment, fertility, periodic, words
from lagfield.llm.registry import queries

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def split(text):
    return (text or "").encode().split()


def brute_runs(w, least=12):
    """Maximal stretches for every period; of one stretch the least period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(r, most=90):
    n, kinds = r.randint(0, most), r.choice([1, 2, 3, 30])
    w = [b"%d" % r.randrange(kinds) for _ in range(n)]
    if r.random() < 0.5 and n > 5:
        i, p = r.randrange(n), r.randint(1, 9)
        w = w[:i] + [w[i + j % p] if i + j % p < n else b"z" for j in range(n - i)]
    return w


# 11 periodic runs


@pytest.mark.parametrize("least", [4, 12])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(150):
        docs = [random_words(r) for _ in range(r.randint(1, 6))]
        for d, got in zip(docs, periodic.runs_of(docs, least), strict=True):
            assert [tuple(map(int, x)) for x in got] == sorted(brute_runs(d, least), key=lambda x: (x[0], x[2]))


def test_only_words_in_repeated_grams_survive(monkeypatch):
    r = random.Random(1)
    plain = [b"%d" % i for i in range(500)]
    looped = plain[:200] + plain[100:200] + plain[100:200] + plain[300:]
    seen = []
    real = periodic.main_lorentz
    monkeypatch.setattr(periodic, "main_lorentz", lambda codes, seg, least: seen.append(int((seg[:, 1] - seg[:, 0]).sum())) or real(codes, seg, least))
    got = periodic.runs_of([plain, looped, random_words(r)[:3]])
    assert [len(g) for g in got] == [0, 1, 0] and seen == [300] and got[1].tolist() == [[100, 300, 100]]
    # Segments beyond TOGETHER go alone, with the same result.
    monkeypatch.setattr(periodic, "TOGETHER", 10)
    docs = [random_words(r) for _ in range(30)]
    assert [[tuple(x) for x in g] for g in periodic.runs_of(docs)] == [sorted(brute_runs(d), key=lambda x: (x[0], x[2])) for d in docs]


def test_colliding_hashes_change_no_run(monkeypatch):
    r = random.Random(2)
    docs = [random_words(r) for _ in range(40)]
    want = [g.tolist() for g in periodic.runs_of(docs)]
    monkeypatch.setattr(words, "window_hashes", lambda ids, k: np.zeros(max(0, len(ids) - k + 1), np.uint64))
    assert [g.tolist() for g in periodic.runs_of(docs)] == want


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def brute_op11(doc_id, text):
    w = split(text)
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = sorted(brute_runs(w), key=lambda x: (x[0], x[2]))
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, digest, hashlib.sha256(collapsed(w, runs)).hexdigest())


def test_op11_equals_brute_force(spark, texts):
    got = {tuple(r) for r in queries()["op11_periodic"](spark, SF).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == {brute_op11(d, t) for d, t in texts.items()}
    assert sum(r[1] > 0 for r in got) > 10


def test_periodic_runs_odd_rows(odd_docs, no_docs):
    out = {(r.doc_id, r.n_words, r.collapsed): [tuple(x) for x in r.runs] for r in periodic.periodic_runs(odd_docs.withColumn("runs", F.lit(1))).collect()}
    rows = odd_docs.collect()
    assert periodic.periodic_runs(odd_docs).count() == len(rows)
    assert {(r.doc_id, len(split(r.text)), b" ".join(split(r.text)).decode()) for r in rows} == set(out)
    assert periodic.periodic_runs(no_docs).isEmpty()


def test_a_long_text_of_one_word_and_unlike_spaces(spark):
    rows = [(1, " ".join(["a"] * 200_000)), (2, "x y " * 40), (3, ("b\x1cc\tb d\n" * 30).strip())]
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.n_words, r.collapsed) for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ([(0, 200_000, 1)], 200_000, "a") and got[2] == ([(0, 40, 1)], 40, "x y") and got[3] == ([(0, 90, 3)], 90, "b\x1cc b d")


def test_tails_keep_null_ids_and_texts(spark):
    ids = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows = [(None, "a b"), (ids[0], None), (ids[1], " \n "), (ids[2], "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", periodic.with_tails(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))))
    got = {r.doc_id: r.t for r in df.collect()}
    assert got[None] == "a b" and got[ids[0]] is None and got[ids[1]] == " \n " and len(got[ids[2]].split()) == 8


# 12 alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    raw_b = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("\u2581", " ").encode()
    return a, sp, lambda i: bytes(letters[c] for c in a.id_to_token(i)), raw_b


def intervals(ids, raw):
    at, out = 0, []
    for i in ids:
        n = len(raw(i))
        out.append((i, at, at + n))
        at += n
    return out


def brute_alignment(rows, libraries):
    """Every document's tokens by the libraries, all pairs of them compared."""
    a, sp, raw_a, raw_b = libraries
    parts, held, corpus = [], [], Counter()
    for _, text in rows:
        x = intervals(a.encode(" " + text, add_special_tokens=False).ids, raw_a) if text else []
        y = intervals(sp.encode(text), raw_b) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(raw_a(i) for i, _, _ in x) != whole or b"".join(raw_b(i) for i, _, _ in y) != whole:
            x, y = [], []
        links = []
        first = 0
        for i, s, e in x:
            while first < len(y) and y[first][2] <= s:
                first += 1
            k = first
            while k < len(y) and y[k][1] < e:
                links.append((i, y[k][0]))
                k += 1
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, s, t in x if low <= s and t <= e) + "|" + ",".join(str(i) for i, s, t in y if low <= s and t <= e))
            low = e
        parts.append((len(x), len(y), len(groups), len(links), ";".join(groups)))
        held.append(Counter(links))
        corpus.update(set(links))
    top = {}
    for (i, _), n in corpus.items():
        top[i] = max(n, top.get(i, 0))
    out = Counter()
    for (doc_id, _), (*counts, groups), links in zip(rows, parts, held, strict=True):
        best = sum(n for p, n in links.items() if corpus[p] == top[p[0]])
        out[(doc_id, *counts, groups, best, sum(n * corpus[p] for p, n in links.items()))] += 1
    return out, corpus, top


DOCUMENT = ["doc_id", *alignment.COUNTS, "groups", "n_best", "count_sum"]


def aligned(df):
    out, pairs = alignment.align(df, BPE, PIECES)
    return Counter(tuple(r[c] for c in DOCUMENT) for r in out.collect()), {(r.a, r.b): (r.documents, r.best) for r in pairs.collect()}


@pytest.mark.parametrize("block", [1 << 22, 2000])
def test_alignment_equals_brute_force(spark, odd_docs, libraries, texts, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    odd = ["a  b", " lead", "trail ", "x\n\ny", "\n", "tab\there", "a\u2581b", "it's we'll 'tis", "<|endoftext|> and </s> <0x41>", "世界 🙂 na\u0308ive", "e\u00a0f\u2003g", "A\x00B", "x \n y", "p\nq r\n\ns", "ÀÉ ɏɏ zz…", "don't\nstop", "1234 5678\n90", "\r\nq"]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 5000] + [(100 + k, t) for k, t in enumerate(odd)] + sorted(texts.items())[:25]
    got, pairs = aligned(spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, block long, at string"))
    want, corpus, top = brute_alignment(rows, libraries)
    assert got == want and pairs == {p: (n, n == top[p[0]]) for p, n in corpus.items()}


def test_op12_equals_brute_force(spark, texts, libraries):
    names = [*DOCUMENT[:5], "groups_sha256", *DOCUMENT[6:]]
    got = Counter(tuple(r[c] for c in names) for r in queries()["op12_alignment"](spark, SF).collect())
    want, _, _ = brute_alignment(sorted(texts.items()), libraries)
    assert got == Counter({(*k[:5], hashlib.sha256(k[5].encode()).hexdigest() if k[5] else "", *k[6:]): n for k, n in want.items()})


def test_alignment_of_empty_tables_and_forgotten_pieces(spark, no_docs, texts, libraries, monkeypatch):
    out, pairs = alignment.align(no_docs, BPE, PIECES)
    assert out.isEmpty() and pairs.isEmpty()
    of, some = alignment.Aligner(BPE, PIECES), [t or "" for _, t in sorted(texts.items())[:12]]
    want = of.block(some)["groups"]
    monkeypatch.setattr(alignment, "KEPT_PIECES", 5)
    assert [g for t in some for g in of.block([t])["groups"]] == want and of.block([])["groups"] == []


def test_alignment_takes_little_more_than_the_libraries():
    """A block of new pieces against the two libraries on its different words alone: 2.2 times their CPU time when each piece was handled in Python and joined in SQL."""
    r, ratios = random.Random(1), []
    for _ in range(4):
        many = ["".join(r.choices(["th", "er", "ou", "an", "st", "ei", "qu", "la", "ch", "ión"], k=r.randint(2, 5))) + r.choice(["", ".", ","]) for _ in range(40_000)]
        of, other = alignment.Aligner(BPE, PIECES), alignment.Aligner(BPE, PIECES)
        of.block([" ".join(many[:50])])
        at = [time.process_time()]
        other.a.encode_batch_fast([f" {w}" for w in sorted(set(many))], add_special_tokens=False), other.b.encode(sorted(set(many)), num_threads=1)
        at.append(time.process_time())
        of.block([" ".join(many[k : k + 200]) for k in range(0, len(many), 200)])
        at.append(time.process_time())
        ratios.append((at[2] - at[1]) / (at[1] - at[0]))
    assert min(ratios) < 1.7, ratios


def test_alignment_learns_letters_as_python_has_them(libraries):
    plain = [chr(c) for c in range(0x250) if re.fullmatch(f"[{alignment.PLAIN}]", chr(c))]
    assert pc.utf8_is_alpha(pa.array(plain)).to_pylist() == [c.isalpha() for c in plain]
    assert pc.match_substring_regex(pa.array([f" {c}" for c in map(chr, range(0x3000)) if c != "\0"]), alignment.PLAIN_PIECE_RE2).to_pylist() == [c in plain for c in map(chr, range(1, 0x3000))]
    rows = [(k, f"x{c}y a{c} {c} {c}{c}b\n{c}") for k, c in enumerate(plain)]
    want = {x[0]: x[5] for x in brute_alignment(rows, libraries)[0]}
    assert alignment.Aligner(BPE, PIECES).block([t for _, t in rows])["groups"] == [want[k] for k, _ in rows]


# 13 quality rules


def brute_rules(text):
    text = text or ""
    w = text.encode().split()
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeat = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_op13_base_rules_equal_brute_force(spark, texts):
    out = queries()["op13_fertility"](spark, SF).collect()
    assert {(r.doc_id, *(r[c] for c in BASE)) for r in out} == {(d, *brute_rules(t)) for d, t in texts.items()} and len(out) == len(texts)
    assert not any(r.kept and r.base_failed for r in out)


def brute_measures(text):
    """Words one by one through the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    sp, a = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    w = [x.decode() for x in split(text)]
    ids = [i for p in sp.encode(w) for i in p] if w else []
    n_a, chars, n = sum(len(a.encode(" " + x, add_special_tokens=False).ids) for x in w), sum(map(len, w)), len(ids)
    h = -sum(c / n * np.log2(c / n) for c in Counter(ids).values()) if n else 0.0
    return chars / n_a if n else 0.0, chars / n if n else 0.0, sum(map(sp.is_byte, ids)) / n if n else 0.0, h / np.log2(n) if n > 1 else 0.0


def test_measures_equal_the_libraries(spark, odd_docs, no_docs):
    out = fertility.measure(odd_docs.withColumn("n_words", F.lit("own")), BPE, PIECES).collect()
    rows = odd_docs.collect()
    want = sorted((str(r.doc_id), *brute_rules(r.text)[:5], *(round(x, 9) for x in brute_measures(r.text))) for r in rows)
    got = sorted((str(r.doc_id), *(r[c] for c in BASE[:5]), *(round(x, 9) for x in (r.chars_per_token_a, r.chars_per_token_b, r.byte_share, r.entropy))) for r in out)
    assert got == want
    assert {r.lang for r in out if r.doc_id in (5, 6, 14)} == {None, "en", "script LATIN"}
    assert fertility.measure(no_docs, BPE, PIECES).isEmpty() and fertility.quality_rules(no_docs, BPE, PIECES).isEmpty()
    kept = fertility.quality_rules(odd_docs, BPE, PIECES)
    assert kept.count() == len(rows) and kept.where("kept = base_failed").isEmpty()


def test_forgotten_words_change_no_measure(monkeypatch, texts):
    import pyarrow as pa

    some = [t or "" for t in list(texts.values())[:60]]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array([None] * len(t), pa.string()), pa.array([b""] * len(t)), pa.array(t)], ["doc_id", "lang", "key", "text"])
    want = fertility._measured_batch(batch(some), fertility.Vocabularies(BPE, PIECES)).to_pylist()
    monkeypatch.setattr(fertility, "KEPT_WORDS", 50)
    v = fertility.Vocabularies(BPE, PIECES)
    got = [r for i in range(0, 60, 7) for r in fertility._measured_batch(batch(some[i : i + 7]), v).to_pylist()]
    assert [{k: x for k, x in r.items() if k != "doc_id"} for r in got] == [{k: x for k, x in r.items() if k != "doc_id"} for r in want]


def test_bands_reject_odd_texts_and_copies_do_not_move_them(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choice(["the", "an", "er", "ing", "ed", "on", "at", "th"]) for _ in range(r.randint(1, 3))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [(i, prose(r.randint(60, 300)), "en") for i in range(300)]
    odd = [(1000 + i, " ".join(f"{w}##$$%%" for w in prose(120).split()), "en") for i in range(5)] + [(1100 + i, " ".join("".join(chr(0x1F300 + r.randrange(200)) for _ in range(4)) for _ in range(80)), "en") for i in range(5)]
    copies = [(2000 + i, odd[0][1], "en") for i in range(400)]
    few = [(5000, odd[0][1], "xx")]
    got = {x.doc_id: x.kept for x in fertility.quality_rules(spark.createDataFrame(clean + odd + copies + few, "doc_id long, text string, lang string"), BPE, PIECES).collect()}
    assert sum(got[d] for d, _, _ in clean) >= 297 and not any(got[d] for d, _, _ in odd + copies) and got[5000]


def test_op13_keeps_good_labels(spark):
    """On labelled documents beyond the base rules: nearly all good ones stay, a part of the bad ones goes."""
    sf = "/root/testdata/sf0.01"
    got = queries()["op13_fertility"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.98 and share[0] < 0.85
