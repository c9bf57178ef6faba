"""Corpus operators against brute force, exact round trips and held-out labels, on odd and on empty tables."""

import hashlib
import io
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lagfield.llm import bpe_words, common, components, exact_dedup, minhash, mixing, quality, repair_ids, sentencepiece_codec, shingles, token_counts, topk, url_filter, warc
from lagfield.llm.bpe_words import WordCachedBpe
from lagfield.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries()[name](spark, SF).toPandas(), c.sql(oracle_sql()[name]).df()
    order = lambda d: d[sorted(d.columns)].astype(str).replace({"<NA>": "None", "nan": "None"}).pipe(lambda x: x.apply(lambda s: s.str.removesuffix(".0"))).sort_values(sorted(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# 1 quality


def test_quality_held_out_accuracy(spark):
    got = queries()["op1_quality"](spark, "/root/testdata/sf0.01").toPandas()
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    j = got.merge(y, on="doc_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())
    h = j[j.held_out]
    good, bad = h.score[h.quality == 1].to_numpy(), h.score[h.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.93 and (h.predicted == h.quality).mean() > 0.92 and got.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~quality.held_out())
    out = odd_docs.withColumn("score", quality.score_column(spark, model))
    assert out.count() == 16 and out.where("score IS NULL OR score < 0 OR score > 1").isEmpty() and len({r.score for r in out.where("text IS NULL OR text = ''").collect()}) == 1
    assert no_docs.withColumn("score", quality.score_column(spark, model)).isEmpty()
    assert quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), F.lit(True)).constant == 1.0
    assert quality.fit(no_docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True)).constant == 0.5


# 2 exact dedup


def brute_exact(rows, best):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(d)
    out = Counter()
    for d, t in rows:
        n = (t or "").translate(LOW)
        ids = [x for x in groups[n] if x is not None]
        keep = best(ids) if ids else None
        out[d, keep, len(groups[n]), d is not None and d == keep, hashlib.sha256(n.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_odd_rows(odd_docs, no_docs, keep):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(exact_dedup.exact_dedup(odd_docs, keep=keep)) == brute_exact(rows, min if keep == "min" else max)
    assert exact_dedup.exact_dedup(no_docs).isEmpty()


def test_exact_dedup_tells_hash_collisions_apart(odd_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lpad(F.hex(F.length(c) % 3), 32, "0"))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(exact_dedup.exact_dedup(odd_docs, keep="max")) == brute_exact(rows, max)


def test_exact_stage_tells_hash_collisions_apart(odd_docs, spark, monkeypatch):
    want = {}
    for i, t in ((r.doc_id, (r.text or "").translate(LOW)) for r in odd_docs.collect()):
        want[t] = max(want.get(t, (False, 0)), (i is not None, i or 0))
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lpad(F.hex(F.length(c) % 3), 32, "0"))
    got = exact_dedup.stage(spark, odd_docs, SF)
    assert got.columns == odd_docs.columns
    assert Counter((r.text or "").translate(LOW) for r in got.collect()) == Counter(list(want))
    assert {((r.text or "").translate(LOW)): (r.doc_id is not None, r.doc_id or 0) for r in got.collect()} == want


def test_bit_tables_lose_no_wanted_key(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id"), F.concat(F.lit("k"), F.col("id")).alias("word"), F.lit(1).alias("maybe"))
    wanted = rows.where("id % 100 = 7").select(F.col("word").alias("w"))
    for bits in (20, 2):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        out, flag = common.maybe_among(rows, F.col("word"), wanted, F.col("w"))
        got = {r.id for r in out.where(F.col(flag)).collect()}
        assert out.drop(flag).columns == rows.columns and got >= set(range(7, 20_000, 100)) and (bits == 2 or len(got) < 250)
        assert "Exchange hash" not in out.where(F.col(flag))._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    out, flag = common.maybe_among(rows, F.col("word"), wanted.where("false"), F.col("w"))
    assert out.where(F.col(flag)).isEmpty()


def test_hot_keys_are_attached_whole(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    out = common.attach_by_key(rows, groups, "key", "n", 5000, ["id"])
    assert out.count() == 5000 and out.where("n IS NULL").isEmpty() and out.where("key = 'hot' AND n <> 1667").isEmpty()


# 3 WARC


def test_a_url_and_a_header_of_any_length_pass(spark, tmp_path):
    url = "http://a/" + "é/x y" * 4_000_000
    pages = spark.createDataFrame([(1, url, "p" * 300_000), (2, "u", "q")], "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path))).orderBy("page_id").collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in got] == [(1, 300_000, "response"), (2, 1, "response")]
    for piece in (1, 2, 3, 5, 1000):
        source = warc._Inflated(io.BytesIO(b""))
        data = b"ab\r\ncd\r\n\r\r\n\r\nrest" * 3
        left = [data[i : i + piece] for i in range(0, len(data), piece)]

        def more(source=source, left=left):
            source.data += left.pop(0) if left else b""
            return bool(source.data)

        source.more = more
        assert source.until(b"\r\n\r\n") == b"ab\r\ncd\r\n\r" and (source.data + b"".join(left)).startswith(b"rest")


def test_warc_odd_pages(spark):
    big = "x" * 700_000
    rows = [(1, None, None), (2, "http://a/ b", ""), (3, "u", big), (4, "u", big), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (0, "é\n", "é" * 60), (9, "u", "é" * 60), (9, "u", "é" * 60)]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, digest int")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages, common.shared_dir(spark, "t"))).collect())
    n = len(big)
    assert got == Counter([(1, 0, "response", None), (2, 0, "response", None), (3, n, "response", None), (4, n, "revisit", 3), (None, n, "revisit", 3), (5, 5, "response", None), (6, 5, "response", None), (0, 120, "response", None), (9, 120, "revisit", 0), (9, 120, "revisit", 0)])
    assert warc.read_archives(spark, warc.write_archives(pages.where("false"), common.shared_dir(spark, "t"))).isEmpty()


def test_warc_reader_refuses_broken_archives():
    one = warc.record_bytes(1, "http://a/", b"p" * 5000, hashlib.sha256(b"p" * 5000).hexdigest(), "response", None)
    assert [r["page_id"] for r in warc.read_warc(io.BytesIO(one * 3))] == [1, 1, 1]
    wrong = warc.record_bytes(1, "http://a/", b"p" * 5000, "0" * 64, "response", None)
    for raw in (one[:-20], wrong, one[:30] + b"\0\0\0" + one[33:]):
        with pytest.raises(ValueError):
            list(warc.read_warc(io.BytesIO(raw)))


# 4 SentencePiece

ALPHABET = ["a", "the", "B", "é", " ", "  ", "\n", "\t", "1", "23", ".", "'s", "▁", "世", "\x1c", "\xa0", "—", "x ", "\r\n", "ﬁ", "😀", "ing", "    ", "<|endoftext|>"]


def odd_texts(n):
    r = random.Random(6)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_sentencepiece_is_the_librarys(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    c = sentencepiece_codec.TrieCodec.from_model(sentencepiece_codec.default_model())
    some = [*texts.values(), *odd_texts(3000)]
    for t, raw in zip(some, c.encode_batch(some), strict=True):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == sp.encode(t) and c.decode(ids) == t.replace("▁", " ")


def test_unigram_scores_take_the_best_path():
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.5), ("b", -1.4), ("ab", -2.0), ("▁a", -2.2), ("ba", -3.5), ("▁ab", -9.0)]
    c = sentencepiece_codec.TrieCodec(pieces, list(range(1, 8)), [0] * 256, "unigram")

    def best(word):
        if not word:
            return 0.0, []
        return max(((s + best(word[len(p) :])[0], [p, *best(word[len(p) :])[1]]) for p, s in pieces[1:] if word.startswith(p)), key=lambda x: x[0])

    words = ["▁" + w for w in ("a", "ab", "aba", "abab", "bba", "baab")]
    c.learn(words)
    for w in words:
        assert [pieces[i][0] for i in np.frombuffer(c.kept[w], "<i4")] == best(w)[1]


def test_sentencepiece_odd_rows(odd_docs, no_docs):
    model = sentencepiece_codec.default_model()
    out = sentencepiece_codec.encode(odd_docs, model)
    rows = out.collect()
    assert len(rows) == 16 and all(r.round_trip or r.doc_id == 12 for r in rows) and {r.n_tokens for r in rows if r.doc_id in (5, 6)} == {0}
    assert sentencepiece_codec.decode(out, model).where("doc_id = 13").first().decoded == "<|endoftext|> x"
    assert sentencepiece_codec.encode(no_docs, model).isEmpty()


def test_sentencepiece_unspaced_runs_take_linear_memory():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    c = sentencepiece_codec.TrieCodec.from_model(sentencepiece_codec.default_model())
    r = random.Random(9)
    run = "".join(r.choice(["the", "ing", "ab", "世", "é", "q", "12", "tion", "\U0001f9ff"]) for _ in range(100_000))[:200_000]
    c.encode_batch(["warm up"])
    peaks = []
    for text in (run[:2000], run[:8000], run):
        tracemalloc.start()
        (raw,) = c.encode_batch([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        # A quadratic path shows at 8,000 characters, before the long run would take gigabytes.
        assert peaks[-1] < 400 * len(text) + 2_000_000
        assert np.frombuffer(raw, "<i4").tolist() == sp.encode(text)


def test_sentencepiece_known_words_are_bounded_in_bytes(monkeypatch):
    c = sentencepiece_codec.TrieCodec.from_model(sentencepiece_codec.default_model())
    monkeypatch.setattr(sentencepiece_codec, "KEPT_BYTES", 100_000)
    for k in range(20):
        c.encode_batch([f"{k}x" * 10_000])
    assert sum(map(len, c.kept.values())) < 400_000


# 5 mixing


def fair_targets(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = (total - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > epochs * sizes[s]}
        if not full:
            return out | {s: share * w[s] for s in open_}
        out |= {s: float(epochs * sizes[s]) for s in full}
        open_ -= full
    return out


def test_mixing_targets_and_taken(spark):
    r = random.Random(2)
    rows = [(i, "x " * r.randint(0, 60), r.choice(["a", "b", "B", "é", None, "hot", "hot", "hot", "hot"])) for i in range(3000)] + [(3000, "y " * 5, "tiny"), (3001, None, "void")]
    docs = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, source string, size int, target double")
    got = mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    src = {i: s for i, _, s in rows}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = fair_targets(sizes)
    got["source"] = got.doc_id.map(src)
    for s, g in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert np.allclose(g.target, want[s]) and (g.source_size == sizes[s]).all() and abs(g.taken.sum() - want[s]) <= 60
    assert (got.taken <= 3 * got["size"]).all() and got.taken.sum() <= sum(sizes.values())
    again = mixing.mix(docs.repartition(5)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (again.taken == got.taken).all()


def test_mixing_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == 16 and mixing.mix(no_docs).isEmpty()
    assert rows_of(mixing.mix(odd_docs.where("text IS NULL OR text = ''")).select("size", "taken")) == Counter({(0, 0): 2})


# 6 top-k


def test_topk_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 24)).astype("f4")
    v[5] = v[6] = v[7]
    rows = [(i, [float(x) for x in r], i) for i, r in enumerate(v)] + [(900, None, 1), (901, [1.0] * 23 + [None], 1), (902, [float("nan")] * 24, 1), (903, [float("inf")] * 24, 1), (904, [1.0, 2.0], 1), (10, [0.1] * 24, 1), (950, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.exact_topk(df.where("vec_id % 50 = 0"), df.select("vec_id", "embedding", "score"), 5).collect()
    ok = [(i, np.floor(256 * np.array(x, "f4").astype(float))) for i, x, _ in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = set()
    for i, q in ok:
        if i % 50 == 0:
            best = sorted(((-int(q @ c), j) for j, c in ok if j != i and len(c) == len(q)))[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert topk.exact_topk(df.where("false"), df, 5).isEmpty() and topk.exact_topk(df, df.where("false"), 5).isEmpty()


def test_topk_block_prunes_exactly():
    rng = np.random.default_rng(0)
    q, c = np.floor(rng.normal(size=(9, 64)) * 50), np.floor(rng.normal(size=(500, 64)) * rng.gamma(0.5, 60, (500, 1)))
    a, b, s = topk.block_topk(np.arange(9) + 10_000, q, np.arange(500), c, 4)
    for i in range(9):
        want = sorted((-x, j) for j, x in enumerate(q[i] @ c.T))[:4]
        assert [(-x, j) for x, j in zip(s[a == i], b[a == i], strict=True)] == want
    big = np.full((2, 3), 2.0**40)
    assert topk.block_topk(np.array([1, 2]), big, np.array([3]), np.array([[1.0, 2.0, 3.0]]) * 2**20, 2)[2].tolist() == [6 * 2**60] * 2


def test_topk_bounds_save_work():
    """On the vectors of sf0.1 the second half of the dimensions costs under half of all its products."""
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.floor(256.0 * np.array([r[1] for r in rows], float))
    asks, work = ids % 50 == 0, np.zeros(v.shape[1] // topk.STEP, np.int64)
    a, b, s = topk.block_topk(ids[asks], v[asks], ids, v, 5, work)
    share = work / (asks.sum() * len(ids) * topk.STEP)
    assert share[0] == 1 and share[len(share) // 2 :].mean() < 0.25
    exact = v[asks] @ v.T
    exact[ids[asks][:, None] == ids] = -np.inf
    for i in range(asks.sum()):
        assert [(-x, ids[j]) for x, j in zip(s[a == i], b[a == i], strict=True)] == sorted(zip(-exact[i], ids))[:5]


def test_topk_repeated_ids_and_huge_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 60)] + [(0, [1.0] * 8), (0, [1.0] * 8), (0, [-1.0] * 8), (50, [3e38] + [0.0] * 7), (61, [-3e38] * 8), (62, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(tuple(r) for r in topk.exact_topk(df.where("vec_id % 50 = 0"), df, 5).collect())
    v = [(i, [int(x) for x in np.floor(256.0 * np.array(x, "f4").astype(float))]) for i, x in rows]
    want = Counter()
    for i, q in v:
        if i % 50 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, c)), -(2**63)), 2**63 - 1), j) for j, c in v if j != i)[:5]
            want.update((i, r + 1, j, -x) for r, (x, j) in enumerate(scores))
    assert got == want


# 7 rollups


def test_token_counts_equal_brute_force(spark, texts):
    t = Tokenizer.from_file(BPE)
    want = Counter()
    for d, s, lang in duckdb.sql(f"select doc_id, source, lang from '{SF}/documents.parquet'").fetchall():
        want[s, lang] += len(t.encode(texts[d], add_special_tokens=False).ids)
    got = queries()["op7_token_counts"](spark, SF).collect()
    assert {(r.source, r.lang): r.tokens for r in got} == dict(want) and sum(r.documents for r in got) == len(texts)


def test_rollup_batches(spark):
    schema = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long, extra int"
    make = lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    c = token_counts.TokenCounts(spark, common.shared_dir(spark, "t"))
    assert c.totals().isEmpty()
    first = make(("insert", "a", None, "v1", 10, None), ("insert", "a", None, "v1", 10, None), ("insert", None, "en", "v1", None, None))
    assert c.apply("one", first) and not c.apply("one", first)
    c.apply("two", make(("revise", "a", None, "v1", 7, 10), ("delete", "a", None, "v1", 10, None)))
    c.apply("none", first.where("false"))
    want = Counter({("a", None, "v1", 1, 7): 1, (None, "en", "v1", 1, 0): 1})
    assert rows_of(c.totals()) == want
    c.compact()
    assert rows_of(c.totals()) == want and not c.apply("two", first) and sorted(r.batch for r in c.committed().collect()) == ["none", "one", "two"]
    c.apply("three", make(("delete", "a", None, "v1", 7, None)))
    c.compact()
    assert rows_of(c.totals()) == Counter({("a", None, "v1", 0, 0): 1, (None, "en", "v1", 1, 0): 1})
    with pytest.raises(Exception, match="unknown kind"):
        c.apply("bad", make(("merge", "a", "b", "c", 1, 1)))


@pytest.fixture
def rollup(spark):
    """A rollup of two batches, one of them folded, and a way to send more."""
    c = token_counts.TokenCounts(spark, common.shared_dir(spark, "t"))
    send = lambda of, name, n: of.apply(name, spark.createDataFrame([("insert", "a", "en", "v", n, None)], "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"))
    send(c, "b1", 1)
    c.compact()
    send(c, "b2", 10)
    return c, token_counts.TokenCounts(spark, c.folder), send


def state_of(c):
    return [(r.documents, r.tokens) for r in c.totals().collect()], sorted(r.batch for r in c.committed().collect())


def test_two_compactions_at_once_lose_no_batch(rollup, monkeypatch):
    """A folds b1 and b2; before it publishes, b3 comes in and B folds and publishes all three; A loses, and begins again."""
    a, b, send = rollup
    real, begun = token_counts.TokenCounts._fold, []

    def between(self, fold, batches):
        table = real(self, fold, batches)
        begun.append([x for x, _ in batches])
        if self is a and len(begun) == 1:
            send(b, "b3", 100)
            b.compact()
            b.clean()
        return table

    monkeypatch.setattr(token_counts.TokenCounts, "_fold", between)
    a.compact()
    assert begun == [["b2"], ["b2", "b3"]] and state_of(a) == state_of(b) == ([(3, 111)], ["b1", "b2", "b3"])
    send(a, "b4", 1000)
    a.compact()
    a.clean()
    assert state_of(b) == ([(4, 1111)], ["b1", "b2", "b3", "b4"]) and len(a._names("tables")) == 1


@pytest.mark.parametrize("after", ["totals", "ids", "all"])
def test_a_compaction_that_dies_changes_nothing(rollup, monkeypatch, spark, after):
    a, b, send = rollup
    real = token_counts.TokenCounts._fold

    def dies(self, fold, batches):
        if after == "totals":
            self._sum(fold, batches).write.parquet(f"{self.folder}/tables/fold-dead/totals")
        elif after == "ids":
            self._ids(fold).write.parquet(f"{self.folder}/tables/fold-dead/batches")
        else:
            real(self, fold, batches)
        raise KeyboardInterrupt

    monkeypatch.setattr(token_counts.TokenCounts, "_fold", dies)
    with pytest.raises(KeyboardInterrupt):
        a.compact()
    monkeypatch.undo()
    assert state_of(b) == ([(2, 11)], ["b1", "b2"])
    b.compact()
    assert state_of(b) == ([(2, 11)], ["b1", "b2"]) and not send(a, "b2", 10)
    b.clean()
    assert state_of(a) == ([(2, 11)], ["b1", "b2"]) and len(a._names("tables")) == 1


def test_one_of_two_writers_of_a_batch_commits(rollup, monkeypatch):
    a, b, send = rollup
    real, won = token_counts.create_new, []

    def later(spark, path, text):
        if path.endswith("batch-b5") and not won:
            won.append(True)
            assert send(b, "b5", 5)
        return real(spark, path, text)

    monkeypatch.setattr(token_counts, "create_new", later)
    assert not send(a, "b5", 5) and state_of(a) == ([(3, 16)], ["b1", "b2", "b5"])


# 8 token ids


def test_word_cached_bpe_is_the_librarys(texts):
    b = WordCachedBpe(BPE)
    some = [*texts.values(), *odd_texts(4000), "a" * 5000, "\n\n\nx", " lead", "trail \n"]
    assert all(raw == b.whole(t) for t, raw in zip(some, b.encode_batch(some), strict=True))


def test_word_cached_bpe_with_few_kept_words_and_short_calls(texts, monkeypatch):
    monkeypatch.setattr(bpe_words, "KEPT_WORDS", 40)
    monkeypatch.setattr(bpe_words, "WORDS_A_CALL", 3)
    b = WordCachedBpe(BPE)
    odd = ["", "a", "\n", "\na", "a\nb", "one, one one,\none,", "(x) x) x", "a\n\nb", "é é, é", "!? !?", "a  b", "x" * 5000 + "."]
    some = odd + [t or "" for t in list(texts.values())[:60]]
    for k in (1, 7):
        for i in range(0, len(some), k):
            assert b.encode_batch(some[i : i + k]) == [b.whole(t) for t in some[i : i + k]]
    assert b.encode_batch([]) == []


def test_word_cached_bpe_looks_each_piece_of_a_call_up_once(texts):
    """The check's 412 CPU seconds a GB were mostly look-ups of every word of every text."""

    class Counted(dict):
        looked_up = 0

        def get(self, *of):
            self.looked_up += 1
            return super().get(*of)

    b = WordCachedBpe(BPE)
    b.kept = Counted()
    some = ["one two, two one\none (two) two!"] * 3000
    assert b.encode_batch(some) == [b.whole(some[0])] * 3000 and b.kept.looked_up <= 6


def test_word_cached_bpe_in_arrays_with_an_end(texts):
    b, t = WordCachedBpe(BPE), Tokenizer.from_file(BPE)
    white = ["".join(x) for n in range(5) for x in itertools.product(" \na\t\xa0", repeat=n)]
    for some in (white, [*odd_texts(500), "<|endoftext|>", "a <|endoftext|> b", "", *texts.values()], ["", ""], ["日本 語"], []):
        some = [x or "" for x in some]
        want = [t.encode(x, add_special_tokens=False).ids for x in some]
        for end in (None, 2):
            ids, at = b.encode(pa.array(some, pa.string()), end)
            assert [x.tolist() for x in (ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True))] == [w + [end] * (end is not None) for w in want] and at[0] == 0 and at[-1] == len(ids)
    assert b.encode(pa.array(["x"] * 3 + ["y z"]).slice(2))[1].tolist() == [0, 1, 3]


def test_token_ids_files(spark, odd_docs, no_docs):
    got = repair_ids.read_ids(spark, repair_ids.write_ids(odd_docs, common.shared_dir(spark, "t"), BPE), with_ids=True).toPandas().sort_values("start")
    t, start = Tokenizer.from_file(BPE), 0
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in odd_docs.collect())
    assert len(got) == len(rows)
    for (d, text), r in zip(rows, got.itertuples(), strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (-1 if pd.isna(r.doc_id) else r.doc_id, r.start, r.n_tokens, r.ids_crc32) and list(r.ids) == ids
        start += len(ids)
    assert repair_ids.read_ids(spark, repair_ids.write_ids(no_docs, common.shared_dir(spark, "t"), BPE)).isEmpty()


@pytest.mark.parametrize("n,kinds", [(1, 5), (2, 1), (50, 3), (5000, 10), (5000, 100_000)])
def test_grammar_round_trip_and_random_access(n, kinds):
    rng = np.random.default_rng(n)
    docs = np.split(rng.integers(0, kinds, n).astype(np.uint32), sorted(rng.integers(1, n + 1, 4)))
    docs = [d for d in docs if len(d)]
    out = io.BytesIO()
    repair_ids.write_block(out, list(range(len(docs))), docs)
    out.seek(0)
    (block,) = repair_ids.blocks(out)
    for i in reversed(range(len(docs))):
        assert (block.document(i) == docs[i]).all()
    assert all((a == b).all() for a, b in zip(block.documents(), docs, strict=True))


def test_grammar_is_not_cut_short(texts, monkeypatch):
    """No pair of neighbours in a document is left that occurs LEAST times, whatever overlaps; rules are older than what uses them."""
    bpe = WordCachedBpe(BPE)
    prose = [np.frombuffer(x, "<u4") for x in bpe.encode_batch([t for t in texts.values() if t])]
    rng = np.random.default_rng(4)
    runs = [np.full(3000, 7, np.uint32), np.tile(np.array([1, 2, 1, 2, 2], np.uint32), 400), np.tile(rng.integers(0, 9, 700).astype(np.uint32), 9), rng.integers(0, 4, 5000).astype(np.uint32)]
    for docs in (prose, runs, [np.arange(70_000, dtype=np.uint32), np.tile(np.arange(65_000, 65_500, dtype=np.uint32), 20)]):
        sizes = [len(d) for d in docs]
        seq, places, rules, alphabet = repair_ids.compress(np.concatenate(docs), np.r_[0, np.cumsum(sizes)[:-1]])
        left = Counter()
        for part in np.split(seq, places[1:]):
            left.update(zip(part[:-1].tolist(), part[1:].tolist(), strict=True))
        assert max(left.values(), default=0) < repair_ids.LEAST and len(seq) < sum(sizes)
        assert all(max(r) < len(alphabet) + k for k, r in enumerate(rules.tolist()))
        by_table = repair_ids.Grammar(alphabet, rules).expand(seq)
        with monkeypatch.context() as m:
            m.setattr(repair_ids, "TABLE_IDS", 0)
            assert (by_table == np.concatenate(docs)).all() and (repair_ids.Grammar(alphabet, rules).expand(seq) == by_table).all()


def test_token_ids_of_a_repeated_id_are_split_and_ordered(spark):
    rows = [(5, f"text number {k % 40} of one id") for k in range(2000)] + [(None, "none"), (4, "before"), (6, "after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for parts in (8, 3):
        files = repair_ids.write_ids(docs.repartition(parts), common.shared_dir(spark, "t"), BPE)
        got = sorted(repair_ids.read_ids(spark, files).collect(), key=lambda r: r.start)
        out.append([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got])
        assert len(files) > 4 and [r[0] for r in out[-1]] == [None, 4, *[5] * 2000, 6]
    assert out[0] == out[1]


# 9 URLs


def test_urls_brute_force(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.b.c", ""), ("allow", "b.c", "/long/path?"), ("allow", "b.c", "/long"), ("block", "tie.org", "/x"), ("allow", "tie.org", "/x")]
    urls = [None, "", "no scheme", "http://NET/", "http://x.net", "ftp://www.Example.net:80/en/1?q#f", "http://www.example.net/en/1?q", "http://example.net/EN/", "http://a.b.c", "x://z.a.b.c/long/path", "http://b.c/longer", "http://ab.c/long", "http://tie.org/xyz", "http://://net/", "http://" + "d." * 500 + "net/", "http://net/" + "p/" * 3000, "http://net/#a", "http://net?x"]
    rows = [(i, u, i) for i, u in enumerate(urls)] + [(3, urls[3], 0), (None, urls[3], 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")

    def judge(u):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOW)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        return host, path, best[3], best[4]

    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for limit in (50_000, 0):
        url_filter.BROADCAST_RULES = limit
        assert rows_of(url_filter.filter_urls(pages, table)) == Counter((i, *judge(u)) for i, u, _ in rows)
    url_filter.BROADCAST_RULES = 50_000
    assert url_filter.filter_urls(pages.where("false"), table).isEmpty()
    assert url_filter.filter_urls(pages, table.where("false")).where("verdict <> 'allow' OR rule IS NOT NULL").isEmpty()


# 10 MinHash


def brute_near(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_of_the_table(spark, texts):
    got = queries()["op10_minhash"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(texts.items()) and all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_duplicates_chains_and_near_misses(spark, monkeypatch, hot):
    """Chains of copies of copies around the threshold: stars alone lose links, blocks are forced to be small, buckets to be divided."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "HOT_ROWS", hot)
    r, rows, n = random.Random(8), [], 0
    for family in range(6):
        text = [f"f{family}w{r.randint(0, 300)}" for _ in range(r.choice([12, 60, 150]))]
        for _ in range(40):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text) if r.random() < 0.7 else rows[r.randrange(len(rows) - 1) if len(rows) > 1 else 0][1].split()
            for _ in range(max(1, len(text) // 70)):
                text[r.randrange(len(text))] = f"new{r.randint(0, 9999)}"
    r.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_near(rows)


def _comparisons(inside):
    """Sketches that are compared in the blocks of step 4."""
    one = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    sums = inside.groupBy("bucket").agg(one("outside AND first").alias("a"), one("outside AND NOT first").alias("b"), one("true").alias("m"), one("first").alias("k"))
    return sums.agg(F.sum(F.col("a") * F.col("m") + F.col("b") * F.col("k"))).first()[0] or 0


@pytest.mark.parametrize(("percent", "own"), [(85, 22), (85, 18), (80, 26)])
def test_texts_that_share_a_passage_hardly_meet(spark, monkeypatch, percent, own):
    """1,200 texts of one passage and some words of their own, just below the threshold, and 30 real near copies of one of them."""
    monkeypatch.setattr(minhash, "HOT_ROWS", 100)
    r = random.Random(own)
    passage = [f"p{i}" for i in range(182)]
    rows = [(i, " ".join(passage + [f"w{i}x{r.randint(0, 10**9)}" for _ in range(own)])) for i in range(1200)]
    near = rows[7][1].split()
    for k in range(30):
        rows.append((5000 + k, " ".join([*near[:-3], f"n{k}", f"m{k}"])))
    seen = {}
    real = common.Scratch.written

    def keep(self, df, name):
        seen[name] = out = real(self, df, name)
        if name == "inside":
            seen["comparisons"] = _comparisons(out)
        return out

    monkeypatch.setattr(common.Scratch, "written", keep)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    some = rows[:60] + rows[1200:]
    assert {i: got[i] for i, _ in some} == {i: c for i, (_, c) in brute_near(some, percent).items()} and sum(got[i] == i for i, _ in rows) == 1200
    assert "hot-nodes" in seen and seen["comparisons"] < 50 * len(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_of_short_texts(spark, monkeypatch, percent):
    """Sets too small for the threshold meet in no bucket; the smallest that can reach it are found."""
    assert minhash.least_size(80) == 4 and minhash.least_size(85) == 6 and minhash.least_size(50) == 1 and minhash.least_size(90) == 9
    words = [[f"s{k}w{j}" for j in range(14)] for k in range(3)]
    rows = [(i, f"short {i} text") for i in range(3000)]
    rows += [(5000 + 20 * k + n, " ".join(w[:n])) for k, w in enumerate(words) for n in range(5, 15)]
    rows_of_step = {}
    real = common.Scratch.written

    def keep(self, df, name):
        out = real(self, df, name)
        rows_of_step[name] = out.where("n < 4").count() if name == "members" else out.count()
        return out

    monkeypatch.setattr(common.Scratch, "written", keep)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_near(rows, percent)
    assert rows_of_step["members"] == 0 and rows_of_step["possible"] < 100


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 16 and by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[15].component_id == 14 and by[10].component_id == 9
    assert by[5].n_shingles == by[6].n_shingles == by[8].n_shingles == 0 and all(by[i].kept for i in (5, 6, 8)) and by[None].component_id is None and not by[None].kept
    assert minhash.near_duplicates(no_docs).isEmpty()


def test_long_text_shingles_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(1)
    text = " ".join(f"w{r.randint(0, 99999)}" for _ in range(3000)).encode()
    whole = shingles.word_hashes([text, b"", b"x"])[0]
    monkeypatch.setattr(shingles, "BLOCK", 500)
    assert (shingles.word_hashes([text])[0] == whole).all() and len(whole) == 3000


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(90)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)] + [(7, 7), (None, 4)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(500):
        for a, b in edges:
            if a in up and b in up and a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_banding_follows_the_threshold():
    assert minhash.banding(85) == (36, 7) and minhash.banding(80) == (59, 7)
    for percent in (50, 60, 70, 80, 85, 90, 99):
        bands, width = minhash.banding(percent)
        assert bands * width <= shingles.BINS and (1 - (percent / 100) ** width) ** bands <= 1e-6


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_of_pairs_at_the_threshold_pass_both_filters(percent):
    """Densified bytes are not independent: small and middle sets stray farther than 4 binomial deviations."""
    rng = np.random.default_rng(7)
    bands, width = minhash.banding(percent)
    least = shingles.BINS
    for union in (20, 100, 400):
        both = -(-percent * union // 100)
        for _ in range(1000):
            h = rng.integers(0, 2**64, union, dtype=np.uint64)
            cut = both + rng.integers(0, union - both + 1)
            a, b = shingles.sketch(np.sort(h[:cut])), shingles.sketch(np.sort(np.r_[h[:both], h[cut:]]))
            least = min(least, (a == b).sum())
            assert (a == b)[: bands * width].reshape(bands, width).all(1).any()
    assert minhash.least_matches(percent) <= least - 10


@pytest.mark.parametrize("percent", [80, 85])
def test_blocks_find_the_exact_links_and_give_few_rows(spark, percent):
    """One hot group of copies edited at random: nearly all pairs lie around the threshold; a block gives fewer links than it has members."""
    r = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(r.choice([1, 2, 3])):
            text[r.randrange(len(text))] = f"x{i}y{r.randrange(999)}"
        rows.append((i, " ".join(text)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_near(rows, percent)
    sets = [shingles.shingle_set(w) for w in shingles.word_hashes([t.encode() for _, t in rows])]
    import pyarrow as pa

    n = len(sets)
    block = pa.RecordBatch.from_pydict({"block": ["b"] * 2 * n, "node": [*range(n)] * 2, "root": [*range(n)] * 2, "asks": [True] * n + [False] * n, "hashes": [s.view(np.int64).tolist() for s in sets] * 2}, pa.schema([("block", pa.string()), ("node", pa.int64()), ("root", pa.int64()), ("asks", pa.bool_()), ("hashes", pa.list_(pa.int64()))]))
    (links,) = minhash._linked(percent)(iter([block]))
    want = brute_near(rows, percent)
    assert links.num_rows == n - len({c for _, c in want.values()})
    for a, b in zip(*(links.column(k).to_pylist() for k in "ab"), strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)


def test_near_dedup_stage_takes_pairs_at_80(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in minhash.stage(spark, docs, SF).collect()}
    assert left == {i for i, (_, c) in brute_near(texts.items(), 80).items() if i == c}
    assert left != {i for i, (_, c) in brute_near(texts.items(), 85).items() if i == c}


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.written(stage(spark, state, SF), "test-stage")
        ids = [r.doc_id for r in state.select("doc_id").collect()]
        left = Counter(r.doc_id for r in out.select("doc_id").collect())
        text = {r.doc_id: r.text for r in state.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if k == 1:
            newest = {}
            for i in ids:
                t = text[i].translate(LOW)
                newest[t] = max(i, newest.get(t, -1))
            assert set(left) == set(newest.values())
        if k == 2:
            assert set(left) == {i for i, (_, c) in brute_near(text.items(), 80).items() if i == c}
        if k == 3:
            want = {r.doc_id: r.copies for r in mixing.mix(state).collect() if r.copies}
            assert left == Counter(want)
        if k == 4:
            assert left == Counter(ids) and out.where("NOT round_trip").isEmpty()
        state = out


def test_pipeline_stages_take_columns_of_helper_names(spark):
    names = ["_id", "_n", "_copy", "_score", "_y", "_t", "row_key", "Row_Key_", "_s", "_u"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = docs.withColumns({n: F.col("doc_id") + 1000 * k for k, n in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns
        got = out.collect()
        assert got and all(r[n] == r.doc_id + 1000 * k for r in got for k, n in enumerate(names))
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect())


def test_pipeline_stages_act_by_row(spark):
    """Repeated rows, null ids and ids with several texts: every row is decided by itself."""
    long = [f"w{k}" for k in range(60)]
    near, other, alone = " ".join([*long[:59], "new"]), " ".join(f"o{k}" for k in range(50)), " ".join(f"n{k}" for k in range(40))
    rows = [(1, " ".join(long)), (2, near), (2, other), (3, "again and again"), (3, "again and again"), (3, "AGAIN and again"), (None, alone), (None, alone), (None, near), (None, "again and again"), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    low = lambda df: Counter((r.doc_id, (r.text or "").translate(LOW)) for r in df.collect())
    exact = exact_dedup.stage(spark, docs, SF)
    assert low(exact) == Counter([(1, " ".join(long)), (2, near), (2, other), (3, "again and again"), (None, alone), (7, "")])
    want = Counter([(1, " ".join(long)), (2, other), (3, "again and again"), (None, alone), (7, ""), (None, "")])
    assert low(minhash.stage(spark, docs, SF)) == want and low(minhash.stage(spark, exact, SF)) == want - Counter([(None, "")])
    for source in (docs, exact):
        took = Counter()
        for r in mixing.mix(source).collect():
            took[r.doc_id, r["size"]] += r.copies
        got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in mixing.stage(spark, source, SF).collect())
        assert got == +took and {k for k in got if k[0] is None}


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    want = {
        # 1 and 2, 5 and 6, 9 and both 10, 14 and 15 have one text each: the largest id stays, once.
        "exact dedup": [2, 3, 4, 6, None, 8, 10, 11, 12, 13, 15],
        # 3 is near 1 and 2; texts without words are linked with nothing; the smallest id stays, once.
        "MinHash near-dedup": [1, 4, 5, 6, None, 8, 9, 11, 12, 13, 14],
    }
    for name, found in want.items():
        out = stages[name](spark, odd_docs, SF)
        assert ids(out) == sorted(found, key=str) and out.columns == odd_docs.columns and out.where("key <> 'own' OR h <> 0.5 OR n_chars <> 7").isEmpty()
    model = quality.fit(odd_docs, spark.read.parquet(f"{SF}/labels.parquet"), ~quality.held_out())
    good = odd_docs if model.constant is not None else odd_docs.where(quality.score_column(spark, model) >= quality.THRESHOLD)
    assert ids(stages["quality classifier"](spark, odd_docs, SF)) == ids(good)
    took = Counter({r.doc_id: 0 for r in odd_docs.collect()})
    for r in mixing.mix(odd_docs).collect():
        took[r.doc_id] += r.copies
    assert Counter(ids(stages["mixing sources to target weights"](spark, odd_docs, SF))) == +took
    ids_of = {r.doc_id: r.n_tokens for r in stages["SentencePiece encoding and decoding"](spark, odd_docs, SF).collect()}
    assert ids_of[5] == ids_of[6] == 0 and ids_of[4] > 80 and len(ids_of) == 15
    for stage in stages.values():
        assert stage(spark, no_docs, SF).isEmpty()


def test_the_pipeline_leaves_its_last_table_alone(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {f.name for f in shared.iterdir()} if shared.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    (folder,) = [f for f in shared.iterdir() if f.name not in before and f.name.startswith("lagfield-")]
    (table,) = folder.iterdir()
    assert folder.name.startswith("lagfield-pipeline-") and table.name.startswith("5-") and out.count() > 50


def test_queries_without_sql_are_run_here(spark, texts):
    """The token query itself against the library, on the whole table."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    got = queries()["op4_sentencepiece"](spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: sp.encode(t or "") for i, t in texts.items()} and all(r.n_tokens == len(r.ids) and r.round_trip for r in got)
    t, start, want = Tokenizer.from_file(BPE), 0, {}
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op8_token_ids"](spark, SF).collect()} == want


def test_quality_scores_are_made_anew_without_spark(spark, texts):
    """Draw, dictionaries, features and curve once more, in plain Python; the query and the stage give the same."""
    import zstandard

    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    assert len(labels) < quality.SAMPLE_ROWS
    draw = sorted((zlib.crc32(str(i).encode()), texts[i].encode(), y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2 and y in (0, 1) and i in texts and len(texts[i].encode()) <= quality.SAMPLE_BYTES)
    model = quality.train([t for _, t, _ in draw], [y for _, _, y in draw], [1.0] * len(draw))

    def score(text):
        sizes = []
        for raw in (model.good, model.bad):
            pack = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
            nothing = len(pack.compress(b""))
            sizes.append(sum(len(pack.compress(text[k : k + quality.PIECE])) - nothing for k in range(0, len(text), quality.PIECE)))
        good, bad = sizes
        d = max(-0.2, min(0.2, (bad - good) / max(good + bad, 1)))
        share, length = (max(good + bad, 1) / (2 * len(text)), np.log1p(len(text))) if text else (0.35, 0.0)
        x = [d, min(share, 0.35), min(share, 0.2), length, d * length]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    want = {i: score((t or "").encode()) for i, t in texts.items()}
    got = queries()["op1_quality"](spark, SF).collect()
    assert all(np.isclose(r.score, want[r.doc_id], atol=1e-9) and r.predicted == int(r.score >= 0.7) for r in got) and len(got) == len(texts)
    left = {r.doc_id for r in quality.stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert left == {i for i, s in want.items() if s >= 0.7}


def test_shared_prefixes_of_long_words():
    import sentencepiece

    assert [sentencepiece_codec._shared(a, b) for a, b in (("", "x"), ("ab", "ab"), ("abc", "abd"), ("x" * 1000 + "a", "x" * 1000 + "b"), ("x" * 999, "x" * 1000))] == [0, 2, 2, 1000, 999]
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert sentencepiece_codec._shared(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    c = sentencepiece_codec.TrieCodec.from_model(sentencepiece_codec.default_model())
    prefix = "".join(r.choice(["the", "ing", "世", "q"]) for _ in range(6000))
    many = [prefix + "".join(r.choice("abc") for _ in range(5)) for _ in range(60)]
    assert [np.frombuffer(x, "<i4").tolist() for x in c.encode_batch(many)] == [sp.encode(t) for t in many]
    text = "".join(r.choice("一二三四五六七八九十abc") for _ in range(1_000_000))
    tracemalloc.start()
    (raw,) = c.encode_batch([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000 and c.decode(np.frombuffer(raw, "<i4").tolist()) == text


def test_rollups_clean_up_and_keep_their_totals(spark):
    schema = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    c = token_counts.TokenCounts(spark, common.shared_dir(spark, "t"))
    for n in range(4):
        c.apply(f"b{n}", spark.createDataFrame([("insert", "a", "en", "v", n + 1, None)], schema))
        if n % 2:
            c.compact()
    c.clean()
    assert rows_of(c.totals()) == Counter({("a", "en", "v", 4, 10): 1}) and sorted(r.batch for r in c.committed().collect()) == ["b0", "b1", "b2", "b3"] and c._names() == ["published-1", "tables"] and len(c._names("tables")) == 1
    assert not c.apply("b1", spark.createDataFrame([("insert", "a", "en", "v", 9, None)], schema))
