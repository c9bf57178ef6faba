"""Near-duplicates by one-permutation MinHash: densified sketches, banded buckets, star-shaped candidates, exact confirmation.

1. Rows whose shingle sets are the same (128 bits of the set's digest) form a class, a node with a number of its own; from here on only one
   row a class goes on (copies never meet in pairs).
2. A set's hashes fall into ``BINS`` bins, the least of each gives one byte, empty bins are filled by a draw of their own. Bands of
   at most ``ROWS`` bytes are the buckets. ``banding`` gives as many as a pair at the threshold needs to share
   no bucket with a probability of at most ``MISS`` (independent bytes taken): 36 bands of 7 at 85, 59 of 7 at 80.
   Sets too small to be similar to any other set (``least_size``) stay out: their sketches repeat few bytes, and they would share all buckets.
3. Each bucket gives a star of candidates, centre to member; they are confirmed on the full sets and joined to components.
4. Links that a star cannot see: in buckets that still hold several components, the members outside the largest one are held
   against all members by their sketches (6 standard deviations below the threshold), in blocks bounded in rows and in shingles. What remains of a
   block, a list of nodes and not of pairs, meets again with the full sets; of the exact links found there a block
   gives one for each two components that it joins, fewer than it has members.

   Buckets with over ``HOT_ROWS`` members outside (a passage that many texts share) are not compared as they are: their members meet anew by rare shingles
   (``_by_rare``), an exact filter, under which texts that have the passage alone in common do not meet.

So a link between two components is lost only if its sketches share no band or stray by 6 deviations. Measured on simulated pairs at the
threshold (3,000 each at unions of 20, 40, 60, 100, 150, 200, 400 and 1,000; 24,000 at 85 and as many at 80):
without a shared band 0 and 0; below 6 deviations 0 and 0 (below 4: 5 and 4, densified bytes not being independent).
The comparisons of step 4 grow with (members outside the largest component) x (members) of a bucket of at most ``HOT_ROWS`` outside, or of a group by rare shingle: sketches of 512 bytes, exchanged once for ``BLOCK_ROWS``.

Defined results: null and wordless texts have an empty set and stay alone; fewer than five words are one shingle; rows that repeat
an id share that id's component if their texts do; null ids are linked with nothing (component null, not kept); an empty table gives an
empty result; texts pass whole; columns beside id and text are not read, whatever their names, and the pipeline stage returns them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attach_by_key, keep_one, maybe_among, read
from .components import components
from .files import bounded_batches
from .shingles import BINS, shingle_set, sketch, word_hashes

ROWS, MISS, BLOCK_ROWS, BLOCK_SHINGLES, SEEN = 7, 1e-6, 2000, 1_000_000, 200_000
#: Members outside the largest component from which those of a bucket meet by rare shingles instead; either way gives the same links.
HOT_ROWS = 2_000
#: The threshold of the pipeline stage; the query's is 85.
STAGE_PERCENT = 80


def banding(percent: int) -> tuple[int, int]:
    """Bands and bytes of a band: the longest bands (``ROWS`` bytes at most) with which a pair at the threshold shares none with a probability of ``MISS`` at most."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    for rows in range(ROWS, 0, -1):
        bands = 1 if percent == 100 else int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** rows))))
        if bands * rows <= BINS:
            return bands, rows
    raise ValueError(f"no banding of {BINS} bytes finds pairs at {percent} percent")


def _node(found: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes()).digest()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(w) for w in word_hashes(b.column("text").to_pylist())]
        key = [_node(s) if len(s) else None for s in sets]
        codes = [sketch(s).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), b.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(codes, pa.binary())], ["doc_id", "t", "h", "n_shingles", "key", "sketch"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets; of equal texts that a task has just seen only the first."""
    seen: set[bytes] = set()
    for b in batches:
        if len(seen) > SEEN:
            seen.clear()
        new = []
        for i, t in enumerate(b.column("t").to_pylist()):
            if t not in seen:
                seen.add(t)
                new.append(i)
        some = b.take(pa.array(new, pa.int64()))
        sets = [shingle_set(w) for w in word_hashes(some.column("text").to_pylist())]
        offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["key", "hashes"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(h)) for k, h in (("a", "sa"), ("b", "sb")))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size("sa") + F.size("sb"))
    both = both.where(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent)
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), "n").where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def least_size(percent: int) -> int:
    """Shingles that a set needs to reach the threshold with a different one: n of n + 1 at best."""
    return 1 << 62 if percent == 100 else -(-percent // (100 - percent))


def least_matches(percent: int) -> int:
    """Equal bytes of two sketches that a pair at the threshold has but for 6 standard deviations of independent bytes."""
    p = percent / 100 + (1 - percent / 100) / 256
    return int(np.floor(BINS * p - 6 * np.sqrt(BINS * p * (1 - p))))


def _by_block(batches: Iterator[pa.RecordBatch], of_block) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block: ``of_block`` gets the rows of each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column("block").to_pylist()
        cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for x, y in zip(cut, cut[1:], strict=False):
            if y > x:
                if held and keys[x] != last:
                    yield of_block(last, pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(x, y - x))
                last = keys[x]
    if held:
        yield of_block(last, pa.Table.from_batches(held))


def _possible(percent: int):
    """The nodes of a block that may have a link to another component there, by their sketches: (block, node, root, asks)."""
    enough = least_matches(percent)
    bands, width = banding(percent)

    def of_block(name: str, t: pa.Table) -> pa.RecordBatch:
        rows = {k: t.column(k).to_numpy() for k in ("node", "root", "n", "band", "asks", "outside", "first")}
        codes = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        other, marked = np.flatnonzero(~rows["asks"]), np.zeros(len(codes), bool)
        short = other[rows["first"][other]]
        for i in np.flatnonzero(rows["asks"]):
            # One of a pair has the shingle among its first.
            held = other if rows["first"][i] else short
            small, large = np.minimum(rows["n"][held], rows["n"][i]), np.maximum(rows["n"][held], rows["n"][i])
            once = ~rows["outside"][held] | (rows["node"][held] > rows["node"][i])
            held = held[once & (rows["root"][held] != rows["root"][i]) & (100 * small >= percent * large)]
            hit = held[(codes[held] == codes[i]).sum(1) >= enough]
            if len(hit) and rows["band"][i] >= 0:
                # A pair is dealt with in the first bucket that it shares.
                shared = (codes[hit, : bands * width] == codes[i, : bands * width]).reshape(len(hit), bands, width).all(2).argmax(1)
                hit = hit[shared == rows["band"][i]]
            marked[hit] = True
            marked[i] |= len(hit) > 0
        at = np.flatnonzero(marked)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(rows["node"][at]), pa.array(rows["root"][at]), pa.array(rows["asks"][at])], ["block", "node", "root", "asks"])

    return lambda batches: _by_block(batches, of_block)


def _linked(percent: int):
    """The links (a, b) that join components in a block, found on the full sets; rows have block, node, root, asks, hashes."""

    def of_block(name: str, t: pa.Table) -> pa.RecordBatch:
        node, root, asks = (t.column(k).to_numpy() for k in ("node", "root", "asks"))
        sets = t.column("hashes").combine_chunks()
        begin = sets.offsets.to_numpy()
        size = np.diff(begin)
        _, word = np.unique(sets.values.to_numpy()[begin[0] : begin[-1]], return_inverse=True)
        begin = begin - begin[0]
        top = {r: r for r in root.tolist()}

        def of(r: int) -> int:
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        a, b, other = [], [], np.flatnonzero(~asks)
        has = np.zeros(int(word.max(initial=0)) + 1, bool)
        for i in np.flatnonzero(asks) if len(other) else ():
            mine = word[begin[i] : begin[i + 1]]
            has[mine] = True
            both = np.add.reduceat(has[word], begin[:-1], dtype=np.int64)[other]
            has[mine] = False
            for j in other[both * 100 >= (size[i] + size[other] - both) * percent]:
                if (x := of(int(root[i]))) != (y := of(int(root[j]))):
                    top[x] = y
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lambda batches: _by_block(batches, of_block)


def _mixed(labelled: DataFrame) -> DataFrame:
    """Buckets of several components: the largest of them, how many members lie outside it, and into how many blocks those and all members go."""
    parts = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    buckets = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "w", "root")).alias("most"), F.sum("k").alias("size"), F.sum("w").alias("weight")).where("roots > 1")
    blocks = lambda k, w: F.greatest(F.ceil(k / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    outside = F.col("size") - F.col("most.k")
    return buckets.select("bucket", F.col("most.root").alias("top"), outside.alias("outside_rows"), blocks(outside, F.col("weight") - F.col("most.w")).alias("ask_blocks"), blocks(F.col("size"), F.col("weight")).alias("all_blocks"))


def _by_rare(hot: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Members (node, n, root) of hot buckets, entered in a group for each of their rare shingles: bucket, band (-1), node, n, root, first.

    Shingles have one order for all, rare ones first. Two sets of sizes x <= y at the threshold t have ceil(2 t x / (1 + t)) shingles in common at least, and ceil(t y): so one of the first
    x - ceil(2 t x / (1 + t)) + 1 of the smaller is among the first y - ceil(t y) + 1 of the larger. ``first`` marks the shorter prefix; groups in which no member has it
    hold no pair. A passage that all members share is frequent, stands last, and is in no shorter prefix unless it makes up all but a small part of a text.
    """
    nodes = scratch.written(hot.select("node", "n", "root").distinct(), "hot-nodes")
    some, flag = maybe_among(sets, F.col("node"), nodes, F.col("node"))
    held = some.where(F.col(flag)).join(nodes, "node").select("node", "n", "root", F.explode("hashes").alias("shingle"))
    counts = scratch.written(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")), "shingles")
    total = max(1, nodes.agg(F.sum("n")).first()[0] or 0)
    ranked = attach_by_key(held.withColumn("shingle", F.col("shingle").cast("string")), counts.withColumn("shingle", F.col("shingle").cast("string")), "shingle", "rows", total, ["node", "shingle"])
    ordered = ranked.groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("rows", "shingle"))).alias("all"))
    up = lambda a, b: F.floor((a + b - 1) / b)
    short, long = F.col("n") - up(2 * percent * F.col("n"), F.lit(100 + percent)) + 1, F.col("n") - up(percent * F.col("n"), F.lit(100)) + 1
    each = ordered.select("node", "n", "root", short.alias("short"), F.posexplode(F.slice("all", F.lit(1), long.cast("int"))).alias("at", "x"))
    entered = each.where("x.rows > 1").select(F.xxhash64(F.lit("rare"), "x.shingle").alias("bucket"), F.lit(-1).alias("band"), "node", "n", "root", (F.col("at") < F.col("short")).alias("first"))
    entered = scratch.written(entered, "entered")
    useful = entered.groupBy("bucket").agg(F.max("first").alias("any"), F.count(F.lit(1)).alias("k")).where("any AND k > 1")
    return entered.join(useful.select("bucket"), "bucket", "left_semi")


def _graph(docs: DataFrame, id_col: str, text_col: str, percent: int, null_ids: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(marks, graph), both written: marks has a row per row of ``docs`` (doc_id, t: the text's md5, n_shingles, key),
    graph one per class (key in hex, root, component_id: the least id of the component, rows). ``null_ids``: rows without an id are linked too."""
    bounded_batches(docs.sparkSession)
    bands, width = banding(percent)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"t": F.unhex(F.md5("text")), "h": F.xxhash64("text")})
    marks = scratch.written(rows.mapInArrow(_sketched, "doc_id long, t binary, h long, n_shingles long, key binary, sketch binary"), "marks")
    whole = marks.where("key IS NOT NULL" if null_ids else "key IS NOT NULL AND doc_id IS NOT NULL")
    classes = whole.groupBy("key", "sketch").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"), F.min("h").alias("h"))
    # Written, so that a class keeps its number.
    classes = scratch.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    code = lambda k: F.substring(F.col("sketch"), k * width + 1, F.lit(width))
    bucket = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(k, code(k)).alias("bucket"))))
    spread = classes.where(F.col("n") >= least_size(percent)).select("node", "n", bucket.alias("x")).select("node", "n", "x.band", "x.bucket")
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre")).where("size > 1")
    buckets = scratch.written(buckets.select("bucket", "centre"), "buckets")
    shared, flag = maybe_among(spread, F.col("bucket"), buckets, F.col("bucket"))
    members = scratch.written(shared.where(F.col(flag)).drop(flag).join(buckets, "bucket"), "members")
    stars = members.where(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    # The sets of classes that share a bucket are made anew, from the texts of the class's least hash.
    asked = scratch.written(classes.join(members.select("node").distinct(), "node", "left_semi").select("key", "node", "h"), "asked")
    again, flag = maybe_among(rows, F.col("h"), asked, F.col("h"))
    sets = again.where(F.col(flag)).select("t", "text").mapInArrow(_full, "key binary, hashes array<long>")
    sets = scratch.written(sets.join(asked, "key").dropDuplicates(["key"]).select("node", "hashes"), "sets")
    links = scratch.written(_confirmed(stars, sets, percent), "links")
    roots = scratch.written(components(links), "roots")
    # What a star cannot see: buckets of several components.
    labelled = members.select("bucket", "band", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = scratch.written(labelled, "labelled")
    mixed = scratch.written(_mixed(labelled), "mixed")
    hot = mixed.where(F.col("outside_rows") > HOT_ROWS)
    labelled = labelled.withColumn("first", F.lit(True))
    if not hot.isEmpty():
        rare = _by_rare(labelled.join(hot.select("bucket"), "bucket", "left_semi"), sets, percent, scratch)
        labelled = labelled.join(hot.select("bucket"), "bucket", "left_anti").select(rare.columns).unionByName(rare)
        mixed = scratch.written(_mixed(labelled), "mixed-rare")
    inside = scratch.written(labelled.join(mixed, "bucket").withColumn("outside", F.col("root") != F.col("top")), "inside")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = inside.where("outside").withColumn("i", place("ask_blocks")).withColumn("j", each("all_blocks")).withColumn("asks", F.lit(True))
    offers = inside.withColumn("j", place("all_blocks")).withColumn("i", each("ask_blocks")).withColumn("asks", F.lit(False))
    sketches, flag = maybe_among(classes.select("node", "sketch"), F.col("node"), inside, F.col("node"))
    blocks = asks.unionByName(offers).join(sketches.where(F.col(flag)), "node")
    blocks = blocks.select(F.concat_ws("/", "bucket", "i", "j").alias("block"), "band", "node", "root", "n", "asks", "outside", "first", "sketch")
    blocks = blocks.repartition("block").sortWithinPartitions("block")
    possible = scratch.written(blocks.mapInArrow(_possible(percent), "block string, node long, root long, asks boolean"), "possible")
    some, flag = maybe_among(sets, F.col("node"), possible, F.col("node"))
    again = possible.join(some.where(F.col(flag)), "node").select("block", "node", "root", "asks", "hashes").repartition("block").sortWithinPartitions("block")
    extra = scratch.written(again.mapInArrow(_linked(percent), "a long, b long").distinct(), "extra")
    if not extra.isEmpty():
        roots = scratch.written(components(links.unionByName(extra)), "all-roots")
    graph = classes.select("key", "node", "first", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = graph.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("members"), F.count(F.lit(1)).alias("k"))
    graph = attach_by_key(graph, least, "root", "k", max(1, classes.count()), ["node"])
    graph = scratch.written(graph.select(F.hex("key").alias("key"), "root", "component_id", "rows", "members"), "graph")
    scratch.clear("marks", "graph")
    return marks.drop("sketch", "h"), graph


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable) and kept of every row of ``docs``."""
    marks, graph = _graph(docs, id_col, text_col, percent, False, Scratch(docs.sparkSession, "near"))
    out = marks.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.hex("key")).alias("key"))
    # Rows without a class match nothing: their key is their own.
    out = out.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))))
    out = attach_by_key(out, graph.select("key", "component_id", "rows"), "key", "rows", max(1, marks.count()), ["doc_id", "key"])
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row with the smallest id stays: one row, were the id repeated; one without an id only if no other has one."""
    scratch = Scratch(spark, "near-stage")
    marks, graph = _graph(docs, "doc_id", "text", STAGE_PERCENT, True, scratch)
    total = max(1, marks.count())
    groups = graph.where("members > 1").select("key", "root", "component_id", "rows")
    rows = marks.where("key IS NOT NULL").select("doc_id", F.hex("t").alias("t"), F.hex("key").alias("key"))
    rows = scratch.written(attach_by_key(rows, groups, "key", "rows", total, ["doc_id", "t"]).where("root IS NOT NULL").select("doc_id", "t", "root", "component_id"), "grouped")
    # The text that stays is one of those that the smallest id has.
    stays = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("t").alias("keep_key"))
    texts = rows.groupBy("t", "root", "component_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("k")).join(stays, "root")
    texts = attach_by_key(texts, sizes, "root", "k", max(1, rows.count()), ["t"])
    texts = scratch.written(texts.select(F.col("t").alias("key"), "size", F.col("component_id").alias("keep_id"), "keep_key"), "texts-of-groups")
    scratch.clear("texts-of-groups")
    return keep_one(docs, F.hex(F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))), texts, total)


SQL = {
    "op10_minhash": r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
two AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT two.b, reach.root FROM reach JOIN two ON two.a = reach.id WHERE reach.root < two.b),
m AS (SELECT id AS doc_id, min(root) AS component_id FROM reach GROUP BY id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
}
