"""Near-duplicate classes by order MinHash and banded alignment.

A text's words give its K-word shingles, each labelled with how often it occurred before in the text. For each
of FUNCTIONS hash functions the TOP shingles with the smallest hashes are sampled, and every two of them, in text
order, make a sketch; two texts agree in one about as often as edits leave both shingles and their order. Texts
that share a sketch are candidates, and count as linked if the word edit distance is at most (1 - SIMILARITY)
of the longer text, which a bit-parallel alignment in a widening band decides.

Equal texts fold into one first. A bucket of m texts is compared as a star, each text with the bucket's first:
m - 1 pairs. Where that leaves several components in a bucket, all its pairs of texts in different components are
compared: alikeness is not transitive, so no text stands for others. In large buckets that is done block by block:
counts of words rule pairs out first, likely pairs are aligned before others, and pairs that links found so
far have joined need no alignment. No pair that shares a sketch is left out. Classes are the components of the links.

How sure a link is found depends on the shingles in common. With a fifth of both texts' shingles in common (up to 20 random
edits in 100 words, or 12 evenly spread) nine in ten pairs and more share a sketch; edits that leave hardly a five-word
shingle whole are not looked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize
from .components import components
from .tokens import Words, mix64, pieces, split_words, text_buffers, window_hashes, windows_inside

K, SIMILARITY = 5, 0.8
FUNCTIONS, TOP = 22, 3
#: Texts of up to so many shingles have a sketch for each shingle besides, as they may share one only.
FEW = 4
#: Buckets of up to SMALL texts are compared by a join, larger ones in blocks of about BLOCK texts or BLOCK_WORDS words.
SMALL, BLOCK, BLOCK_WORDS = 16, 2048, 2 << 20
#: Bits of the largest map of shared buckets.
MAP_BITS = 27
#: Counters of a text's words.
BINS = 256
LAST = (1 << 63) - 1
_ODD = [int(x) | 1 for x in mix64(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def order_sketches(w: Words, h: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of all texts, one after another, and their number for each text; texts with fewer than k words have none."""
    have = np.flatnonzero(w.counts >= k)
    count = np.zeros(len(w.counts), dtype=np.int64)
    if not len(have):
        return np.empty(0, np.uint64), count
    shingles = w.counts[have] - k + 1
    text = np.repeat(np.arange(len(have)), shingles)
    start = np.concatenate([[0], np.cumsum(shingles)[:-1]])
    g = window_hashes(h, k)[np.flatnonzero(windows_inside(w.first, k))]
    # how often the shingle occurred before in its text
    order = np.argsort(mix64(g ^ mix64(text.astype(np.uint64))), kind="stable")
    new = np.r_[True, (g[order][1:] != g[order][:-1]) | (text[order][1:] != text[order][:-1])]
    place = np.arange(len(g))
    before = np.empty(len(g), dtype=np.uint64)
    before[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    x = mix64(g + before * np.uint64(0xA0761D6478BD642F))
    rows = [], []
    for j, odd in enumerate(_ODD):
        y = x * np.uint64(odd)
        y ^= y >> np.uint64(29)
        top = []
        for i in range(TOP):
            low = np.minimum.reduceat(y, start)
            hit = np.flatnonzero(y == low[text])
            top.append(hit[np.r_[True, text[hit][1:] != text[hit][:-1]]])
            y[top[-1]] = np.uint64(LAST * 2 + 1)
        for q in range(1, TOP):
            for p in range(q):
                enough = np.flatnonzero(shingles > q)
                a, b = top[p][enough], top[q][enough]
                rows[0].append(enough)
                rows[1].append(mix64(mix64(x[np.minimum(a, b)]) * np.uint64(3) + x[np.maximum(a, b)] + np.uint64(j)))
    few = np.flatnonzero(shingles[text] <= FEW)
    rows[0].append(text[few])
    rows[1].append(mix64(x[few]))
    of, sketch = np.concatenate(rows[0]), np.concatenate(rows[1])
    order = np.argsort(of, kind="stable")
    count[have] = np.bincount(of, minlength=len(have))
    return sketch[order], count


def _shift(mask: int, by: int) -> int:
    return mask >> by if by >= 0 else mask << -by


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``.

    Bit-parallel: the vertical differences of a band of 2k + 1 cells along the diagonal are the bits of
    two integers. The band starts narrow and is widened till the distance fits in it.
    """
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return None
    if n:
        differ = np.flatnonzero(a[:n] != b[:n])
        p = int(differ[0]) if len(differ) else n
        a, b = a[p:], b[p:]
        n -= p
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        s = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - s], b[: len(b) - s]
        n -= s
    if not n:
        d = max(len(a), len(b))
        return d if d <= most else None
    c = len(a) - len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    words = b.tolist()
    # Words that the other text lacks must each be edited.
    if sum(x not in where for x in words) > most:
        return None
    k = max(8, abs(c))
    while True:
        k = min(k, most)
        full = (1 << (2 * k + 1)) - 1
        vp, vn = full ^ ((1 << k) - 1), 0
        bit, d = 1 << (c + k), abs(c)
        for i, x in enumerate(words):
            m = _shift(where.get(x, 0), i - k) & full
            d0 = ((((m & vp) + vp) ^ vp) | m | vn) & full
            hp = vn | (full ^ (d0 | vp))
            hn = d0 & vp
            if i >= -c and not d0 & bit:
                d += 1
                if d > k:
                    break
            d0 >>= 1
            vp = hn | (full ^ (d0 | hp))
            vn = d0 & hp
        if d <= k:
            return d
        if k == most:
            return None
        k *= 4


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return banded_distance(a, b, most) is not None if most else len(a) == len(b) and bool((a == b).all())


def text_keys(w: Words) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each text's sequence of words."""
    pos = (np.arange(len(w.start)) - w.first[w.text_of_word()]).astype(np.uint64)
    keys = []
    for lane, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
        sums = np.zeros(len(pos) + 1, dtype=np.uint64)
        np.cumsum(mix64(w.hashes(lane) ^ mix64(pos + np.uint64(salt))), out=sums[1:])
        keys.append(mix64(sums[w.first[1:]] - sums[w.first[:-1]] + w.counts.astype(np.uint64)).view(np.int64))
    return keys


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did (null ids last), k1 and k2 (hashes of all words), n (words), sketch."""
    def run(batches):
        for b, w in pieces(batches, 1):
            keys = text_keys(w)
            s, size = order_sketches(w, w.hashes())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[0]), pa.array(keys[1]), pa.array(w.counts), lists], ["did", "k1", "k2", "n", "sketch"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "did long, k1 long, k2 long, n long, sketch array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, text) of the documents whose id is in ids (did). Texts take less than half the room of 64-bit hashes of their words."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.join(broadcast_if_small(ids), "did", "left_semi")


def keyed_texts(rows: DataFrame) -> DataFrame:
    """(did, k1, text) for rows (did, text)."""
    def run(batches):
        for b, w in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_keys(w)[0]), b.column(1)], ["did", "k1", "text"])

    return rows.mapInArrow(run, "did long, k1 long, text string")


def word_arrays(w: Words) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words."""
    return np.split(w.hashes(), w.first[1:-1])


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs (x, y) with linked: are their texts alike?"""
    def run(batches):
        for b, w in pieces(batches, 2):
            other = split_words(*text_buffers(b.column(3)))
            ok = [alike(p, q, similarity) for p, q in zip(word_arrays(w), word_arrays(other), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["x", "y", "linked"])

    both = pairs.join(texts.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y").join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")
    return both.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long, linked boolean")


def _mixed_buckets(rows: DataFrame, label: str, **figures) -> DataFrame:
    """Buckets (b) of rows (b, node and others) that hold texts of different labels, with figures (aggregates) of each."""
    buckets = rows.groupBy("b").agg(F.min(label).alias("_l"), F.max(label).alias("_h"), *(c.alias(name) for name, c in figures.items()))
    return materialize(buckets.where("_l <> _h").select("b", *figures), "near-centres")


def _bitmap(buckets: DataFrame) -> np.ndarray:
    """A bit for each bucket's number modulo a power of two: 16 to 32 bits a bucket, 2 ** MAP_BITS at most, so 16 MB.

    Bits that buckets share let some other rows pass, which the join that follows takes out.
    """
    size = 1 << min(MAP_BITS, max(10, (16 * buckets.count()).bit_length()))
    at = buckets.select(F.col("b").bitwiseAND(F.lit(size - 1)).alias("i"))
    words = at.groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(i & 63 AS INT))")).alias("v")).toPandas()
    out = np.zeros(size >> 6, dtype=np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out


def _shared_rows(nodes: DataFrame) -> DataFrame:
    """(b, node, n, x) for the texts of each bucket (sketch) that several texts share, x being its first.

    Most sketches are one text's own: the bitmap leaves them out before rows are moved to meet the shared buckets.
    """
    own = nodes.select("node", "n", F.array_distinct("sketch").alias("sketch"))
    buckets = _mixed_buckets(own.select("node", F.explode("sketch").alias("b")), "node", x=F.min("node"))
    bits = _bitmap(buckets)

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            i = flat & (len(bits) * 64 - 1)
            may = np.flatnonzero(bits[i >> 6] >> (i & 63) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(flat[may]), b.column(0).take(pa.array(of[may])), b.column(1).take(pa.array(of[may]))], ["b", "node", "n"])

    return materialize(own.mapInArrow(run, "b long, node long, n long").join(broadcast_if_small(buckets), "b"), "near-buckets")


def _close_sizes(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose lengths don't rule them out already."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "xy")
    both = pairs.join(x, "x").join(y, "y")
    return both.where(F.least("nx", "ny") >= F.greatest("nx", "ny") * F.lit(similarity) - 1e-9).select("x", "y")


def _word_counts(words: list[np.ndarray]) -> np.ndarray:
    """For each text a byte for each of BINS classes of words, which stops at 255."""
    return np.stack([np.minimum(np.bincount((x % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255) for x in words]).astype(np.int16)


class _Joined:
    """Components of numbers 0 .. n - 1 under unions."""

    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        self.of = self.up.tolist()  # label of each row, as a number
        self.up = list(range(max(self.of, default=-1) + 1))

    def find(self, row: int) -> int:
        x = self.of[row]
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(t: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links of texts in blocks p and q of bucket b that join components which were apart, each pair compared once.

    t: b, p, q, block, node, label, hot (the large buckets of the node), text. A pair that also meets in a large
    bucket with a smaller number is left to that one. An edit takes at most one word from either text, so
    neither has more words over the other's than edits are allowed.
    """
    b, p, q = (t.column(c)[0].as_py() for c in ("b", "p", "q"))
    node, label, block = (t.column(c).to_numpy() for c in ("node", "label", "block"))
    words = word_arrays(split_words(*text_buffers(t.column("text").combine_chunks())))
    n, counts = np.array([len(x) for x in words]), _word_counts(words)
    lists = t.column("hot").combine_chunks()
    flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    earlier = flat < b
    ids, at = np.unique(flat[earlier], return_inverse=True)
    member = np.zeros((len(node), len(ids)), dtype=np.float32)
    member[of[earlier], at] = 1
    first, second = np.flatnonzero(block == p), np.flatnonzero(block == q)
    found: list[np.ndarray] = []
    for a in range(0, len(first), 32):
        i = first[a : a + 32]
        longer = np.maximum(n[i][:, None], n[second])
        ok = (label[i][:, None] != label[second]) & (np.minimum(n[i][:, None], n[second]) >= longer * similarity - 1e-9)
        if p == q:
            ok &= node[i][:, None] < node[second]
        if len(ids):
            ok &= member[i] @ member[second].T == 0
        u, v = np.nonzero(ok)
        for c in range(0, len(u), 1 << 16):
            x, y, most = i[u[c : c + (1 << 16)]], second[v[c : c + (1 << 16)]], ((1 - similarity) * longer[u, v][c : c + (1 << 16)] + 1e-9).astype(np.int64)
            more = counts[x] - counts[y]
            over = np.maximum(more, 0).sum(1)
            least = np.maximum(over, over - more.sum(1))
            fit = least <= most
            found.append(np.stack([x, y, least * 1000 // np.maximum(most, 1)])[:, fit])
    if not found:
        return []
    x, y, cost = np.concatenate(found, axis=1)
    joined, out = _Joined(label), []
    for i in np.argsort(cost, kind="stable").tolist():
        a, c = int(x[i]), int(y[i])
        if joined.find(a) != joined.find(c) and alike(words[a], words[c], similarity):
            joined.union(a, c)
            out.append((int(node[a]), int(node[c])))
    return out


def large_bucket_links(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (x, y) of texts of different labels in the buckets of rows (b, node, label, m, w), m and w being the bucket's texts and words.

    Every block of a bucket meets every other in a group of its own, so a large bucket is spread over tasks.
    """
    def run(t: pa.Table) -> pa.Table:
        links = np.array(block_links(t, similarity), dtype=np.int64).reshape(-1, 2)
        return pa.table({"x": links.min(axis=1, initial=LAST), "y": links.max(axis=1, initial=-1)})

    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_WORDS))
    # One row a text, with its buckets (as many as it has sketches, at most): texts are looked up once, not in each bucket.
    own = rows.groupBy("node", "label").agg(F.collect_list(F.struct("b", blocks.alias("of"))).alias("met"))
    own = materialize(own, "near-hot").join(texts, "node").select("node", "label", F.col("met.b").alias("hot"), "text", F.explode("met").alias("_m"))
    met = own.select("_m.b", F.pmod(F.xxhash64("node"), F.col("_m.of")).alias("block"), "node", "label", "hot", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m.of") - 1)).alias("other"))
    met = met.select("b", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "label", "hot", "text")
    return met.groupBy("b", "p", "q").applyInArrow(run, "x long, y long")


def linked_classes(nodes: DataFrame, text_of, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) for the nodes (node, n, sketch) that are linked to others: components of the links.

    text_of gives (node, text) for a table (node).

    1. Every bucket as a star around its first text.
    2. Buckets that still hold several components: all pairs of texts in different ones. Small buckets (SMALL texts,
       so a few pairs a text) by a join, larger ones block by block. Links found here join components of the first step.
    """
    rows = _shared_rows(nodes)
    texts = materialize(text_of(rows.select("node").distinct()), "near-words")
    stars = rows.where("node <> x").select("x", F.col("node").alias("y")).distinct()
    tested = materialize(verify(_close_sizes(stars, nodes, similarity), texts, similarity), "near-judged")
    joined = materialize(components(tested.where("linked").select("x", "y"), "near-stars"), "near-labels")
    rows = rows.select("b", "node", "n").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    buckets = _mixed_buckets(rows, "label", m=F.count("*"), w=F.sum("n"))
    mixed = materialize(rows.join(broadcast_if_small(buckets), "b"), "near-buckets")

    one, two = (mixed.where(F.col("m") <= SMALL).select("b", F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "xy")
    few = materialize(one.join(two, "b").where("x < y AND lx <> ly").select("x", "y").distinct(), "near-pairs")
    fresh = materialize(_close_sizes(few, nodes, similarity).join(tested.select("x", "y"), ["x", "y"], "left_anti"), "near-pairs")
    late = verify(fresh, texts, similarity).where("linked").select("x", "y")
    large = mixed.where(F.col("m") > SMALL)
    late = materialize(late.unionByName(large_bucket_links(large, texts, similarity)), "near-late")
    if late.isEmpty():
        return joined
    new = late.select(F.col("x").alias("node")).unionByName(late.select(F.col("y").alias("node"))).distinct().join(joined, "node", "left_anti")
    known = materialize(joined.unionByName(new.withColumn("label", F.col("node"))), "near-labels")
    x, y = (known.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "xy")
    over = components(late.join(x, "x").join(y, "y").select(F.col("lx").alias("x"), F.col("ly").alias("y")), "near-late")
    over = materialize(over.select(F.col("node").alias("label"), F.col("label").alias("_new")), "near-late")
    return known.join(over, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, kept.

    Texts with the same words are one class; texts of fewer than K words, empty and null ones among them, are alike
    only if equal. A null id counts as the largest, and gets class_id null where all ids of the class are null. Of rows
    repeated with the smallest id one is kept. An empty table gives an empty result; other columns are not read.
    """
    sketched = materialize(sketch_table(docs, id_col, text_col), "near-sketches")
    same = materialize(sketched.groupBy("k1", "k2").agg(F.min("did").alias("node"), F.count("*").alias("copies")), "near-ids")
    texts = same.count()
    # Sketches of one copy of each text only, so that they needn't go through the grouping.
    own = F.broadcast(same) if texts <= BROADCAST_ROWS else same
    one = sketched.withColumnRenamed("did", "node").join(own, ["k1", "k2", "node"])
    same = materialize(one.select("k1", "k2", "node", "copies", "n", "sketch"), "near-texts")
    if same.count() > texts:  # rows repeated with their id
        same = materialize(same.dropDuplicates(["k1", "k2"]), "near-texts")
    # Rows that share an id though their texts differ are told apart by the text's hash.
    ids = sketched.groupBy("did").agg(F.count("*").alias("c"), *(f(k).alias(f"{k}_{i}") for k in ("k1", "k2") for i, f in enumerate((F.min, F.max))))
    repeated, clash = ids.agg(F.coalesce(F.max(F.col("c") > 1), F.lit(False)), F.coalesce(F.max(F.expr("k1_0 <> k1_1 OR k2_0 <> k2_1")), F.lit(False))).first()
    if clash:
        same = materialize(same.withColumn("node", F.xxhash64("k1", "k2")), "near-texts")

    def text_of(ids: DataFrame) -> DataFrame:
        if not clash:
            own = materialize(ids.select(F.col("node").alias("did")), "near-ids")
            texts = texts_of(docs, own, id_col, text_col).withColumnRenamed("did", "node")
            return texts.dropDuplicates(["node"]) if repeated else texts
        own = sketched.join(same.select("k1", "k2", "node"), ["k1", "k2"]).join(ids, "node", "left_semi")
        own = materialize(own.groupBy("node", "k1").agg(F.min("did").alias("did")), "near-ids")
        return keyed_texts(texts_of(docs, own.select("did").distinct(), id_col, text_col)).join(own, ["did", "k1"]).select("node", "text").dropDuplicates(["node"])

    joined = linked_classes(same.select("node", "n", "sketch"), text_of, similarity)
    classes = same.select("k1", "k2", "node", "copies").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Written first: Spark can split a large class's rows only if both sides of the join are plain exchanges.
    sizes = materialize(classes.groupBy("label").agg(F.sum("copies").alias("class_size")), "near-sizes")
    classes = classes.select("k1", "k2", "label").join(sizes, "label")
    each = sketched.groupBy("did", "k1", "k2").agg(F.count("*").alias("_n")).join(materialize(classes, "near-classes"), ["k1", "k2"])
    if clash:
        smallest = each.groupBy("label").agg(F.min(F.struct("did", "k1", "k2")).alias("s"))
        each = each.join(smallest, "label").withColumn("label", F.col("s.did")).withColumn("_own", F.struct("did", "k1", "k2") == F.col("s")).drop("s")
    else:
        each = each.withColumn("_own", F.col("did") == F.col("label"))
    each = each.select("did", "label", "class_size", "_own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
    no_last = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return each.select(no_last("did").alias("doc_id"), no_last("label").alias("class_id"), "class_size", (F.col("_own") & (F.col("_i") == 1)).alias("kept"))
