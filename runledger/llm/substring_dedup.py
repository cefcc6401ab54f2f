"""Substring dedup by seed and extend.

Seed: every window of LENGTH words picks its anchor, the K-word run with the smallest hash in it (winnowing), so
equal windows pick equal anchors. Windows in a row with one anchor make a segment: (anchor, hash of all words that its
windows cover). Only segments whose anchor occurs again anywhere go on.

Extend: occurrences of an anchor are compared by their words to both sides, first over the whole
segment: of segments with equal words only those of the first document stay open, all others are repeats. Where an
anchor stands in different surroundings, the open segments are compared window by window, each key's
first document against the others. So a passage in thousands of documents costs each of them a few rows, never pairs.

Words are compared by two independent 64-bit hashes of each, so runs of words by 128 bits.

Repeats that touch or overlap join into maximal ones when their words are removed. A window that repeats one of
its own document is found in the document itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .tokens import Words, _power_tables, mix64, pieces, repeats, window_hashes, windows_inside

LENGTH, K = 20, 8
LAST = (1 << 63) - 1
#: Bytes of span lists that are broadcast at most; beyond, texts and lists meet in a shuffle.
BROADCAST_BYTES = 32 << 20


def anchors(h: np.ndarray, h2: np.ndarray, first: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of all segments: anchor hash, two hashes of the words covered (from the words' two), first window, number of windows (flat)."""
    if len(h) < length:
        return (*[np.empty(0, np.uint64)] * 3, *[np.empty(0, np.int64)] * 2)
    span = length - k + 1
    g = window_hashes(h, k)
    n = len(h) - length + 1
    low, width = g, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n], low[span - width : span - width + n])
    at = np.zeros(n, dtype=np.int64)
    for j in range(span - 1, -1, -1):  # the leftmost of equal ones, so that the choice depends on the words alone
        hit = g[j : j + n] == low
        at[hit] = j
    place = at + np.arange(n)
    ok = windows_inside(first, length)
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.r_[(place[1:] != place[:-1]) | ~ok[1:], True]) + 1
    up, down = _power_tables(len(h) + 1)
    shape = mix64(((stop - start) * 64 + place[start] - start).astype(np.uint64))
    covered = []
    for words in (h, h2):
        sums = np.empty(len(h) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(mix64(words) * up[: len(h)], out=sums[1:])
        covered.append(mix64((sums[stop + length - 1] - sums[start]) * down[start] + shape))
    return low[start], *covered, start, stop - start


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the row's key: did (null ids last) and th, the text's hash if ids repeat, else 0."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("did", F.coalesce("doc_id", F.lit(LAST)))
    repeat = not d.groupBy("did").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return d.select("did", (F.xxhash64("text") if repeat else F.lit(0).cast("long")).alias("th"), "doc_id", "text")


def segments(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(batches):
        for b, w in pieces(batches, 2):
            a, u, v, start, n = anchors(w.hashes(), w.hashes(1), w.first, length)
            text = np.searchsorted(w.first, start, "right") - 1
            # What comes again in its own text is found there later.
            _, earlier = repeats(u, text, v)
            a, u, v, start, n, text = (x[~earlier] for x in (a, u, v, start, n, text))
            did, th = (b.column(i).to_numpy()[text] for i in (0, 1))
            s = (start - w.first[text]).astype(np.int32)
            hashes = [pa.array(x.view(np.int64)) for x in (a, u, v)]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(did), pa.array(th), pa.array(s), pa.array(n.astype(np.int32))], ["a", "u", "v", "did", "th", "s", "n"])

    return rows.select("did", "th", "text").mapInArrow(run, "a long, u long, v long, did long, th long, s int, n int")


def _with_lists(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    n, spans = lists.agg(F.count("*"), F.sum(F.size("spans"))).first()
    small = 80 * n + 8 * (spans or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(lists) if small else lists, ["did", "th"], how)


def maximal(spans: DataFrame) -> DataFrame:
    """Join spans (did, th, s, e) of a document that touch or overlap."""
    row = W.partitionBy("did", "th").orderBy("s", "e")
    new = F.coalesce(F.col("s") > F.max("e").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    marked = spans.withColumn("new", new.cast("int")).withColumn("g", F.sum("new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("did", "th", "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("g")


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(did, th, s, e): maximal spans of words all of whose windows also start in an earlier document.

    Tables that a hot anchor's rows are joined with are written first: Spark can split such a join only where
    both sides are plain exchanges.
    """
    every = materialize(segments(rows, length), "repeat-segments")
    again = materialize(every.groupBy("a").agg(F.count("*").alias("_n")).where("_n > 1").select("a"), "repeat-anchors")
    seg = materialize(every.join(again, "a"), "repeat-seeds")
    contents = materialize(seg.groupBy("a", "u", "v").agg(F.min("did").alias("first")), "repeat-contents")
    known = seg.join(contents, ["a", "u", "v"])
    whole = known.where("did > first").select("did", "th", "s", (F.col("s") + F.col("n") - 1 + length).alias("e"))
    contested = materialize(contents.groupBy("a").agg(F.count("*").alias("_n")).where("_n > 1").select("a"), "repeat-contested")
    is_open = known.where("did = first").join(contested, "a", "left_semi")
    lists = materialize(is_open.groupBy("did", "th").agg(F.collect_list(F.struct("s", "n")).alias("spans")), "repeat-open")

    def windows(batches):
        for b, w in pieces(batches, 2):
            h, h2 = (window_hashes(w.hashes(lane), length).view(np.int64) for lane in (0, 1))
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, spans in enumerate(b.column(3)):
                s, n = (spans.values.field(x).to_numpy() for x in ("s", "n"))
                at = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                flat = w.first[i] + at
                for c, x in zip(cols, (h[flat], h2[flat], np.full(len(at), b.column(0)[i].as_py()), np.full(len(at), b.column(1)[i].as_py()), at.astype(np.int32)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["w", "w2", "did", "th", "s"])

    found = _with_lists(rows.select("did", "th", "text"), lists, "inner").select("did", "th", "text", "spans")
    win = materialize(found.mapInArrow(windows, "w long, w2 long, did long, th long, s int"), "repeat-windows")
    first = win.groupBy("w", "w2").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("last > first").select("w", "w2", "first")
    single = win.join(materialize(first, "repeat-firsts"), ["w", "w2"]).where("did > first").select("did", "th", "s", (F.col("s") + length).alias("e"))
    return maximal(whole.unionByName(single))


def remove(w: Words, covered: np.ndarray, i: int) -> tuple[int, list[bytes]]:
    a, b = int(w.first[i]), int(w.first[i + 1])
    keep = np.flatnonzero(~covered[a:b]) + a
    return b - a - len(keep), [w.data[s:e].tobytes() for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    Removed is each word in a window of ``length`` words whose words also start earlier: in a document with a smaller
    id, or further up in the same. Words are joined by one space. Null and empty texts have no
    words. A null id counts as the largest; of rows with one id none is earlier than the other, so
    rows repeated whole keep the same words. An empty table gives an empty result; other columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    spans = repeated_spans(rows, length).groupBy("did", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    lists = materialize(spans, "repeat-spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def run(batches):
        for b, w in pieces(batches, 1):
            depth = np.zeros(len(w.start) + 1, dtype=np.int64)
            h, h2 = (window_hashes(w.hashes(lane), length) for lane in (0, 1))
            at = np.flatnonzero(windows_inside(w.first, length))
            _, earlier = repeats(h[at], w.text_of_word()[at], h2[at])
            np.add.at(depth, at[earlier], 1)
            np.add.at(depth, at[earlier] + length, -1)
            for i, x in enumerate(b.column(2)):
                if x.is_valid:
                    np.add.at(depth, w.first[i] + x.values.field("s").to_numpy(), 1)
                    np.add.at(depth, w.first[i] + x.values.field("e").to_numpy(), -1)
            covered = np.cumsum(depth)[:-1] > 0
            removed, digests, texts = [], [], []
            for i in range(b.num_rows):
                n, kept = remove(w, covered, i)
                text = b" ".join(kept)
                removed.append(n)
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode() if keep_text else None)
            arrays = [b.column(0), pa.array(w.counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return _with_lists(rows, lists, "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
