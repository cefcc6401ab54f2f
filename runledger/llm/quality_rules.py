"""Quality rules: statistics of every text, fixed base rules, and an isolation forest over the statistics.

The forest is grown on all labelled rows of quality 1, dealt to its trees; short path lengths
over its random splits mark unusual texts. The score from which a text is dropped is the
one that best parts all labelled rows of quality 1 from those of quality 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import Words, mix64, pieces, repeats, window_hashes, windows_inside

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols_per_word", "chars_per_word", "upper_share", "punct_per_word", "symbol_word_share", "distinct_share"]
SCHEMA = ", ".join(["doc_id long", *[f"{c} long" for c in BASE], *[f"{c} double" for c in FEATURES]])
#: Steps of scores from 0 to 1.
STEPS = 1 << 16
#: A tree has TREE_ROWS rows at least, or all there are; with more rows than TREES * TREE_ROWS each row is in one tree.
TREES, TREE_ROWS, SEED = 128, 256, 20240229

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[ord("a") : ord("z") + 1] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(w: Words) -> np.ndarray:
    """Lines (parted by line feeds) with a word that equal an earlier line of the text."""
    out = np.zeros(len(w.first) - 1, dtype=np.int64)
    feeds = np.flatnonzero(w.data == 10)
    cuts = np.unique(np.concatenate([w.offsets, feeds + 1]))
    cuts = cuts[cuts <= len(w.data)]
    a, b = cuts[:-1], cuts[1:].copy()
    text = np.searchsorted(w.offsets, a, "right") - 1
    b[np.isin(b - 1, feeds)] -= 1  # without the feed itself
    has_word = np.searchsorted(w.start, b) > np.searchsorted(w.start, a)
    a, b, text = a[has_word], b[has_word], text[has_word]
    if len(a):
        lines = Words(w.data, w.offsets, a, b, np.array([0, len(a)]))
        _, earlier = repeats(lines.hashes(), text, lines.hashes(1))
        np.add.at(out, text[earlier], 1)
    return out


def text_statistics(w: Words) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """BASE and FEATURES of each text."""
    n = len(w.first) - 1
    count, h, text = w.counts, w.hashes(), w.text_of_word()
    chars = _sums(((w.data & 0xC0) != 0x80), w.offsets)
    spaces = chars - _sums(((w.data & 0xC0) != 0x80) & ~np.isin(w.data, [32, 9, 10, 11, 12, 13]), w.offsets)
    symbols = _sums(_SYMBOL[w.data], w.offsets)
    windows = window_hashes(h, REPEAT_WINDOW)
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    if len(windows):
        at = np.flatnonzero(windows_inside(w.first, REPEAT_WINDOW))
        more, _ = repeats(windows[at], text[at], window_hashes(w.hashes(1), REPEAT_WINDOW)[at])
        np.add.at(covered, at[more], 1)
        np.add.at(covered, at[more] + REPEAT_WINDOW, -1)
    repeated = _sums(np.cumsum(covered)[:-1] > 0, w.first)
    dup_lines = _dup_lines(w)
    per = np.maximum(count, 1)
    _, again = repeats(h, text)
    symbol_words = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[w.data], out=symbol_words[1:])
    with_symbol = _sums(symbol_words[w.end] > symbol_words[w.start], w.first) if len(h) else np.zeros(n, np.int64)
    upper, lower = _sums(_UPPER[w.data], w.offsets), _sums(_LOWER[w.data], w.offsets)
    distinct = count - _sums(again, w.first)
    features = [symbols / per, (chars - spaces) / per, upper / np.maximum(upper + lower, 1), _sums(_PUNCT[w.data], w.offsets) / per, with_symbol / per, np.minimum(1.0, distinct / np.maximum(1.0, per**0.75))]
    return [count, chars - spaces, symbols, dup_lines, repeated], [np.asarray(f, dtype=np.float64) for f in features]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch, w in pieces(batches, 1):
            base, features = text_statistics(w)
            arrays = [batch.column(0).cast(pa.int64()), *[pa.array(x.astype(np.int64)) for x in base], *[pa.array(x) for x in features]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *BASE, *FEATURES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


@dataclass
class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), split value, left child; a leaf's value is its path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    norm: float
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))) + 2)
        size = 2 * rows
        feature, value, left = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), dtype=np.int64)
        for t in range(trees):
            part = x[rng.choice(len(x), rows, replace=False)]
            todo, used = [(0, part, 0)], 1
            while todo:
                node, p, d = todo.pop()
                low, high = p.min(axis=0), p.max(axis=0)
                can = np.flatnonzero(high > low)
                if d >= depth or len(p) <= 1 or not len(can):
                    value[t, node] = d + _average_path(len(p))
                    continue
                f = int(rng.choice(can))
                # a little beyond the range, so that values never seen in the sample fall apart from it
                room = 0.5 * (high[f] - low[f])
                v = rng.uniform(low[f] - room, high[f] + room)
                goes = p[:, f] < v
                feature[t, node], value[t, node], left[t, node] = f, v, used
                if goes.all() or not goes.any():  # the empty side is a leaf of no rows
                    full, empty = (used, used + 1) if goes.all() else (used + 1, used)
                    value[t, empty] = d + 1
                    todo.append((full, p, d + 1))
                else:
                    todo += [(used, p[goes], d + 1), (used + 1, p[~goes], d + 1)]
                used += 2
                if used + 2 > feature.shape[1]:
                    feature = np.pad(feature, ((0, 0), (0, size)), constant_values=-1)
                    value, left = np.pad(value, ((0, 0), (0, size))), np.pad(left, ((0, 0), (0, size)))
        return cls(feature, value, left, max(1e-9, _average_path(rows)), depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / usual path): near 1 for rows that few splits set apart."""
        total = np.zeros(len(x))
        for f, v, left in zip(self.feature, self.value, self.left, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth + 1):
                k = f[node]
                inner = np.flatnonzero(k >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = left[at] + (x[inner, k[inner]] >= v[at])
            total += v[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _ranges(batches, forest: IsolationForest, level: int, share: int):
    """For each node at that level of each tree its rows and their least and largest features, once a task.

    A row (h, FEATURES) is in ``share`` trees that its hash h picks.
    """
    trees, size = forest.feature.shape
    keys, n, low, high = np.arange(0), np.arange(0), np.empty((0, len(FEATURES))), np.empty((0, len(FEATURES)))
    for b in batches:
        h = b.column(0).to_numpy().view(np.uint64)
        x = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
        row = np.repeat(np.arange(len(h)), share)
        step = np.tile(np.arange(share, dtype=np.uint64), len(h)) * (h[row] >> np.uint64(32) | np.uint64(1))
        tree = ((h[row] + step) % np.uint64(trees)).astype(np.int64)
        node = np.zeros(len(row), dtype=np.int64)
        for _ in range(level):
            f = forest.feature[tree, node]
            inner = f >= 0
            row, tree, node, f = row[inner], tree[inner], node[inner], f[inner]
            node = forest.left[tree, node] + (x[row, f] >= forest.value[tree, node])
        key = np.concatenate([keys, tree * size + node])
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        if len(keys):
            n = np.add.reduceat(np.concatenate([n, np.ones(len(row), dtype=np.int64)])[order], first)
            low = np.minimum.reduceat(np.concatenate([low, x[row]])[order], first)
            high = np.maximum.reduceat(np.concatenate([high, x[row]])[order], first)
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), *map(pa.array, low.T), *map(pa.array, high.T)], ["node", "n", *LOW, *HIGH])


LOW, HIGH = [f"low{i}" for i in range(len(FEATURES))], [f"high{i}" for i in range(len(FEATURES))]


def grow_forest(rows: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> IsolationForest | None:
    """A forest over all rows (h, FEATURES), level by level; None without rows.

    Splits are drawn from the range of a node's rows, so only ranges come together: at most a row for each
    node of a level (trees * 4 * tree_rows) in a task and in the driver, however many rows there are.
    """
    count = rows.count()
    if not count:
        return None
    share = min(trees, max(1, -(-trees * tree_rows // count)))
    depth = max(1, int(np.ceil(np.log2(max(2, min(tree_rows, count))))) + 2)
    size = 2 ** (depth + 1) - 1
    forest = IsolationForest(np.full((trees, size), -1), np.zeros((trees, size)), np.tile(2 * np.arange(size) + 1, (trees, 1)), max(1e-9, _average_path(max(1, round(count * share / trees)))), depth)
    for level in range(depth + 1):
        # Nodes without rows are leaves.
        forest.value[:, 2**level - 1 : 2 ** (level + 1) - 1] = level
        parts = rows.mapInArrow(lambda batches, level=level: _ranges(batches, forest, level, share), ", ".join(["node long, n long", *[f"{c} double" for c in LOW + HIGH]]))
        found = parts.groupBy("node").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH]).toPandas()
        at, n, low, high = found["node"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found[LOW].to_numpy(np.float64), found[HIGH].to_numpy(np.float64)
        can = high > low
        split = (n > 1) & can.any(axis=1) & (level < depth)
        forest.value.flat[at] = level + np.array([_average_path(int(k)) for k in n])
        if not split.any():
            break
        at, low, high, can = at[split], low[split], high[split], can[split]
        u, v = (mix64(mix64(at.astype(np.uint64) + np.uint64(1)) ^ np.uint64(seed + i)) / 2.0**64 for i in (1, 2))
        f = np.argmax(np.cumsum(can, axis=1) > np.minimum(u * can.sum(axis=1), can.sum(axis=1) - 1).astype(np.int64)[:, None], axis=1)
        a, b = low[np.arange(len(f)), f], high[np.arange(len(f)), f]
        # a little beyond the range, so that values never seen in training fall apart from it
        forest.feature.flat[at], forest.value.flat[at] = f, a - 0.5 * (b - a) + v * 2 * (b - a)
    return forest


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that parts good from bad rows with the highest sum of both rates of right answers."""
    values, at = np.unique(scores, return_inverse=True)
    return threshold_of_counts(values, np.bincount(at[good], minlength=len(values)), np.bincount(at[~good], minlength=len(values)))


def threshold_of_counts(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The same from the numbers of good and bad rows at each of the scores, which rise."""
    if not bad.sum() or not good.sum():
        return float(np.nextafter(scores.max(), 2)) if good.sum() else float("inf")
    right = np.r_[0, np.cumsum(good)] / good.sum() + 1 - np.r_[0, np.cumsum(bad)] / bad.sum()
    cut = int(np.argmax(right))
    return float("inf") if cut == len(scores) else float(scores[cut]) if cut == 0 else float((scores[cut - 1] + scores[cut]) / 2)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, BASE, base_failed, anomaly, kept.

    Words are runs without white space; null and empty texts have none and fail the base
    rules. Statistics cover whole texts and every row, repeated ones too. Forest and threshold
    are fitted on all labelled rows of either quality that the base rules pass; without labels of quality 1 the base rules decide alone. An empty
    table gives an empty result; other columns are not read.
    """
    stats = materialize(statistics(docs, id_col, text_col), "rule-statistics")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    passed = F.expr("n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words")
    fit = stats.where(passed).join(known, "doc_id").where("quality IN (0, 1)").select(F.xxhash64("doc_id", *FEATURES).alias("h"), *FEATURES, (F.col("quality") == 1).alias("good"))
    fit = materialize(fit, "rule-labelled")
    forest = grow_forest(fit.where("good").select("h", *FEATURES))

    def anomalies(rows: np.ndarray) -> np.ndarray:
        return np.round(forest.score(rows) * STEPS) / STEPS if forest else np.zeros(len(rows))

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anomalies(np.stack([c.to_numpy() for c in b.columns[:-1]], axis=1))), b.column(len(FEATURES))], ["score", "good"])

    threshold = float("inf")
    if forest:
        scored = fit.select(*FEATURES, "good").mapInArrow(score, "score double, good boolean")
        found = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("score")  # at most STEPS + 1 rows
        threshold = threshold_of_counts(*(found[c].to_numpy() for c in ("score", "good", "bad")))

    def judge(batches):
        for b in batches:
            rows = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in FEATURES], axis=1)
            anomaly = anomalies(rows)
            n, rep = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (n < 20) | (100 * rep > 30 * n)
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i + 1) for i in range(len(BASE))], pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly < threshold))], ["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(judge, ", ".join(["doc_id long", *[f"{c} long" for c in BASE], "base_failed boolean", "anomaly double", "kept boolean"]))
