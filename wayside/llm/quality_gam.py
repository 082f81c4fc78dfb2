"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into quantile bins. Shallow trees, fitted to the gradient of the logistic
loss, are boosted cyclically: one feature after another, at a small rate, each tree adding to that
feature's look-up table; then the feature pairs that explain most of what is left get tables of
their own. A score is the sum of table entries through the logistic function.

The model is trained on a bounded sample: at most MAX_ROWS labelled rows, those with the smallest
hash of the id, never a row of the held-out fold; where documents repeat an id, the first 2 * MAX_ROWS
by that hash, the features and the label. The label, language, source and id are no features.
Every row of every text is scored over its whole length. Null text is scored as the empty text.
Null labels are not learned from; a document with several labels counts once for each. Without a
usable label every score is the prior 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold_of, unused
from .textblocks import hash_spans, slices, texts_of, windows_of, word_bounds

MAX_ROWS, BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, THRESHOLD = 20_000, 32, 120, 0.15, 6, 8, 0.3

#: byte classes: 0 other, then the ones named
_CLASSES = ("other", "upper", "lower", "digit", "space", "newline", "stop", "shout", "bar", "symbol", "high", "web", "quote")
_OF = np.zeros(256, np.int64)
for _name, _bytes in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "newline": (10,),
    "stop": b".,;:?", "shout": b"!", "bar": b"|", "symbol": b"#*$%&<>~^=+_", "high": range(128, 256), "web": b"@/\\{}", "quote": b"\"'()[]`-",
}.items():
    _OF[list(_bytes)] = _CLASSES.index(_name)

FEATURES = (
    "log_words", "word_length", "upper", "digit", "stop", "shout", "bar", "symbol", "high", "web", "quote", "words_a_line",
    "same_as_before", "distinct", "repeat_windows", "repeat_lines", "longest_word", "upper_words", "symbol_words",
)


def _repeated(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per row, the share of values that an earlier one of the row equals (44 bits of the hash)."""
    n = np.diff(begin)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = np.sort((row << np.uint64(44)) | (h >> np.uint64(20)))
    again = (key[1:] == key[:-1]) if len(key) else np.zeros(0, bool)
    who = (key[1:][again] >> np.uint64(44)).astype(np.int64)
    return np.bincount(who, minlength=len(n)) / np.maximum(n, 1)


def features_of(column: pa.Array) -> np.ndarray:
    """(rows, features) of the whole texts."""
    data, off = texts_of(column)
    rows, k = len(off) - 1, len(_CLASSES)
    size = np.diff(off)
    counts = np.bincount(_OF[data] + np.repeat(np.arange(rows) * k, size), minlength=rows * k).reshape(rows, k).astype(float)
    c = dict(zip(_CLASSES, counts.T, strict=True))
    starts, ends, first = word_bounds(data, off)
    h = hash_spans(data, starts, ends)
    n = np.diff(first)
    words = np.maximum(n, 1)
    chars = np.maximum(size - c["space"] - c["newline"], 1)
    row = np.repeat(np.arange(rows), n)
    same = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows) if len(h) else np.zeros(rows)
    win, begin = windows_of(h, first, 3)
    # lines: spans between newlines, cut at the ends of rows
    edge = np.unique(np.concatenate((off, np.flatnonzero(data == 10) + 1)))
    a, b = edge[:-1], edge[1:]
    b = np.where((b > a) & (data[np.maximum(b - 1, 0)] == 10), b - 1, b) if len(data) else b
    full = b > a
    a, b = a[full], b[full]
    lines = hash_spans(data, a, b)
    line_first = np.searchsorted(a, off)
    length = (ends - starts).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else head
    upper = np.bincount(row[(_OF[head] == 1) & (_OF[second] == 1)], minlength=rows)
    tail = data[ends - 1] if len(ends) else head
    marked = np.bincount(row[np.isin(_OF[tail], [7, 8, 9])], minlength=rows)
    out = np.column_stack([
        np.log1p(n), chars / words, c["upper"] / chars, c["digit"] / chars, c["stop"] / words, c["shout"] / words, c["bar"] / words, c["symbol"] / words,
        c["high"] / chars, c["web"] / words, c["quote"] / words, n / np.maximum(np.diff(line_first), 1), same / words, 1 - _repeated(h, first),
        _repeated(win, begin), _repeated(lines, line_first), np.log1p(longest), upper / words, marked / words,
    ])
    return np.nan_to_num(out)


def _shallow(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, reg: float = 1.0) -> np.ndarray:
    """Leaf values, by bin, of a tree over ordered bins: greedy best splits of sums."""
    g, w = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + reg)
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(a + 1, b)
            if len(at):
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                i = int(gains.argmax())
                best = max(best, (float(gains[i]), int(at[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + reg)
    return out


def _shallow_pair(grad: np.ndarray, hess: np.ndarray, reg: float = 1.0) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid: one cut across, then one cut in each half."""
    best_gain, best = 0.0, np.zeros_like(grad)
    for axis in (0, 1):
        g, w = (grad, hess) if axis == 0 else (grad.T, hess.T)
        cg, cw = np.cumsum(g, axis=0), np.cumsum(w, axis=0)
        for at in range(len(g) - 1):
            out, gain = np.zeros_like(g), 0.0
            for half, (sg, sw) in enumerate(((cg[at], cw[at]), (cg[-1] - cg[at], cw[-1] - cw[at]))):
                leaf = _shallow(sg, sw, 2, reg)
                gain += float((leaf * sg).sum())
                out[: at + 1] = leaf if half == 0 else out[: at + 1]
                if half:
                    out[at + 1 :] = leaf
            if gain > best_gain:
                best_gain, best = gain, out if axis == 0 else out.T
    return best, best_gain


@dataclass
class Additive:
    edges: list = field(default_factory=list)  # inner bin edges of each feature
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, table)
    bias: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)])

    def coarse(self, i: int, b: np.ndarray) -> np.ndarray:
        return b * PAIR_BINS // (len(self.edges[i]) + 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), self.bias)
        b, z = self.bins(x), np.full(len(x), self.bias)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for i, j, t in self.pairs:
            z += t[self.coarse(i, b[:, i]), self.coarse(j, b[:, j])]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits tables to labels y in {0, 1}."""
    if not len(y) or y.min() == y.max():
        return Additive(bias=0.0 if not len(y) else (4.0 if y[0] else -4.0))
    model = Additive([np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])])
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    z = np.full(len(y), model.bias)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            r, w = slope()
            step = RATE * _shallow(np.bincount(b[:, i], r, len(t)), np.bincount(b[:, i], w, len(t)))
            t += step
            z += step[b[:, i]]
    r, w = slope()
    coarse = [model.coarse(i, b[:, i]) for i in range(x.shape[1])]
    cell = lambda i, j, v: np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    ranked = sorted(((_shallow_pair(cell(i, j, r), cell(i, j, w))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked]
    for _ in range(ROUNDS // 6):
        for i, j, t in model.pairs:
            r, w = slope()
            step = RATE * _shallow_pair(cell(i, j, r), cell(i, j, w))[0]
            t += step
            z += step[coarse[i], coarse[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> Additive:
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_fold))
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MAX_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.xxhash64("doc_id").alias("k"), "text")  # at most MAX_ROWS rows are sent
    schema = "label int, k long, f array<double>"

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f = features_of(part["text"])
                yield pa.RecordBatch.from_arrays([part["label"], part["k"], pa.array(list(f), pa.list_(pa.float64()))], names=["label", "k", "f"])

    found = rows.mapInArrow(apply, schema).orderBy("k", "f", "label").limit(2 * MAX_ROWS).toPandas()
    return train(np.array(found.f.tolist()).reshape(len(found), len(FEATURES)), found.label.to_numpy(float))


def with_scores(docs: DataFrame, model: Additive, score_col: str) -> DataFrame:
    """docs with a score column; extra columns pass through."""
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.scores(features_of(part["text"]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, score_col])

    return docs.mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, in the columns of docs."""
    (s,) = unused(docs, "_quality_score")
    return with_scores(docs, fit(docs, labels), s).where(F.col(s) >= THRESHOLD).select(*docs.columns)
