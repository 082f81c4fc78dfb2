"""Language ID with a byte convolutional network.

Embedded bytes pass through filters of several widths, a maximum over the window, a rectifier and a
softmax. As bytes are discrete, a filter is kept as one table per position, the product of embedding
and weights; a convolution is then a sum of table look-ups. The network is trained in numpy on a
bounded sample of labelled rows: of each language the ROWS_PER_LANG rows with the smallest hashes of
the id, or an equal share of MAX_ROWS where there are more than MAX_ROWS / ROWS_PER_LANG languages;
never a row that `held_out` marks. Every language with a labelled row is learned. Of a sampled text,
tasks cut windows over the whole length and send WINDOWS_PER_ROW of them, spread evenly from the
first to the last, or all if it has no more. A text to predict is cut into windows of WINDOW bytes,
all of them are scored, and their log probabilities are averaged by length.

Null texts and texts without a letter are `und` with score 0, as is everything if no labelled row
exists. Rows without a language are never learned from. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SENT_IDS, fold_of
from .textblocks import slices, texts_of

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
ROWS_PER_LANG, MAX_ROWS, WINDOWS_PER_ROW = 1500, 20_000, 4
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    tables: dict  # width -> (width, 256, filters)
    bias: dict  # width -> (filters,)
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Rectified maxima of every filter over windows x (rows, bytes)."""
        found = []
        for w, t in self.tables.items():
            n = x.shape[1] - w + 1
            acc = np.take(t[0], x[:, :n], axis=0)
            for j in range(1, w):
                acc += np.take(t[j], x[:, j : j + n], axis=0)
            found.append(acc.max(axis=1) + self.bias[w])
        return np.maximum(np.concatenate(found, axis=1), 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut_windows(data: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with byte 0, bytes in each, row of each) over the whole of every text."""
    n = np.diff(off)
    many = -(-n // window)
    row = np.repeat(np.arange(len(n)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = off[row] + k * window
    size = np.minimum(window, off[row + 1] - start)
    padded = np.concatenate((data, np.zeros(window, np.uint8)))
    x = padded[start[:, None] + np.arange(window)]
    x[np.arange(window) >= size[:, None]] = 0
    return x, size, row


def spread(a: int, b: int, most: int = WINDOWS_PER_ROW) -> list[int]:
    """At most so many of the numbers a to b - 1, from the first to the last, evenly."""
    return sorted({*np.linspace(a, b - 1, min(most, b - a)).astype(int).tolist()})


def train(x: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network | None:
    """Fits the network with Adam on windows x (rows of WINDOW bytes) and their languages."""
    names = sorted(set(labels))
    if not names:
        return None
    number = {v: i for i, v in enumerate(names)}
    y = np.array([number[v] for v in labels])
    rng = np.random.default_rng(seed)
    nf = FILTERS * len(WIDTHS)
    p = {"E": rng.normal(0, 0.5, (256, DIM)), "V": rng.normal(0, 0.1, (nf, len(names))), "c": np.zeros(len(names))}
    for w in WIDTHS:
        p[f"W{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0

    def network() -> Network:
        return Network(names, {w: np.einsum("ed,wdf->wef", p["E"], p[f"W{w}"]).astype(np.float32) for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["V"], p["c"])

    weight = (len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1)))[y].astype(np.float32) if len(y) else np.zeros(0, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            xb, yb, net, arg, top = x[i], y[i], network(), {}, []
            for w in WIDTHS:
                n = WINDOW - w + 1
                acc = sum(np.take(net.tables[w][j], xb[:, j : j + n], axis=0) for j in range(w))
                arg[w] = acc.argmax(axis=1)
                top.append(np.take_along_axis(acc, arg[w][:, None], axis=1)[:, 0] + p[f"b{w}"])
            h = np.concatenate(top, axis=1)
            a = np.maximum(h, 0)
            z = a @ p["V"] + p["c"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(i)), yb] -= 1
            q *= weight[i][:, None] / len(i)
            g = {"V": a.T @ q, "c": q.sum(axis=0), "E": np.zeros_like(p["E"])}
            dh = (q @ p["V"].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g[f"b{w}"], g[f"W{w}"] = d.sum(axis=0), np.zeros_like(p[f"W{w}"])
                for j in range(w):
                    byte = np.take_along_axis(xb, arg[w] + j, axis=1)
                    dt = np.zeros((256, FILTERS), np.float32)
                    np.add.at(dt, (byte, np.arange(FILTERS)[None, :]), d)
                    g["E"] += dt @ p[f"W{w}"][j].T
                    g[f"W{w}"][j] = p["E"].T @ dt
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network()


def fit(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> Network | None:
    """Trains on the bounded sample of labelled rows."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of("doc_id", folds) != held_fold))
    rows = rows.select("lang", "text", F.xxhash64("doc_id").alias("k"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    if not langs:
        return None
    most = max(1, min(ROWS_PER_LANG, MAX_ROWS // langs))
    # twice as many as wanted pass a cut by hash, so few rows reach the exact one
    chance = F.least(F.lit(1.0), (2 * most + 50) / F.col("n"))
    rows = rows.join(F.broadcast(counts) if langs <= SENT_IDS else counts, "lang").where(F.pmod("k", F.lit(1 << 30)) / (1 << 30) < chance)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = texts_of(part["text"])
                x, _, row = cut_windows(data, off)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                chosen = [spread(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["lang"], part["k"], pa.array([[x[i].tobytes() for i in c] for c in chosen], pa.list_(pa.binary()))], names=["lang", "k", "windows"])

    found = rows.select("lang", "k", "text").mapInArrow(cut, "lang string, k long, windows array<binary>")
    first = Window.partitionBy("lang").orderBy(F.pmod("k", F.lit(1 << 30)), "k", "windows")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    found = found.orderBy("place", "lang").collect()  # MAX_ROWS rows of WINDOWS_PER_ROW windows at most
    x = np.frombuffer(b"".join(w for r in found for w in r["windows"]), np.uint8).reshape(-1, WINDOW)
    return train(x, [r["lang"] for r in found for _ in r["windows"]])


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = dict(docs.dtypes)["doc_id"]

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, off = texts_of(part["text"])
                n = part.num_rows
                sums, probs, total = (np.zeros((n, len(network.langs))) if network else None), None, np.zeros(n)
                if network:
                    probs = np.zeros_like(sums)
                    x, size, row = cut_windows(data, off)
                    for at in range(0, len(x), 64):
                        s = slice(at, at + 64)
                        lp = network.log_probabilities(x[s])
                        np.add.at(sums, row[s], lp * size[s, None])
                        np.add.at(probs, row[s], np.exp(lp) * size[s, None])
                        np.add.at(total, row[s], size[s])
                ok = part["letters"].to_numpy(zero_copy_only=False) & (total > 0)
                best = sums.argmax(axis=1) if network else np.zeros(n, int)
                names = [network.langs[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)] if network else [UNKNOWN] * n
                score = np.where(ok, probs[np.arange(n), best] / np.maximum(total, 1), 0.0) if network else np.zeros(n)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trains on docs and predicts every row of docs."""
    return predict(docs, fit(docs)).select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score")
