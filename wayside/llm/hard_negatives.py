"""Hard-negative mining by branch and bound in ball trees.

Every block of rows has a ball tree for each label: a node has the mean of its rows and the radius
around it. With q the anchor and r the radius, all inner products under a node lie between
q.c - |q| r and q.c + |q| r, so a node is left out where its upper bound is below the window of scores
or strictly beneath the k-th best so far, or its lower bound is above the window. Rows that tie with the
k-th best are kept up to the end, and the smaller id wins.

The search runs twice: an anchor's best rows of its own label are its positives; each positive's score
p sets a window from low p to high p (in hundredths), and the best rows of other labels inside it are its
negatives. Positives with equal scores share one window. An anchor's windows are searched together: its
inner products with a node or leaf are made once. A group of anchors goes through a tree together, each
node with those still alive there.

A null label takes no part, nor do the rows that `vectors` leaves out; see there for copies, ties, lengths
and blocks. An anchor's own row is not its positive, but its copies are. A window is empty if p is
negative (its low end is above its high end). An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

POSITIVES, NEGATIVES, LOW, HIGH, LEAF, HELD = 5, 3, 50, 95, 64, 1 << 20


@dataclass
class Node:
    rows: np.ndarray
    center: np.ndarray
    radius: float
    parts: tuple[Node, ...] = ()


def ball_tree(x: np.ndarray, rows: np.ndarray) -> Node:
    """The tree of x[rows]: split at the middle of the line through two rows far apart."""
    own = x[rows]
    center = own.mean(axis=0)
    away = np.sqrt(((own - center) ** 2).sum(axis=1))
    node = Node(rows, center, float(away.max()))
    if len(rows) > LEAF and node.radius > 0:
        a = own[away.argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(own @ (a - b), kind="stable")
        half = len(rows) // 2
        node.parts = tuple(ball_tree(x, rows[np.sort(part)]) for part in (order[:half], order[half:]))
    return node


class Search:
    """The k best rows of each (query, window) in a block; low and high are matrices of windows, own has the
    place of each query's own row, which is not to be found, but for its other copies."""

    def __init__(self, x, ids, copies, own, q, low, high, k):
        self.x, self.q, self.ids, self.copies, self.own, self.k = x, q, ids, copies, own, k
        self.barred = np.where((own >= 0) & (copies[own] == 1), own, -2)
        self.fx, self.fq = x.astype(np.float64), q.astype(np.float64)
        self.low, self.high, self.kth = low, high, np.full(low.shape, -np.inf)
        self.exact = vectors.exact_in_floats(x, q)
        self.norm = np.sqrt((self.fq**2).sum(axis=1))
        self.slack = 1e-9 * (1 + self.norm * np.sqrt((self.fx**2).sum(axis=1)).max(initial=0))
        self.found, self.size = [], 0

    def walk(self, node: Node, active: np.ndarray) -> None:
        """Goes through a tree with the queries `active`."""
        at = self.fq[active] @ node.center
        reach = self.norm[active] * node.radius + self.slack[active]
        need = np.maximum(self.low[active], self.kth[active])
        alive = ((at + reach)[:, None] >= need) & ((at - reach)[:, None] <= self.high[active])
        active = active[alive.any(axis=1)]
        if not len(active):
            return
        if node.parts:
            near = [self.fq[active] @ p.center for p in node.parts]
            for p in sorted(range(len(near)), key=lambda p: -near[p].sum()):  # where most is to be found first
                self.walk(node.parts[p], active)
            return
        score = self.fq[active] @ self.fx[node.rows].T if self.exact else (self.q[active].astype(object) @ self.x[node.rows].T.astype(object)).astype(np.float64)
        score[self.barred[active][:, None] == node.rows] = -np.inf
        for w in range(self.low.shape[1]):
            room = 0 if self.exact else self.slack[active][:, None]
            inside = (score + room >= self.low[active, w][:, None]) & (score - room <= self.high[active, w][:, None])
            if len(node.rows) > self.k:
                kth = np.partition(np.where(inside, score, -np.inf), len(node.rows) - self.k, axis=1)[:, len(node.rows) - self.k]
                self.kth[active, w] = np.maximum(self.kth[active, w], kth - (0 if self.exact else 2 * self.slack[active]))
            i, j = np.nonzero(inside & (score + room >= self.kth[active, w][:, None]) & (score > -np.inf))
            self.found.append((active[i], np.full(len(i), w), node.rows[j]))
            self.size += len(i)
        if self.size > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """(query, window, row, score) of the best of what was found."""
        query, window, row = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else [np.zeros(0, np.int64)] * 3
        score = vectors.pair_scores(self.q, self.x, query, row)
        real = (score >= self.low[query, window]) & (score <= self.high[query, window])
        query, window, row, score = (c[real] for c in (query, window, row, score))
        keep, full = vectors.best(query * self.low.shape[1] + window, score, self.ids[row], self.copies[row] - (row == self.own[query]), self.k)
        query, window, row, score = (c[keep] for c in (query, window, row, score))
        self.kth[query[full], window[full]] = np.maximum(self.kth[query[full], window[full]], score[full])
        self.found, self.size = [(query, window, row)], len(query)
        return query, window, row, score


def _by_label(labels: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    return [(int(labels[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def search_block(held: pa.Table, wanted: pa.Table, same: bool, k: int, low: int = LOW, high: int = HIGH) -> dict:
    """The k best rows of the anchors' own labels (same), or of the others inside each of their windows."""
    x, q = vectors.both_matrices(held["vector"], wanted["vector"])
    rows, copies, own = held["row"].to_numpy(), held["copies"].to_numpy(), wanted["row"].to_numpy()
    if same:
        lows, highs, of = np.full((len(q), 1), -np.inf), np.full((len(q), 1), np.inf), None
    else:
        of = wanted["scores"].to_pylist()
        width = max(map(len, of))
        lows, highs = np.full((len(q), width), np.inf), np.full((len(q), width), -np.inf)
        for i, scores in enumerate(of):
            lows[i, : len(scores)] = [-(-low * p // 100) for p in scores]
            highs[i, : len(scores)] = [high * p // 100 for p in scores]
    search = Search(x, vectors.ids_of(held["vec_id"]), copies, vectors.places_of(rows, own), q, lows, highs, k)
    asked = wanted["label"].to_numpy()
    for label, part in _by_label(held["label"].to_numpy()):
        active = np.flatnonzero((asked == label) == same)
        if len(active):
            search.walk(ball_tree(search.fx, part), active)
    query, window, row, score = search.settle()
    take = lambda t, c, at: t[c].take(pa.array(at)).combine_chunks()
    out = {"q_row": own[query], "anchor_id": take(wanted, "vec_id", query), "q_copies": wanted["copies"].to_numpy()[query], "vec_id": take(held, "vec_id", row), "score": score}
    if same:
        return out | {"copies": copies[row] - (rows[row] == own[query])}
    return out | {"copies": copies[row], "positive_score": [of[i][w] for i, w in zip(query.tolist(), window.tolist(), strict=True)]}


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor is an expression
    of vec_id, label one of df's columns."""
    rows = vectors.integer_rows(df.where(label.isNotNull()), {"vec_id": F.col(id_col).cast("long"), "label": label.cast("long")}, vector)
    anchors = rows.where(is_anchor)
    fields = "q_row long, anchor_id long, q_copies long, vec_id long, copies long, score long"
    found = vectors.met(rows, anchors, lambda held, wanted: search_block(held, wanted, True, positives), fields)
    best = vectors.written(vectors.ranked(found, ["q_row"], positives))
    windows = best.groupBy("q_row").agg(F.collect_set("score").alias("scores"))  # at most `positives` to an anchor
    asked = vectors.written(anchors.join(windows, anchors["row"] == windows["q_row"]).drop("q_row"))
    found = vectors.met(rows, asked, lambda held, wanted: search_block(held, wanted, False, negatives, low, high), fields + ", positive_score long")
    hard = vectors.ranked(found, ["q_row", "positive_score"], negatives).select("q_row", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    each = best.select("q_row", "anchor_id", "q_copies", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    rows = each.join(hard, ["q_row", "positive_score"]).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("q_copies").cast("int"))))
    return rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
