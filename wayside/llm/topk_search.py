"""Exact top-k search by aggregation of sorted lists without random access.

In a block of vectors each component has a list of the rows sorted by it. A query reads all lists in
step, from the end that its own component's sign prefers. What it has read of a row adds up; what it
hasn't is at most the value where that list's reading stands, and at least the list's last value.
So each row has an upper and a lower bound, also rows not met yet. Reading stops at the depth where no
row outside can reach the k-th best score so far and few rows are left that can; their final scores are
then resolved, and rows that don't reach the k best fall. Ties are kept up to the end.

A block is read in parts of rising size. The k-th best score that a query has resolved in earlier parts,
or the k-th best lower bound, whichever is higher, is what a row must reach; so only the first part
is read to the end of its lists.

Queries are read in bunches, so each step adds one run of a list to the bounds of a whole bunch.
See `vectors` for rows that take no part, copies, ties, lengths and blocks. A query's own row is left
out, but not its copies. With fewer than k others all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

K, PART, BUNCH = 5, 256, 64
DEPTHS, LEFT = (0.25, 0.5, 0.75), 0.25


class Lists:
    """The sorted lists of a part: order[j] has the rows by rising component j, values[j] the components."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x.astype(np.float64), len(x)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.x.T, self.order, axis=1)

    def read(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(upper bounds less that of a row outside, a row outside's upper bound, the same lists' lower
        ends) after `depth` rows of each list; up and down are the positive and negative parts of the queries."""
        above = np.zeros((self.n, len(up)))
        for j, (order, values) in enumerate(zip(self.order, self.values, strict=True)):
            from_top, from_end = slice(self.n - depth, self.n), slice(0, depth)
            if up[:, j].any():
                above[order[from_top]] += (values[from_top] - values[self.n - depth])[:, None] * up[:, j]
            if down[:, j].any():
                above[order[from_end]] += (values[from_end] - values[depth - 1])[:, None] * down[:, j]
        outside = up @ self.values[:, self.n - depth] + down @ self.values[:, depth - 1]
        return above, outside, up @ self.values[:, 0] + down @ self.values[:, -1]

    def candidates(self, queries: np.ndarray, need: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows that can be among the k best of the queries, which must reach need;
        own has the (queries, rows) that are left out."""
        q = queries.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        slack = 1e-9 * (np.abs(q) @ np.abs(self.x).max(axis=0))  # for components too large for exact sums
        for depth in [*(d for share in DEPTHS if (d := int(share * self.n))), self.n]:
            above, outside, least = self.read(depth, up, down)
            above[own[1], own[0]] = -np.inf
            upper = above + outside
            if self.n - 1 > k:  # the k-th lower bound, one row may be the query's own
                lower = np.partition(upper, self.n - k, axis=0)[self.n - k] - (outside - least)
                need = np.maximum(need, lower - slack)
            alive = upper + slack >= need
            if depth == self.n or (outside + slack < need).all() and alive.mean() <= LEFT:
                break
        row, query = np.nonzero(alive & np.isfinite(upper))
        return query, row


def search_block(held: pa.Table, wanted: pa.Table, k: int = K) -> dict:
    x, q = vectors.both_matrices(held["vector"], wanted["vector"])
    rows, copies, ids, own = (held["row"].to_numpy(), held["copies"].to_numpy(), vectors.ids_of(held["vec_id"]), wanted["row"].to_numpy())
    need = np.full(len(q), -np.inf)
    found = [np.zeros(0, np.int64)] * 3  # query, row, score
    a, size = 0, PART
    while a < len(x):
        b = min(len(x), a + size)
        lists = Lists(x[a:b])
        place = vectors.places_of(rows[a:b], own)
        alone = np.flatnonzero((place >= 0) & (copies[a:b][place] == 1))
        for s in range(0, len(q), BUNCH):
            bunch = slice(s, min(len(q), s + BUNCH))
            mine = alone[(alone >= s) & (alone < bunch.stop)]
            i, row = lists.candidates(q[bunch], need[bunch], k, (mine - s, place[mine]))
            score = vectors.pair_scores(q, x, i + s, row + a)
            found = [np.concatenate(c) for c in zip(found, (i + s, row + a, score), strict=True)]
        # a query's own row counts one copy less
        n = copies[found[1]] - (rows[found[1]] == own[found[0]])
        keep, full = vectors.best(found[0], found[2], ids[found[1]], n, k)
        found = [c[keep] for c in found]
        need[found[0][full]] = np.maximum(need[found[0][full]], found[2][full])
        a, size = b, (size if a == 0 else 2 * size)
    n = copies[found[1]] - (rows[found[1]] == own[found[0]])
    place = pa.array(found[1])
    return {"q_row": own[found[0]], "query_id": wanted["vec_id"].take(pa.array(found[0])).combine_chunks(), "q_copies": wanted["copies"].to_numpy()[found[0]], "vec_id": held["vec_id"].take(place).combine_chunks(), "copies": n, "score": found[2]}


def top_k(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row that is_query (an expression
    of vec_id) marks, with all other rows."""
    rows = vectors.integer_rows(df, {"vec_id": F.col(id_col).cast("long")}, vector)
    found = vectors.met(rows, rows.where(is_query), lambda held, wanted: search_block(held, wanted, k), "q_row long, query_id long, q_copies long, vec_id long, copies long, score long")
    best = vectors.ranked(found, ["q_row"], k)
    return best.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("q_copies").cast("int")))).select("query_id", "rank", "vec_id", "score")
