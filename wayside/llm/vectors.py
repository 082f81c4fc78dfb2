"""Integer vectors in blocks, and what the searches over them share.

Rows that take no part (a null vector, a null or non-finite component) are left out; each component x
becomes floor(256 * x). Rows equal in every column become one with a number of copies, so a third of
all rows may be one row. Each different row gets a number when the table is written. Rows are dealt by
their number to blocks, queries to groups, and each group meets each block in one task: a stated set of
queries against all rows, with bounded memory (BLOCK_ROWS rows, GROUP_ROWS queries). A block gets larger
with the table, up to BLOCK_ROWS, so that the rows a query gets back, a few a block, stay few.

Inner products are exact: by float64 where every partial sum is below 2**53, else by Python's integers (a
score outside 64 bits is an error). A vector shorter than another counts as padded with zeros. Null ids
come last among ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS, LEAST_ROWS, GROUP_ROWS = 1 << 16, 1024, 8192
_LAST = np.iinfo(np.int64).max


def integer_rows(df: DataFrame, columns: dict[str, Column], vector: str = "embedding") -> DataFrame:
    """row, the given columns, vector (array<long>), copies: the different rows that take part, written."""
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = df.where(sound).select(*[c.alias(n) for n, c in columns.items()], F.transform(x, lambda v: F.floor(256 * v.cast("double")).cast("long")).alias("vector"))
    return written(rows.groupBy(*columns, "vector").agg(F.count("*").alias("copies")).withColumn("row", F.monotonically_increasing_id()))


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """The vectors of a column of lists as the rows of an int64 matrix at least so wide."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(width, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def both_matrices(x: pa.ChunkedArray, y: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    a = matrix(x)
    b = matrix(y, a.shape[1])
    return matrix(x, b.shape[1]), b


def exact_in_floats(x: np.ndarray, y: np.ndarray) -> bool:
    return float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) < 2.0**53


def pair_scores(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of x[i] and y[j]."""
    kind = np.int64 if exact_in_floats(x, y) else object
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 14):
        p = slice(a, a + (1 << 14))
        out[p] = np.einsum("ij,ij->i", x[i[p]], y[j[p]]) if kind is np.int64 else [int(np.dot(x[u].astype(object), y[v].astype(object))) for u, v in zip(i[p], j[p], strict=True)]
    return out


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids for ordering; null counts as the largest."""
    return column.combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy()


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, full): of each query's finds those before which fewer than k copies come, in order of
    query, falling score and rising id; full marks the find with which a query has k."""
    order = np.lexsort((ids, -score, query))
    q, c = query[order], np.minimum(copies[order], k)
    total = np.cumsum(c)
    first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1) != 0)
    ahead = total - c - np.repeat((total - c)[first], np.diff(np.append(first, len(q))))
    return order[ahead < k], (ahead < k)[ahead < k] & (ahead + c >= k)[ahead < k]


def blocks_of(n: int) -> int:
    """The number of blocks of n rows."""
    return max(1, -(-n // min(BLOCK_ROWS, max(LEAST_ROWS, 8 * isqrt(n)))))


def met(rows: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """What search(block of rows, group of queries) returns for every block and group: columns of schema."""
    many, groups = blocks_of(rows.count()), max(1, -(-queries.count() // GROUP_ROWS))
    place = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("_b", place(many, 0)).withColumn("_g", each(groups))
    asked = queries.withColumn("_g", place(groups, 1)).withColumn("_b", each(many))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])

    def task(held: pa.Table, wanted: pa.Table) -> pa.Table:
        wanted = wanted.rename_columns([c[2:] for c in wanted.column_names])
        out = search(held, wanted) if held.num_rows and wanted.num_rows else {}
        kinds = [f.split() for f in schema.split(", ")]
        return pa.table({n: pa.array(out.get(n, []), {"long": pa.int64(), "int": pa.int32()}[kind]) for n, kind in kinds})

    return dealt.groupBy("_b", "_g").cogroup(asked.groupBy("q__b", "q__g")).applyInArrow(task, schema)


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best finds (score, vec_id, copies) of each query, one row a copy, with their rank from 1."""
    each = found.withColumn("copies", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("copies")


def places_of(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where in a block each query's own row is (row numbers own), or -1."""
    order = np.argsort(rows)
    at = order[np.minimum(np.searchsorted(rows, own, sorter=order), len(rows) - 1)]
    return np.where(rows[at] == own, at, -1)
