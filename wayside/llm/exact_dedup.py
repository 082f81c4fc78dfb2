"""Exact dedup by a tree merge of sorted digest runs.

Each scan task turns its rows into runs: arrays sorted by key, a key once, with the identifier to
keep and a count, cut into slices of the key space. A run's slice travels as one row. In each round
of the tree, `fan` neighbouring runs meet slice by slice, in a task that merges them two and two, in
binomial order, by binary search; equal neighbours become one entry, which keeps the largest (or
smallest) identifier and the sum of the counts. So runs stay sorted from level to level and no level
sorts again. A third of all rows with one text are one entry a run before the first exchange. The
key is the SHA-256 of the text, its length in bytes and a second 64-bit hash, so entries merge only
where all three agree. The number of slices follows the number of rows, about ROWS_IN_SLICE to each.

Null text counts as empty. Identifiers are integers. Rows that repeat both doc_id and text are copies
like any other; they cannot be told apart, so the table marks each of them kept, while
drop_duplicates returns one. A null doc_id loses against any other; a group of only null ids keeps
null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_IDS, hot_keys, salted_join, unused, written

RUNS, FAN, ROWS_IN_SLICE, RUN_ROWS = 64, 8, 200_000, 500_000
KEY = ["digest", "n_bytes", "second"]
_WIDTH = 48  # digest, then length and second hash, big endian
_NONE = np.iinfo(np.int64).min
_RUN = "run int, slice int, keys binary, ids binary, sizes binary"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = _text(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("second"),
    )


Run = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys in rising order, ranks of identifiers, counts


def collapse(run: Run) -> Run:
    """One entry for equal neighbours: the largest rank, the sum of the counts."""
    keys, ids, sizes = run
    if not len(keys):
        return run
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.maximum.reduceat(ids, first), np.add.reduceat(sizes, first)


def merge_two(x: Run, y: Run) -> Run:
    """Two sorted runs as one."""
    at = np.searchsorted(x[0], y[0], "right") + np.arange(len(y[0]))
    rest = np.ones(len(x[0]) + len(y[0]), bool)
    rest[at] = False
    out = []
    for a, b in zip(x, y, strict=True):
        c = np.empty(len(rest), a.dtype)
        c[at], c[rest] = b, a
        out.append(c)
    return collapse((out[0], out[1], out[2]))


def merge_all(runs: list[Run]) -> Run:
    """Sorted runs as one: in each round, every run with an odd place joins its left neighbour."""
    while len(runs) > 1:
        runs = [merge_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _rows_of(run: int, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, bits: int) -> dict[str, list]:
    """A sorted run as a row for each of 2 ** bits slices that it has keys of."""
    lead = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, _WIDTH)[:, :4].astype(np.int64)
    number = (lead[:, 0] << 24 | lead[:, 1] << 16 | lead[:, 2] << 8 | lead[:, 3]) >> (32 - bits)
    edge = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))).tolist() if len(keys) else []
    part = [slice(a, b) for a, b in zip(edge, [*edge[1:], len(keys)], strict=True)]
    cut = lambda v: [v[p].tobytes() for p in part]
    return {"run": [run] * len(part), "slice": number[edge].tolist(), "keys": cut(keys), "ids": cut(ids), "sizes": cut(sizes)}


_ARROW = pa.schema([("run", pa.int32()), ("slice", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])


def first_runs(digests: DataFrame, sign: int, runs: int, bits: int) -> DataFrame:
    """The sorted runs of each scan task, RUN_ROWS rows at most in one."""

    def apply(batches):
        run, held, rows = TaskContext.get().partitionId() % runs, [], 0

        def flush():
            keys, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            return pa.RecordBatch.from_pydict(_rows_of(run, *collapse((keys[order], ids[order], np.ones(len(keys), np.int64))), bits), _ARROW)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = np.empty((n, _WIDTH), np.uint8)
            raw[:, :32] = np.frombuffer(b"".join(batch["digest"].to_pylist()), np.uint8).reshape(n, 32)
            for at, c in ((32, "n_bytes"), (40, "second")):
                raw[:, at : at + 8] = batch[c].to_numpy().astype(">i8").view(np.uint8).reshape(n, 8)
            ids = batch["doc_id"].fill_null(0).to_numpy() * sign
            held.append((raw.view(f"S{_WIDTH}")[:, 0], np.where(batch["doc_id"].is_null().to_numpy(zero_copy_only=False), _NONE, ids)))
            rows += n
            if rows >= RUN_ROWS:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return digests.mapInArrow(apply, _RUN)


def merge_runs(digests: DataFrame, keep: str = "max", runs: int = RUNS, fan: int = FAN, rows_in_slice: int = ROWS_IN_SLICE) -> DataFrame:
    """One row per key: keep_id and group_size."""
    sign = 1 if keep == "max" else -1  # ranks of identifiers: the largest wins, null is below all
    bits = min(24, max(4, (digests.count() // rows_in_slice).bit_length()))
    level = first_runs(digests, sign, runs, bits)

    def merge(table: pa.Table) -> pa.Table:
        found = [(np.frombuffer(k, f"S{_WIDTH}"), np.frombuffer(i, np.int64), np.frombuffer(s, np.int64)) for k, i, s in zip(*(table[c].to_pylist() for c in ("keys", "ids", "sizes")), strict=True)]
        return pa.Table.from_pydict(_rows_of(table["run"][0].as_py(), *merge_all(found), bits), _ARROW)

    while runs > 1:
        runs = -(-runs // fan)
        level = level.withColumn("run", F.floor(F.col("run") / fan).cast("int")).groupBy("run", "slice").applyInArrow(merge, _RUN)

    def entries(batches):
        for batch in batches:
            for keys, ids, sizes in zip(*(batch[c].to_pylist() for c in ("keys", "ids", "sizes")), strict=True):
                raw, rank = np.frombuffer(keys, np.uint8).reshape(-1, _WIDTH), np.frombuffer(ids, np.int64)
                number = lambda at: pa.array(np.ascontiguousarray(raw[:, at : at + 8]).view(">i8")[:, 0].astype(np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in raw[:, :32]], pa.binary()), number(32), number(40), pa.array(np.where(rank == _NONE, 0, rank * sign), mask=rank == _NONE), pa.array(np.frombuffer(sizes, np.int64))],
                    names=[*KEY, "keep_id", "group_size"],
                )

    return level.mapInArrow(entries, "digest binary, n_bytes long, second long, keep_id long, group_size long")


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """doc_id, the key, keep_id, group_size and kept of every row; rows of a very large group are dealt
    to many tasks."""
    digests = _digests(docs, id_col, text_col)
    groups = written(merge_runs(digests, keep))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    rows = salted_join(digests, groups, KEY, hot_keys(groups, KEY, "group_size", total), ["doc_id"])
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = _judged(docs, id_col, text_col, keep)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs, one row of each text: the columns of docs, in their order. Texts themselves are not
    exchanged: the rows to drop are found by id and digest, and their marks (SENT_IDS of 16 bytes at
    most, else by shuffle) meet the rows."""
    m, s, r = unused(docs, "_mark", "_state", "_row")
    mark = lambda i, d: F.unhex(F.md5(F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("none")), d)))
    rows = _judged(docs, id_col, text_col, keep)
    marks = rows.groupBy(mark(F.col("doc_id"), F.lower(F.hex("digest"))).alias(m)).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    marks = written(marks.where("NOT kept OR n > 1").select(m, F.col("kept").alias(s)))  # dropped, or kept once of several
    counts = marks.agg(F.count("*"), F.count(F.when(F.col(s), 1))).first()
    own = docs.withColumn(m, mark(F.col(id_col).cast("long"), F.sha2(_text(text_col).cast("binary"), 256)))
    found = own.join(F.broadcast(marks) if counts[0] <= SENT_IDS else marks, m, "left")
    out = found.where(F.col(s).isNull()).select(*docs.columns)
    if counts[1]:
        several = found.where(s).groupBy(m).agg(F.min(F.struct(*docs.columns)).alias(r))
        out = out.union(several.select(*[F.col(r)[c].alias(c) for c in docs.columns]))
    return out
