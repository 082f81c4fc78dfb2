"""Best-fit packing of token sequences by a linear grouping scheme.

Texts are tokenised in tasks and cut into pieces of at most `capacity` tokens. A plan needs only the
number of pieces of each length, at most `capacity` numbers, so it is made on those and has a few
thousand rows whatever the input: lengths over capacity / 8 are sorted, divided into groups of equal
cardinality and rounded up to their group's largest; a linear programme over configurations of
these few sizes (columns found by a knapsack) says how often each configuration is used; groups'
slots are filled with the actual lengths, which are shorter; and what is left, then the small ones
in falling order, go where they fit best. The plan is runs: "the pieces of length s ranked a to
a + n lie at offset o of sequences q to q + n". Pieces are ranked within their length by prefix sums
over hash buckets, and look up their run.

Null text is empty. A document's ids are those of the tokenizer's file, and one id 0 at its end.
Only longer documents are cut, from the end, so that the first piece may be shorter. Repeated rows
are packed as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WIDE_ROWS, cut
from .textblocks import slices

CAPACITY, END_ID, GROUPS, LARGE_PART, BUCKETS = 2048, 0, 100, 8, 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of texts as the tokenizer file gives them. If the same vocabulary lies beside it as a rank
    file, texts of plain characters go through that, which is the same merges and faster."""

    #: characters whose classes every regular-expression engine agrees on
    PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ɏ‐-‧€]*")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.fast = Tokenizer.from_file(path), None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and "<|" not in text and self.PLAIN.fullmatch(text):
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n tokens, and n."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def apply(batches):
        encoder = Encoder(path or tokenizer_file())
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    at = cut_points(len(ids), capacity)
                    out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, PIECES)


def equal_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in falling order, dealt into groups of equal cardinality: lists of (length, count)."""
    total = sum(counts.values())
    each, out, room = max(1, -(-total // groups)), [], 0
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            if not room:
                out.append([])
                room = each
            n = min(left, room)
            out[-1].append((s, n))
            left, room = left - n, room - n
    return out


def best_configuration(value: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, list[int]]:
    """The multiset of sizes within capacity with the greatest value (an unbounded knapsack)."""
    by, most = np.array(sizes), max(sizes)
    best, last = np.full(capacity + 1 + most, -np.inf), np.full(capacity + 1, -1)  # best[c + most] is of capacity c
    best[most] = 0
    for c in range(1, capacity + 1):
        with_one = best[c + most - by] + value
        i = int(with_one.argmax())
        if with_one[i] > best[c + most - 1] + 1e-12:
            best[c + most], last[c] = with_one[i], i
        else:
            best[c + most] = best[c + most - 1]
    out, c = [0] * len(sizes), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity + most]), out


def optimise(sizes: list[int], need: list[int], capacity: int, rounds: int = 2000, gap: float = 2e-4) -> list[tuple[list[int], int]]:
    """Configurations (slots of each size) and how often each is used, rounded down: the simplex
    method with generated columns. Slots never exceed need."""
    m = len(sizes)
    basis = [[capacity // s if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    b = np.array(need, float)
    for _ in range(rounds):
        a = np.array(basis, float).T
        x = np.linalg.solve(a, b)
        dual = np.linalg.solve(a.T, np.ones(m))
        value, column = best_configuration(np.maximum(dual, 0), sizes, capacity)
        if value <= 1 + gap:  # then the programme is within this part of its optimum
            break
        d = np.linalg.solve(a, np.array(column, float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[leave] = column
    x = np.linalg.solve(np.array(basis, float).T, b)
    left, out = list(need), []
    for config, times in zip(basis, x, strict=True):
        n = int(min([np.floor(max(times, 0) + 1e-6), *(left[i] // k for i, k in enumerate(config) if k)]))
        if n > 0:
            out.append((config, n))
            left = [v - n * k for v, k in zip(left, config, strict=True)]
    return out


class Plan:
    """Runs (length, first rank, n, first sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.rank: dict[int, int] = {}
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, n)]

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        at = self.rank.get(length, 0)
        self.runs.append((length, at, n, sequence, offset))
        self.rank[length] = at + n

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def leave(self, room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            self.open.setdefault(room, []).append((sequence, n))

    def fill(self, length: int, n: int, sequence: int, bins: int, room: int) -> int:
        """Puts up to n pieces into so many bins of equal room, one bin after the other; returns
        how many are left."""
        each, used = room // length, self.capacity - room
        full = min(bins, n // each)
        for j in range(each if full else 0):
            self.put(length, full, sequence, used + j * length)
        self.leave(room - each * length, sequence, full)
        n -= full * each
        rest = bins - full
        if rest and n:  # fewer than one bin takes
            for j in range(n):
                self.put(length, 1, sequence + full, used + j * length)
            self.leave(room - n * length, sequence + full, 1)
            rest, n, full = rest - 1, 0, full + 1
        self.leave(room, sequence + full, rest)
        return n

    def best_fit(self, length: int, n: int) -> None:
        while n:
            room = min((r for r, at in self.open.items() if r >= length and at), default=None)
            if room is None:
                bins = -(-n // (self.capacity // length))
                n = self.fill(length, n, self.new(bins), bins, self.capacity)
            else:
                sequence, bins = self.open[room].pop()
                n = self.fill(length, n, sequence, bins, room)


def plan_of(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """A plan for so many pieces of each length."""
    plan, left = Plan(capacity), {s: n for s, n in counts.items() if n}
    if full := left.pop(capacity, 0):
        plan.put(capacity, full, plan.new(full), 0)
    large = equal_groups({s: n for s, n in left.items() if s * LARGE_PART > capacity}, groups)
    if large:
        stock = [list(reversed(g)) for g in large]  # (length, count), the longest last
        for config, times in optimise([g[0][0] for g in large], [sum(n for _, n in g) for g in large], capacity):
            slots = []
            for i, k in enumerate(config):
                for _ in range(k):
                    due, took = times, []
                    while due:
                        s, n = stock[i].pop()
                        take = min(n, due)
                        took.append((s, take))
                        if n > take:
                            stock[i].append((s, n - take))
                        due -= take
                    slots.append(took)
            sequence, at = plan.new(times), [[0, t[0][1]] for t in slots]
            while times:  # as far as every slot keeps its length
                n, offset = min(a[1] for a in at), 0
                for slot, a in zip(slots, at, strict=True):
                    s = slot[a[0]][0]
                    plan.put(s, n, sequence, offset)
                    left[s] -= n
                    offset += s
                    a[1] -= n
                    if not a[1] and a[0] + 1 < len(slot):
                        a[0] += 1
                        a[1] = slot[a[0]][1]
                plan.leave(capacity - offset, sequence, n)
                sequence, times = sequence + n, times - n
    for s in sorted(left, reverse=True):
        plan.best_fit(s, left[s])
    return plan


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = cut(tokenise(docs, path, capacity), WIDE_ROWS)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = pd.DataFrame(sorted(plan_of(counts, capacity).runs), columns=["length", "rank", "n", "sequence", "offset"]).astype("int64")
    wide = 1 << 45
    keys = (runs["length"] * wide + runs["rank"]).to_numpy()
    first, sequence, offset = runs["rank"].to_numpy(), runs["sequence"].to_numpy(), runs["offset"].to_numpy()

    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = spread.join(starts, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1)

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = np.searchsorted(keys, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[run] + rank - first[run]), pa.array(offset[run])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
