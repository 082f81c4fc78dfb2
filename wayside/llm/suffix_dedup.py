"""Suffix-array dedup of repeated strings of WINDOW bytes.

Every WINDOW-byte string (a window) has an anchor: the place of the smallest hash of KGRAM bytes in
it, the rightmost of several. Equal windows have equal anchors, so an anchor's surroundings are all
that has to meet. An anchor owns the windows it is the anchor of. Windows are split by how many
bytes lie before their anchor: in two halves at first, whose common bytes (the core, 217 of 400) are
hashed; where a core occurs in two places of distinct texts, the owner's windows are split again,
into steps of STEP windows with a core of 378 bytes, hashed to 128 bits. What is left of a window
is then at most STEP - 1 bytes on both sides of the core together.

Pieces (bytes before, core, bytes after) that occur twice need no sorting: all their windows repeat.
The different pieces around one core are written as strings in which the core is one symbol, and a
suffix array of them is built by linear grouping: groups of suffixes with one Lyndon prefix are
processed from the largest to the smallest, pointers to the previous smaller suffix are set, and the
suffixes they point to move to new groups; then each group's order is emitted through the same
pointers. Neighbours in the array that agree in STEP symbols are repeated windows. Around one core
with more than BLOCK different pieces (a passage that very many documents hold begins or ends
there), windows are compared by grouping in Spark instead, so no task holds them all.

Texts are told apart by half of their SHA-256; those that equal another have windows that all repeat.
Joins on cores and pieces deal the rows of a hot key to many groups. Matches never cross documents,
and overlaps in one document count. Null text is empty. Shorter texts than WINDOW lose nothing. Rows
that repeat are copies of each other. doc_id may be null and is only passed through.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_ROWS, among, hot_keys, salted_join, written
from .textblocks import _INV, _POW, mix, slices, texts_of

WINDOW, KGRAM, STEP, BLOCK = 400, 33, 23, 2000
SPAN = WINDOW - KGRAM + 1  # k-grams in a window; windows of an anchor have 0 to SPAN - 1 bytes before it
SEGMENT, SA_SYMBOLS = 1 << 16, 60_000
_U = np.uint64
_SALT = _U(0xA0761D6478BD642F)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text, an array of positive integers."""
    s = np.append(text, 0)
    n = len(s)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(first, n))
    begin = np.empty(n, np.int64)
    begin[order] = np.repeat(first, sizes)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    sa, place, group, size, before = order.tolist(), at.tolist(), begin.tolist(), [0] * n, [-1] * n
    for a, k in zip(first.tolist(), sizes.tolist(), strict=True):
        size[a] = k
    high = n - 1
    while high >= 0:
        low = group[sa[high]]
        members = sa[low : high + 1]
        if high > low:
            members.sort()
        hits: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        # suffixes followed by more repeats of this group's prefix go to higher groups
        repeats = set(hits.values())
        for times in sorted(repeats, reverse=True):
            moved: dict[int, int] = {}
            for p, k in hits.items():
                if k == times:
                    g = group[p]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    to, was = g + size[g] - m, place[p]
                    other = sa[to]
                    sa[to], sa[was], place[p], place[other] = p, other, to, was
            for g, m in moved.items():
                size[g] -= m
                new = g + size[g]
                size[new] = m
                if size[g]:
                    for q in range(new, new + m):
                        group[sa[q]] = new
        high = low - 1
    out, front, placed = [0] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    front[0] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = before[j]
    return np.array(out[1:], np.int64)


class Hashes:
    """Hashes of any span of up to SEGMENT and some bytes, from running sums."""

    def __init__(self, data: np.ndarray, second: bool = False):
        v = data.astype(np.uint64) + _U(1)
        if second:
            v = mix(v * _SALT)
        self.total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * _POW[: len(v)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * _INV[a] + (b - a).astype(np.uint64))


def segments(data: np.ndarray, off: np.ndarray):
    """(start, bytes, ends of rows in them): stretches of whole short rows, or parts of a long one, so
    that every window is in exactly one."""
    rows, r = len(off) - 1, 0
    while r < rows:
        a = int(off[r])
        if off[r + 1] - a > SEGMENT:
            for p in range(a, int(off[r + 1]) - WINDOW + 1, SEGMENT):
                piece = data[p : min(off[r + 1], p + SEGMENT + WINDOW - 1)]
                yield p, piece, np.array([len(piece)])
            r += 1
        else:
            to = max(r + 1, int(np.searchsorted(off, a + SEGMENT, "right")) - 1)
            if off[to] - a >= WINDOW:
                yield a, data[a : off[to]], off[r + 1 : to + 1] - a
            r = to


def anchors(data: np.ndarray, hashes: Hashes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each anchor; windows don't cross the ends."""
    n = len(data) - KGRAM + 1
    i = np.arange(n)
    v = (hashes.of(i, i + KGRAM) & _U(0xFFFFFFFFFF000000)) | (_U(0xFFFFFF) - i.astype(np.uint64))
    blocks = -(-n // SPAN)
    grid = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = v
    grid = grid.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    p = n - SPAN + 1
    least = np.minimum(back[:p], ahead[SPAN - 1 : SPAN - 1 + p])
    where = (_U(0xFFFFFF) - (least & _U(0xFFFFFF))).astype(np.int64)
    whole = np.ones(p, bool)
    for e in ends:
        whole[max(0, e - WINDOW + 1) : e] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return at, at, at
    where = where[at]
    edge = np.flatnonzero((where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    lo = np.concatenate(([0], edge))
    hi = np.concatenate((edge, [len(at)])) - 1
    return where[lo], at[lo], at[hi]


def half_cores(texts: DataFrame) -> DataFrame:
    """uid, at, lo, hi, key: for each half of an anchor's windows, the hash of what they share."""
    half = SPAN // 2

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, off = texts_of(part["text"])
                uid, out = part["uid"], []
                for start, piece, ends in segments(data, off):
                    h = Hashes(piece)
                    at, lo, hi = anchors(piece, h, ends)
                    row = np.searchsorted(off, at + start, "right") - 1
                    shift = start - off[row]  # places count from the beginning of their text
                    for j in (0, 1):  # windows with less than half, or at least half, before the anchor
                        has = (at - lo >= half) if j else (at - hi < half)
                        a, d = (at - half * j)[has], shift[has]
                        key = mix(h.of(a, a + KGRAM + SPAN - half) + _U(j))
                        out.append((row[has], at[has] + d, lo[has] + d, hi[has] + d, key.view(np.int64)))
                if out:
                    rows, *numbers = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([uid.take(pa.array(rows)), *map(pa.array, numbers)], names=["uid", "at", "lo", "hi", "key"])

    return texts.mapInArrow(apply, "uid binary, at long, lo long, hi long, key long")


RECORD = "core_a long, core_b long, before binary, after binary, uid binary, base long"


def step_cores(texts: DataFrame) -> DataFrame:
    """The pieces of texts (uid, text, found: their shared anchors): core_a, core_b, the bytes before
    and after the core that owned windows need, uid, and base, where the window with none before begins."""

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, off = texts_of(part["text"])
                uid, found, out = part["uid"].to_pylist(), part["found"].to_pylist(), []
                for row in range(part.num_rows):
                    text = data[off[row] : off[row + 1]]
                    own = sorted({(f["at"], f["lo"], f["hi"]) for f in found[row]})
                    i = 0
                    while i < len(own):  # as many anchors as lie in one segment
                        start, k = own[i][1], i + 1
                        while k < len(own) and own[k][2] + WINDOW - start <= SEGMENT:
                            k += 1
                        last = max(o[2] for o in own[i:k])
                        piece = text[start : last + WINDOW]
                        one, two, raw = Hashes(piece), Hashes(piece, True), piece.tobytes()
                        at, lo, hi = (np.array(c) - start for c in zip(*own[i:k], strict=True))
                        for j in range(SPAN // STEP):
                            most = np.minimum(at - lo, STEP * j + STEP - 1) - STEP * j
                            least = np.maximum(at - hi, STEP * j) - STEP * j
                            has = most >= least
                            base, m, n = (at - STEP * j)[has], most[has], least[has]
                            end = base + WINDOW - STEP + 1
                            a, b = one.of(base, end) + _U(j), two.of(base, end) + _U(j)
                            for x, y, e, m1, n1, u, v in zip(base.tolist(), base.tolist(), end.tolist(), m.tolist(), n.tolist(), a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True):
                                out.append((u, v, raw[x - m1 : x], raw[e : e + STEP - 1 - n1], uid[row], y + start))
                        i = k
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["core_a", "core_b", "before", "after", "uid", "base"])

    return texts.mapInArrow(apply, RECORD)


def repeated_windows(group: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """For each piece, a bit for each number of bytes before the core (up to STEP - 1): whether the
    window that begins there equals one of another piece of its group."""
    parts, starts, owner, bits, at = [], [], [], [], 0
    for i, (g, x, y) in enumerate(zip(group.tolist(), before, after, strict=True)):
        parts += [np.frombuffer(x, np.uint8) + np.int64(2), [258 + g], np.frombuffer(y, np.uint8) + np.int64(2), [1]]
        for m in range(STEP - 1 - len(y), len(x) + 1):
            starts.append(at + len(x) - m)
            owner.append(i)
            bits.append(m)
        at += len(x) + len(y) + 2
    text = np.concatenate(parts).astype(np.int64)
    which = np.full(len(text), -1)
    which[starts] = np.arange(len(starts))
    order = which[suffix_array(text)]
    order = order[order >= 0]  # windows, in the order of the suffixes that begin with them
    words = text[np.array(starts)[order][:, None] + np.arange(STEP)]
    same = (words[1:] == words[:-1]).all(axis=1)
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    masks = np.zeros(len(before), np.int64)
    np.bitwise_or.at(masks, np.array(owner)[order[again]], np.int64(1) << np.array(bits)[order[again]])
    return masks


def sorted_masks(pieces: DataFrame) -> DataFrame:
    """core_a, core_b, before, after, mask of pieces, all those of a core being in one task."""

    def apply(batches):
        def solve(rows):
            group = np.cumsum([0, *(a[:2] != b[:2] for a, b in pairwise(rows))])
            masks = repeated_windows(group, [r[2] for r in rows], [r[3] for r in rows])
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)), pa.array(masks)], names=["core_a", "core_b", "before", "after", "mask"])

        held, symbols = [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("core_a", "core_b", "before", "after")), strict=True):
                if symbols >= SA_SYMBOLS and row[:2] != held[-1][:2]:
                    yield solve(held)
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[2]) + len(row[3]) + 2
        if held:
            yield solve(held)

    # a stated number of partitions: few bytes are much work here, so they must not be put together
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select("core_a", "core_b", "before", "after").repartition(parts, "core_a", "core_b").sortWithinPartitions("core_a", "core_b")
    return rows.mapInArrow(apply, "core_a long, core_b long, before binary, after binary, mask long")


def grouped_masks(pieces: DataFrame) -> DataFrame:
    """The same for cores with very many pieces, by grouping windows."""
    key = ["core_a", "core_b"]
    rows = pieces.withColumn("m", F.explode(F.sequence(STEP - 1 - F.length("after"), F.length("before"))))
    window = F.concat(F.expr("substring(before, length(before) - m + 1, m)"), F.lit(b"|"), F.expr(f"substring(after, 1, {STEP - 1} - m)"))
    rows = rows.select(*key, "before", "after", "m", window.alias("window"))
    often = written(rows.groupBy(*key, "m", "window").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(often, [*key, "m", "window"], "n", total)
    found = salted_join(rows, often.drop("n"), [*key, "m", "window"], hot, ["before", "after"], "left_semi")
    return found.groupBy(*key, "before", "after").agg(F.expr("bit_or(shiftleft(1L, m))").alias("mask"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"sha": F.sha2(F.col("text").cast("binary"), 256), "n_bytes": F.octet_length("text").cast("long")}).withColumn("uid", F.unhex(F.substring("sha", 1, 32)))


def removals(texts: DataFrame) -> DataFrame:
    """uid, runs: for each text with repeated windows, array of (base, mask); a window with m bytes
    before its core begins at base - m."""
    halves = written(half_cores(texts.where(F.col("n_bytes") >= WINDOW).select("uid", "text")), rows=WIDE_ROWS)
    place = F.xxhash64("uid", "at")
    shared = halves.groupBy("key").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count("*").alias("n")).where("p <> q").select("key", "n")
    shared = written(shared)
    hot = hot_keys(shared, ["key"], "n", halves.count())
    found = salted_join(halves, shared.select("key"), ["key"], hot, ["uid", "at"], "left_semi")
    found = written(found.select("uid", "at", "lo", "hi").distinct())
    own = among(texts, found.select("uid").distinct())
    found = found.groupBy("uid").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("found"))
    one = own.groupBy("uid").agg(F.min("doc_id").alias("doc_id"))  # a row for each text
    found = found.join(one, "uid").select(F.col("uid").alias("f_uid"), F.col("doc_id").alias("f_doc_id"), "found")
    rows = own.select("uid", "doc_id", "text").join(found, (F.col("uid") == F.col("f_uid")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id"))).select("uid", "text", "found")
    records = written(step_cores(rows), rows=WIDE_ROWS)
    key = ["core_a", "core_b"]
    piece = [*key, "before", "after"]
    pieces = written(records.groupBy(*piece).agg(F.count("*").alias("n")))
    cores = written(pieces.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1"))
    twice = F.when(F.col("n") > 1, F.expr(f"shiftleft(1L, cast(length(before) + 1 AS int)) - shiftleft(1L, cast({STEP - 1} - length(after) AS int))"))
    whole = pieces.where("n > 1").select(*piece, twice.alias("mask"))
    several = written(salted_join(pieces, cores, key, hot_keys(cores, key, "m", pieces.count()), ["before", "after"]))
    masks = whole.unionByName(sorted_masks(several.where(F.col("m") <= BLOCK))).unionByName(grouped_masks(several.where(F.col("m") > BLOCK)))
    masks = masks.groupBy(*piece).agg(F.expr("bit_or(mask)").alias("mask")).where("mask <> 0")
    hit = salted_join(records, masks, piece, hot_keys(pieces, piece, "n", records.count()), ["uid", "base"])
    return hit.groupBy("uid").agg(F.collect_list(F.struct("base", "mask")).alias("runs"))


def covered(n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Whether each of n bytes lies in a removed window."""
    change = np.zeros(n + 1, np.int64)
    base = np.array([r[0] for r in runs])
    mask = np.array([r[1] for r in runs])
    for m in range(STEP):
        p = base[mask >> m & 1 == 1] - m
        np.add.at(change, p, 1)
        np.add.at(change, p + WINDOW, -1)
    return np.cumsum(change[:n]) > 0


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds kept (binary).
    Texts are read again only where a part is cut out; a text that stays whole has its own digest."""
    texts = _texts(docs)
    long = texts.where(F.col("n_bytes") >= WINDOW)
    groups = long.groupBy("uid").agg(F.count("*").alias("n"))
    state = written(groups.join(removals(texts), "uid", "left").where("n > 1 OR runs IS NOT NULL"))
    parts = state.where("n = 1").select("uid", "runs")
    out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] * with_text)]

    wide = texts.select("doc_id", "uid", "n_bytes", "sha", *([F.col("text").cast("binary").alias("kept")] * with_text))
    hot = hot_keys(state, ["uid"], "n", max(1, texts.count()))
    marks = state.select("uid", (F.col("n") > 1).alias("copied"))
    rows = salted_join(wide, marks, ["uid"], hot, ["doc_id"], "left").where("copied IS NULL OR copied")
    gone, none = F.col("copied").isNotNull(), hashlib.sha256(b"").hexdigest()
    rows = rows.withColumns({
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(0), "n_spans": gone.cast("long"),
        "kept_sha256": F.when(gone, F.lit(none)).otherwise(F.col("sha")), **({"kept": F.when(gone, F.lit(b"")).otherwise(F.col("kept"))} if with_text else {}),
    })

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                for doc_id, text, runs in zip(*(part[c].to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                    raw = text.encode()
                    hit = covered(len(raw), [(r["base"], r["mask"]) for r in runs])
                    kept = np.frombuffer(raw, np.uint8)[~hit].tobytes()
                    made.append((doc_id, len(raw), int(hit.sum()), int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()), hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types[: len(out)], strict=True)], names=out)

    cut = among(texts.select("doc_id", "uid", "text"), parts.select("uid")).join(parts, "uid").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.select(*out).unionByName(cut.mapInArrow(apply, schema))
