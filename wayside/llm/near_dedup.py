"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct 3-word shingles (k is a parameter), as 64-bit hashes. Documents with
equal sets are one class from the start. A class has a signature of COORDINATES minima; it is posted
under (coordinate, value) pairs. Two documents of the wanted similarity agree in at least
matches_for() coordinates but for two links in a million at most, so they meet under two of their
COORDINATES - matches + 2 rarest pairs: only those are posted (the prefix), pairs that one class
alone has are skipped, and lists of common values are never merged. Collisions of coordinates are
then counted on the signatures, and pairs with as many matches are confirmed on the full sets.

A posting list is not expanded into all pairs. First each list's most typical class, the one whose
values are the most common, is compared with the rest of its list: as many pairs as postings. The
links found make components; what is left are pairs of classes in different components, other than
those compared. Only lists that still hold such pairs are gone through. Of each pair left, one is a
stranger: outside its list's largest component. Members are dealt to blocks of about BLOCK classes
or BLOCK_BYTES of sets, strangers likewise, and every member block meets every stranger block, so a
list of n members with few strangers costs about n rows. A list with more than a block of strangers is
gone through by a second value: its classes meet under each other value of their prefixes (with a
larger coordinate, as a pair belongs to the first two values that it shares), so a value that many
classes share and nothing else brings no two of them together. A task counts collisions of a block pair in
numpy, confirms on the full sets it was given, and returns links that join components, at most one
fewer than its classes. Every join on a value, a leader or a hub, which may hold very many rows, is
followed by an exchange on other columns, so Spark may split its tasks (adaptive skew joins).

Null, empty and blank texts have empty sets and are linked with nothing. Texts of fewer than k words
have one shingle, the whole sequence. Rows with a null doc_id are linked with nothing and kept.
Repeated rows are in one class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_ROWS, among, cut, unused
from .textblocks import hash_spans, mix, slices, texts_of, windows_of, word_bounds

SHINGLE, COORDINATES, BLOCK, BLOCK_BYTES = 3, 48, 1024, 8 << 20
MIN_PERCENT, MISSED = 85, 2e-6
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**64, COORDINATES, np.uint64)
_MUL = _RNG.integers(0, 2**63, COORDINATES, np.uint64) * _U(2) + _U(1)


def matches_for(percent: int) -> int:
    """Coordinates that two sets of this similarity share but for a chance of at most MISSED."""
    p, below, m = percent / 100, 0.0, 0
    while m < COORDINATES and (below := below + math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= MISSED:
        m += 1
    return max(1, m)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, begin): the distinct shingle hashes of each row in rising order, and where each
    row's begin (rows + 1 numbers)."""
    data, off = texts_of(column)
    starts, ends, first = word_bounds(data, off)
    values, begin = windows_of(hash_spans(data, starts, ends), first, k, short=True)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    inner = begin[:-1][np.diff(begin) > 0]
    new[inner] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return values[new], kept[begin]


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (hashes of the whole set), sig (minima; empty for empty sets)."""

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                values, begin = shingle_sets(part["text"], k)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                at = begin[:-1][full]
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig = np.zeros((len(full), COORDINATES), np.uint32)
                if len(full):
                    a[full] = np.add.reduceat(mix(values * _U(0xA24BAED4963EE407)), at)
                    b[full] = np.bitwise_xor.reduceat(mix(values + _U(0x9FB21C651E98DF25)), at)
                    for c in range(COORDINATES):
                        sig[:, c] = np.minimum.reduceat((values ^ _XOR[c]) * _MUL[c], at) >> _U(32)
                ends = np.concatenate(([0], np.cumsum(n > 0) * COORDINATES)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel().view(np.int32)))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, schema)


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """key, rep, common: the prefix postings of classes (rep, sig), in which two classes with enough
    matches share two keys (one, if one match is enough); common grows with how usual a class's values are."""
    each = classes.select("rep", F.posexplode("sig").alias("c", "v"))
    each = each.select("rep", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = each.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"))
    # values that no other class has are the rarest: they use up the prefix first
    room = F.size("found") - matches + 1
    prefix = F.expr(f"slice(found, 1, greatest(0, size(found) - {max(0, matches - 2)}))")
    rows = lists.where(room > 0).select("rep", F.expr("aggregate(found, 0L, (a, x) -> a + x.n)").alias("common"), F.explode(prefix).alias("p"))
    return rows.select("p.key", "rep", "common")


def _matches(a: str, b: str):
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x = y AS int)), 0, (s, x) -> s + x)")


def star_pairs(posted: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Distinct (a, b): each list's most typical class with every other, if enough coordinates collide."""
    top = posted.groupBy("key").agg(F.max(F.struct("common", "rep")).alias("top")).select("key", F.col("top.rep").alias("a"))
    pairs = posted.join(top, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    sig = classes.select("rep", "sig")
    pairs = pairs.join(sig.toDF("a", "sig_a"), "a")
    pairs = pairs.join(sig.toDF("b", "sig_b"), "b")
    return pairs.where(_matches("sig_a", "sig_b") >= matches).select("a", "b")


def sets_of(docs: DataFrame, ids: DataFrame, k: int = SHINGLE) -> DataFrame:
    """rep, members: the full sets of the documents whose id is in ids (rep); one row each."""

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, begin = shingle_sets(part["text"], k)
                rows = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, pa.binary())], names=["rep", "members"])

    rows = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids.select(F.col("rep").alias("doc_id")))
    return rows.mapInArrow(apply, "rep long, members binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sets given as sorted arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""

    def apply(batches):
        for batch in batches:
            x, y = batch["set_a"].to_pylist(), batch["set_b"].to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([alike(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), percent) for u, v in zip(x, y, strict=True)], pa.bool_()))

    rows = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return rows.select("a", "b", "set_a", "set_b").mapInArrow(apply, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that is not its own root, by alternating
    large and small stars: every node's neighbours are linked to its smallest neighbour instead,
    until nothing changes. Hubs are summarised before the shuffle, and the driver sees two numbers."""
    edges, before = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    edges = cut(edges, WIDE_ROWS)  # links are confirmed here
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(least).distinct()
        edges = cut(small)


def _block_links(sig_x, mask_x, comp_x, sets_x, rep_x, other_x, sig_y, mask_y, comp_y, sets_y, rep_y, first, second, percent, matches):
    """Indices (i, j) of links between members x and strangers y of a list that join components not yet
    joined; other_x marks members that are strangers too, whose pairs count once. first and second are the
    coordinates of the list (second is -1 where it has one)."""
    live = comp_x[:, None] != comp_y[None, :]
    live &= ~(other_x[:, None] & (rep_x[:, None] > rep_y[None, :]))
    hits = np.zeros(live.shape, np.uint8)
    for c in range(COORDINATES):
        equal = sig_x[:, c][:, None] == sig_y[:, c][None, :]
        hits += equal
        if c < max(first, second) and c != first:  # a pair belongs to the first list that both are posted in
            bit = np.int64(1) << np.int64(c)
            live &= ~(equal & (mask_x & bit != 0)[:, None] & (mask_y & bit != 0)[None, :])
    i, j = np.nonzero(live & (hits >= matches))
    order = np.argsort(-hits[i, j].astype(np.int64), kind="stable")
    parent: dict[int, int] = {}

    def find(v):
        while (up := parent.get(v, v)) != v:
            parent[v] = v = parent.get(up, up)
        return v

    for p in order:
        a, b = int(i[p]), int(j[p])
        u, v = find(int(comp_x[a])), find(int(comp_y[b]))
        if u != v and alike(sets_x[a], sets_y[b], percent):
            parent[max(u, v)] = min(u, v)
            yield a, b


def _sized(rows: DataFrame, block: int) -> DataFrame:
    """The lists (key, second) of rows that hold several components: the largest, and in how many blocks all
    members and the strangers are dealt."""
    held = rows.groupBy("key", "second", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    held = held.groupBy("key", "second").agg(F.max(F.struct("n", "comp", "bytes")).alias("most"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("comps > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES)).cast("int")
    strange = blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    return held.select("key", "second", F.col("most.comp").alias("largest"), blocks(F.col("n"), F.col("bytes")).alias("many"), strange.alias("strange"))


def block_rows(posted: DataFrame, classes: DataFrame, roots: DataFrame, block: int, two: bool = True) -> DataFrame:
    """key, second, i, j, stranger (which side), other, rep, comp, sig, mask: what tasks (key, second, i, j)
    compare. A member is in its block i with every stranger block j, a stranger in its block j with every i; in
    a list of one block the members marked other are the strangers. A list of more than a block of strangers is
    split by the second key that its classes share (if two: candidates do), else second is -1."""
    top = posted.groupBy("key").agg(F.max(F.struct("common", "rep")).alias("top")).select("key", F.col("top.rep").alias("leader"))
    rows = posted.join(top, "key").where("rep <> leader")
    mask = posted.groupBy("rep").agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) AS int)))").alias("mask"))
    own = classes.join(roots, classes["rep"] == roots["node"], "left").select("rep", F.coalesce("root", "rep").alias("comp"), "sig", (8 * F.col("n_shingles")).alias("bytes")).join(mask, "rep")
    rows = rows.select("key", "rep").join(own.select("rep", "comp", "bytes"), "rep").withColumn("second", F.lit(-1).cast("long"))
    lists = cut(_sized(rows, block))
    strange = lists.where("strange > 1").select("key")
    if two and not strange.isEmpty():
        again = rows.join(strange, "key").drop("second").join(posted.select("rep", F.col("key").alias("second")), "rep").where("shiftright(second, 32) > shiftright(key, 32)")
        again = cut(again.select("key", "rep", "comp", "bytes", "second"))
        lists = lists.where("strange <= 1").unionByName(_sized(again, block))
        rows = rows.select("key", "rep", "comp", "bytes", "second").unionByName(again)
    rows = rows.join(lists, ["key", "second"]).withColumn("other", F.col("comp") != F.col("largest"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumns({"i": place("many"), "stranger": F.lit(False)}).withColumn("j", each("strange"))
    strangers = rows.where("other AND many > 1").withColumns({"j": place("strange"), "stranger": F.lit(True)}).withColumn("i", each("many"))
    out = ["key", "second", "i", "j", "stranger", "other", "rep"]
    return members.select(*out).unionByName(strangers.select(*out)).join(own.drop("bytes"), "rep")


def remaining_links(posted: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between components that star_pairs did not see, (a, b)."""
    rows = cut(block_rows(posted, classes, roots, block, matches_for(percent) > 1))
    sets = cut(sets_of(docs, cut(rows.select("rep").distinct()), k), WIDE_ROWS)
    rows = rows.join(sets, "rep")

    def group(table: pa.Table) -> pa.Table:
        get = lambda c: table[c].combine_chunks()
        first, second = table["key"][0].as_py() >> 32, table["second"][0].as_py()
        side, other, rep, comp, mask = (get(c).to_numpy(zero_copy_only=False) for c in ("stranger", "other", "rep", "comp", "mask"))
        sig = get("sig").flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
        members = [np.frombuffer(m, np.uint64) for m in get("members").to_pylist()]
        s, t = np.flatnonzero(~side.astype(bool)), np.flatnonzero(side if side.any() else other)
        of = lambda at: (sig[at], mask[at], comp[at], [members[v] for v in at], rep[at])
        found = [(rep[s[a]], rep[t[b]]) for a, b in _block_links(*of(s), other[s].astype(bool), *of(t), first, second >> 32 if second >= 0 else -1, percent, matches_for(percent))]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("key", "second", "i", "j").applyInArrow(group, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    signed = cut(signatures(docs, k), WIDE_ROWS)
    key = ["set_a", "set_b", "n_shingles"]
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes)
    posted = cut(postings(classes, matches_for(percent)))
    pairs = cut(star_pairs(posted, classes, matches_for(percent)))
    ids = cut(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    roots = components(confirm(pairs, cut(sets_of(docs, ids, k), WIDE_ROWS), percent))
    more = cut(remaining_links(posted, classes, roots, docs, k, percent, BLOCK), WIDE_ROWS)
    if not more.isEmpty():
        roots = components(more.union(roots.select("node", "root")))
    several = classes.join(roots, classes["rep"] == roots["node"], "left").where("n > 1 OR root IS NOT NULL").select(*key, F.coalesce("root", "rep").alias("component"))
    rows = signed.select("doc_id", *key).join(several, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """docs without the rows that are not kept: the document with the smallest id of each group stays.
    A doc_id stands for one document, so rows that repeat it stay or go together."""
    (gone,) = unused(docs, "_gone")
    ids = near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")
