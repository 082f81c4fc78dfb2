"""Phrase collocations by hierarchical pair naming.

Frequent words get ids; each text piece becomes the row of its words' ids, with a gap wherever the
piece ends or a word is rare. Two neighbouring ids make a pair; pairs counted over the whole corpus
and frequent enough get ids of their own, and the pair at a place is replaced by its id. Done again,
neighbouring 2-gram ids (which overlap in a word) name 3-grams, and so on: a gram of k words is a pair
(left, right) of grams of k - 1 words. Those two pointers give everything else by joins on ids: the
text is the left text and the right's last word, the counts of all prefixes come down the left
pointers and those of all suffixes down the right ones, so every cut is looked up, and a gram that
occurs as often as one of its two parents drops that parent. (A longer phrase as frequent as a
shorter one inside it has a chain of phrases between them, one word apart, all as frequent.)

Only what is frequent can be part of something frequent, so rare grams end at once. Texts are taken
apart once and written as rows of word numbers, a chunk of a few megabytes to a row; each later level
reads and writes such rows. A chunk sends each of its different pairs once, with a count, so a pair
that fills the corpus is a row a chunk. The names of a level's pairs come back by a join: up to
SENT_IDS of them (and SENT_BYTES) are counted and sent to all tasks, more are joined by shuffle with
each chunk's different pairs and grouped by chunk; both ways give the same rows.

A-Z is lower-cased. Texts are split at .,;:!? and line breaks, words are runs of anything but space and
tab. Null texts count as empty, null languages as `und`. Rows that repeat a document, or have a null
id, count like any other. An empty table, or one without a frequent phrase, gives an empty result.
Other columns are not read. Texts of any length are read whole: a chunk holds at least one text.
"""

from __future__ import annotations

import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, SENT_IDS, discard, written
from .textblocks import slices, texts_of

MIN_COUNT, MAX_WORDS, TOP, SENT_BYTES = 100, 5, 2000, 32 << 20
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROWS = "chunk long, lang string, seq binary"


def word_numbers(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, how often each occurs, sequence): the sequence has the number of each word, and
    -1 between words of different pieces."""
    data, off = texts_of(column)
    kind = _KIND[data]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    before = np.append(np.cumsum(word, dtype=np.int32)[starts] - 1, np.count_nonzero(word))
    names = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(before.astype(np.int32)), pa.py_buffer(_LOWER[data[word]])]).dictionary_encode()
    numbers = names.indices.to_numpy()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + np.searchsorted(off, starts, "right")
    gaps = np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)
    seq = np.full(len(starts) + (int(gaps[-1]) if len(gaps) else 0), -1, np.int32)
    seq[np.arange(len(starts)) + gaps] = numbers
    return names.dictionary, np.bincount(numbers, minlength=len(names.dictionary)), seq


def take_apart(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """chunk (a number of its own), lang, words, counts, seq: the texts of one language in a slice of rows."""

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.take(pc.sort_indices(part["lang"]))
                langs = part["lang"].to_numpy(zero_copy_only=False)
                ends = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
                for a, b in pairwise(ends):
                    words, counts, seq = word_numbers(part["text"].slice(a, b - a))
                    if len(words):
                        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if kind else values.view(pa.string()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([langs[a]], pa.string()), one(words, None), one(counts, pa.int64()), pa.array([seq.tobytes()], pa.binary())],
                            names=["chunk", "lang", "words", "counts", "seq"],
                        )

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return written(rows.mapInArrow(apply, "chunk long, lang string, words array<string>, counts array<long>, seq binary"), "zstd")


def numbered(grams: DataFrame) -> tuple[DataFrame, int]:
    """(grams with an id: 0, 1, ..., their number). The table is written, so an id never changes."""
    rows = written(grams.withColumn("_m", F.monotonically_increasing_id()))
    at, offsets = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy(F.shiftright("_m", 33)).count().collect()):  # a row for each part of the written table
        offsets += [F.lit(part), F.lit(at - (part << 33))]
        at += n
    if at >= 1 << 31:
        raise ValueError("more than 2**31 frequent phrases of one length")
    moved = F.col("_m") + F.element_at(F.create_map(*offsets), F.shiftright("_m", 33)) if offsets else F.col("_m")
    return rows.withColumn("id", moved).drop("_m"), at


def pair_keys(seq: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of the pairs of neighbouring ids below `many`: left * many + right, and where the left one is."""
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    return seq[at].astype(np.int64) * many + seq[at + 1], at


def closed_up(seq: np.ndarray) -> np.ndarray:
    """The sequence with one gap for each run of gaps, and none at its ends."""
    keep = seq >= 0
    keep[1:] |= seq[:-1] >= 0
    out = seq[keep]
    return out[:-1] if len(out) and out[-1] < 0 else out


def _row(chunk: int, lang: str, seq: np.ndarray) -> pa.Table:
    seq = closed_up(seq)
    n = int(len(seq) > 0)
    return pa.table({"chunk": pa.array([chunk] * n, pa.int64()), "lang": pa.array([lang] * n, pa.string()), "seq": pa.array([seq.astype(np.int32).tobytes()] * n, pa.binary())})


def _sequences(batches):
    for batch in batches:
        for chunk, lang, seq in zip(batch["chunk"].to_pylist(), batch["lang"].to_pylist(), batch["seq"], strict=True):
            yield chunk, lang, np.frombuffer(seq.as_buffer(), np.int32)


def named_words(apart: DataFrame, words: DataFrame, sent: bool) -> DataFrame:
    """The rows of take_apart with the ids of frequent words (id, lang, word) in place of their numbers."""
    if sent:
        table = words.select("lang", "word", "id").toArrow()  # its size was counted
        known = {g: table.filter(pc.equal(table["lang"], g)).combine_chunks() for g in table["lang"].unique().to_pylist()}
        held = apart.sparkSession.sparkContext.broadcast({g: (t["word"].combine_chunks(), t["id"].to_numpy()) for g, t in known.items()})

        def apply(batches):
            for batch in batches:
                for (chunk, lang, seq), own in zip(_sequences([batch]), batch["words"], strict=True):
                    if lang in held.value:
                        names, ids = held.value[lang]
                        at = pc.index_in(own.values, value_set=names).fill_null(-1).to_numpy()
                        ids = np.append(np.where(at >= 0, ids[at], -1), -1)  # the last stands for gaps
                        yield from _row(chunk, lang, ids[seq]).to_batches()

        return apart.mapInArrow(apply, _ROWS)
    posts = apart.select("chunk", "lang", F.posexplode("words").alias("i", "word")).join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("at"), "i", "id")

    def group(key, texts: pa.Table, names: pa.Table) -> pa.Table:
        (chunk, lang, seq), ids = next(_sequences(texts.to_batches())), np.full(1, -1, np.int64)
        if names.num_rows:
            at = names["i"].to_numpy()
            ids = np.full(max(int(at.max()), int(seq.max())) + 2, -1, np.int64)
            ids[at] = names["id"].to_numpy()
            return _row(chunk, lang, ids[seq])
        return _row(chunk, lang, np.zeros(0, np.int32))

    return apart.select("chunk", "lang", "seq").groupBy("chunk").cogroup(posts.groupBy("at")).applyInArrow(group, _ROWS)


def counted_pairs(rows: DataFrame, many: int) -> DataFrame:
    """left, right, n: each chunk's different pairs."""

    def apply(batches):
        for _, _, seq in _sequences(batches):
            keys, n = np.unique(pair_keys(seq, many)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // max(many, 1)), pa.array(keys % max(many, 1)), pa.array(n)], names=["left", "right", "n"])

    return rows.mapInArrow(apply, "left long, right long, n long")


def named_pairs(rows: DataFrame, pairs: DataFrame, many: int, sent: bool) -> DataFrame:
    """The rows with the ids of frequent pairs (id, left, right) in place of neighbouring ids below `many`."""

    def renamed(chunk, lang, seq, known, ids):
        keys, at = pair_keys(seq, many)
        new = np.full(len(seq), -1, np.int64)
        if len(known):
            found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            new[at] = np.where(known[found] == keys, ids[found], -1)
        return _row(chunk, lang, new)

    def in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        known = table["left"].to_numpy() * many + table["right"].to_numpy()
        order = np.argsort(known)
        return known[order], table["id"].to_numpy()[order]

    if sent:
        held = rows.sparkSession.sparkContext.broadcast(in_order(pairs.select("left", "right", "id").toArrow()))  # its size was counted

        def apply(batches):
            for chunk, lang, seq in _sequences(batches):
                yield from renamed(chunk, lang, seq, *held.value).to_batches()

        return rows.mapInArrow(apply, _ROWS)

    def posted(batches):
        for chunk, _, seq in _sequences(batches):
            keys = np.unique(pair_keys(seq, many)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk, np.int64)), pa.array(keys // max(many, 1)), pa.array(keys % max(many, 1))], names=["chunk", "left", "right"])

    posts = rows.mapInArrow(posted, "chunk long, left long, right long").join(pairs.select("left", "right", "id"), ["left", "right"]).select(F.col("chunk").alias("at"), "left", "right", "id")

    def group(key, texts: pa.Table, names: pa.Table) -> pa.Table:
        return renamed(*next(_sequences(texts.to_batches())), *in_order(names))

    return rows.groupBy("chunk").cogroup(posts.groupBy("at")).applyInArrow(group, _ROWS)


def grams(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sent_ids: int = SENT_IDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n of each language; a table for each length from 1: id, left, right, lang, text, last, f,
    prefixes, suffixes). prefixes and suffixes have the counts of the gram's first and last 1, 2, ...
    words, itself last."""
    apart = take_apart(docs)
    words = written(apart.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent, many = numbered(words.where(F.col("f") >= min_count))
    size = frequent.agg(F.sum(F.octet_length("word") + F.octet_length("lang"))).first()[0] or 0
    rows = written(named_words(apart, frequent, many <= sent_ids and size <= SENT_BYTES), "zstd")
    discard(apart)
    none = F.lit(None).cast("long")
    own = F.array("f")
    tables = [frequent.select("id", none.alias("left"), none.alias("right"), "lang", F.col("word").alias("text"), F.col("word").alias("last"), "f", own.alias("prefixes"), own.alias("suffixes"))]
    for length in range(2, max_words + 1):
        counts = counted_pairs(rows, many).groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        pairs, more = numbered(counts)
        if length < max_words:
            new = written(named_pairs(rows, pairs, many, more <= sent_ids), "zstd")
            discard(rows)
            rows = new
        left = tables[-1].select(F.col("id").alias("left"), "lang", F.col("text").alias("_text"), "prefixes")
        right = tables[-1].select(F.col("id").alias("right"), "last", "suffixes")
        named = pairs.join(left, "left").join(right, "right")
        tables.append(written(named.select(
            "id", "left", "right", "lang", F.concat_ws(" ", "_text", "last").alias("text"), "last", "f",
            F.concat("prefixes", own).alias("prefixes"), F.concat("suffixes", own).alias("suffixes"),
        )))
        many = more
    discard(rows)
    return totals, tables


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, sent_ids: int = SENT_IDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_words words."""
    totals, tables = grams(docs, min_count, max_words, sent_ids)
    found = None
    for length in range(2, max_words + 1):
        rows = tables[length - 1]
        if length < max_words:
            same = lambda side, counts: tables[length].where(F.col("f") == F.element_at(counts, length)).select(F.col(side).alias("id"))  # noqa: B023, E731
            rows = rows.join(same("left", "prefixes").union(same("right", "suffixes")).distinct(), "id", "left_anti")
        rows = rows.select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"), "prefixes", "suffixes")
        found = rows if found is None else found.unionByName(rows)
    # the score fits 64 bits (1000 n / 100 at most), the products are decimals of 37 digits
    wide = lambda c: f"cast({c} AS decimal(18, 0))"
    score = f"({wide('1000 * a')} * {wide('n')}) div ({wide('prefixes[k - 1]')} * {wide('suffixes[size(suffixes) - k - 1]')})"
    cut = F.expr(f"array_min(transform(sequence(1, size(prefixes) - 1), k -> struct({score} AS score, k, prefixes[k - 1] AS l, suffixes[size(suffixes) - k - 1] AS r)))")
    held = F.broadcast(totals) if totals.count() <= SENT_IDS else totals
    rows = found.join(held, "lang").withColumn("_c", cut).select("lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "_s"], ["lang"]):  # a language is ranked in SALTS parts first, so few rows meet in the end
        order = Window.partitionBy(*by).orderBy(*best)
        rows = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
