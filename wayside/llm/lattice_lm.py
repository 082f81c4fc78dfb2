"""LM scoring by the subword lattice.

No installed vocabulary has unigram scores: the one used is a BPE file whose scores are merge ranks.
Ranks order pieces by frequency but are no probabilities, so a rank law stands for the missing scores
(passes=0 uses it alone) and `PASSES` passes of expectation maximisation over the counts of all
training words, with the law as a prior of PRIOR pieces, turn it into unigram scores.

The pieces of the vocabulary and the bytes are the arcs of a lattice over a word, its first arc
beginning with the word mark; a word's probability is the sum over all segmentations of the product
of piece probabilities, by a forward recursion in log space. A document's probability is the product
over its words and of the end symbol.

Words are counted over the whole corpus in Spark. A pass sums expected piece counts in tasks; the
driver sees one number per piece of the vocabulary. Words are scored once each. Of the table of
scored words, the COMMON most frequent, a fixed number, are sent to the tasks that go over the
documents; all other words of a document are joined with the table.

Null text is empty; an empty text has the end symbol only. Without training documents the start
distribution and counts of 0 are used. Repeated rows are counted as often as they occur and get
equal scores. Training documents are chosen by the hash of doc_id.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, written
from .textblocks import _BASE, _INV, _POW, _powers, hash_spans, mix, slices, texts_of, word_bounds

PASSES, PRIOR, COMMON, HELD_FOLD = 3, 1000.0, 200_000, 1
SLICE, WORDS_AT_ONCE, KEPT_ARCS = 8 << 20, 20_000, 1024
_U = np.uint64
_MARK = 32  # the byte before a word; words have none


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash_of(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        v = np.frombuffer(p, np.uint8).astype(np.uint64) + _U(1)
        out[i] = (v * _POW[: len(v)]).sum(dtype=np.uint64)
    return mix(out + np.array([len(p) for p in pieces], np.uint64) * _U(0xD6E8FEB86659FD93))


class Vocabulary:
    """Pieces by hash. Ids 0 to 255 are the bytes; the others follow."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores = [], []
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                text = sp.id_to_piece(i).replace("▁", " ")
                # words are lower-cased in A-Z only and hold no ASCII white space: pieces with those never match
                if not any("A" <= c <= "Z" or "\t" <= c <= "\r" for c in text) and " " not in text[1:]:
                    pieces.append(text.encode())
                    scores.append(sp.get_score(i))
        self.longest = max(map(len, pieces))
        keys = _hash_of(pieces)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order + 256
        # scores are negative merge ranks: the start is the usual law of frequency by rank
        rank = np.concatenate((np.full(256, 2.0 * len(pieces)), np.argsort(np.argsort(-np.array(scores))) + 10.0))
        self.start = 1 / rank / (1 / rank).sum()

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Ids, -1 where no piece has the hash."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All segmentations of words of one byte length, the mark included: rows of `words`."""

    def __init__(self, words: np.ndarray, voc: Vocabulary):
        m, n = words.shape
        pw, inv = (_POW, _INV) if n < len(_POW) else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
        total = np.zeros((m, n + 1), np.uint64)
        np.cumsum((words.astype(np.uint64) + _U(1)) * pw[:n], axis=1, out=total[:, 1:])
        self.words, self.voc, self.total, self.inv = words, voc, total, inv
        self.kept = [self._arcs(j) for j in range(1, n + 1)] if n <= KEPT_ARCS else None

    def _arcs(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(max(0, j - self.voc.longest), j)
        h = mix((self.total[:, j : j + 1] - self.total[:, i]) * self.inv[i] + (j - i).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        return i, self.voc.look_up(h)

    def arcs(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids) of the arcs that end at byte j; those of very long words are not kept."""
        return self.kept[j - 1] if self.kept else self._arcs(j)

    def forward(self, logs: np.ndarray) -> np.ndarray:
        m, n = self.words.shape
        alpha = np.zeros((m, n + 1))
        with_none = np.append(logs, -np.inf)  # id -1
        for j in range(1, n + 1):
            i, ids = self.arcs(j)
            z = alpha[:, i] + with_none[ids]
            one = alpha[:, j - 1] + logs[self.words[:, j - 1]]
            top = np.maximum(z.max(axis=1), one)
            alpha[:, j] = top + np.log(np.exp(z - top[:, None]).sum(axis=1) + np.exp(one - top))
        return alpha

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, words weighted by counts."""
        m, n = self.words.shape
        alpha = self.forward(logs)
        beta = np.full((m, n + 1), -np.inf)
        beta[:, n] = 0
        with_none, out = np.append(logs, -np.inf), np.zeros(len(logs))
        for j in range(n, 0, -1):
            i, ids = self.arcs(j)
            z = with_none[ids] + beta[:, j : j + 1]
            one = logs[self.words[:, j - 1]] + beta[:, j]
            beta[:, i] = np.logaddexp(beta[:, i], z)
            beta[:, j - 1] = np.logaddexp(beta[:, j - 1], one)
            share = np.exp(alpha[:, i] + z - alpha[:, n : n + 1]) * counts[:, None]
            has = ids >= 0
            out += np.bincount(ids[has], share[has], len(out))
            out += np.bincount(self.words[:, j - 1], np.exp(alpha[:, j - 1] + one - alpha[:, n]) * counts, len(out))
        return out


def lattices(column: pa.Array, voc: Vocabulary):
    """(rows, lattice) for all words of a binary column, those of one length together."""
    data, off = texts_of(column.cast(pa.binary()))
    n = np.diff(off)
    for length in np.unique(n):
        rows = np.flatnonzero(n == length)
        most = max(1, min(WORDS_AT_ONCE, 400_000 // int(length + 1)))
        for at in range(0, len(rows), most):
            r = rows[at : at + most]
            words = np.full((len(r), length + 1), _MARK, np.uint8)
            words[:, 1:] = data[off[r][:, None] + np.arange(length)]
            yield r, Lattice(words, voc)


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary, A-Z in lower case) and its count in training documents (0 if only others have it)."""

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, off = texts_of(part["text"])
                starts, ends, first = word_bounds(data, off)
                h = hash_spans(data, starts, ends)
                held = np.repeat(part["held"].to_numpy(zero_copy_only=False), np.diff(first))
                order = np.argsort(h)
                edge = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.zeros(0, np.int64)
                if not len(edge):
                    continue
                counts = np.add.reduceat((~held[order]).astype(np.int64), edge)
                one = order[edge]
                raw = data.tobytes()
                words = [raw[a:b].lower() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], names=["word", "c"])

    return docs.select("text", "held").mapInArrow(apply, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def estimate(words: DataFrame, documents: int, path: str, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(log probability of each piece, that of the end symbol) from word counts."""
    start = vocabulary(path).start
    p, end = start * (1 - 1e-3), 1e-3

    for _ in range(passes):
        logs = np.log(p)

        def apply(batches, logs=logs):
            voc, out = vocabulary(path), np.zeros(len(logs))
            for batch in batches:
                c = batch["c"].to_numpy().astype(float)
                for rows, lattice in lattices(batch["word"], voc):
                    out += lattice.expected(logs, c[rows])
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["piece", "n"])

        rows = words.where("c > 0").mapInArrow(apply, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row per piece of the vocabulary
        counts = PRIOR * start
        for r in rows:
            counts[r["piece"]] += r["n"]
        total = counts.sum() + documents + 0.5
        p, end = counts / total, (documents + 0.5) / total
    return np.log(p), math.log(end)


def score(docs: DataFrame, path: str | None = None, passes: int = PASSES, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    path = path or vocabulary_file()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of("doc_id") == HELD_FOLD).alias("held"))
    words = written(count_words(rows))
    documents = rows.where("NOT held").count()
    known = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    train_tokens, distinct = (known["n"] or 0) + documents, (known["v"] or 0) + (documents > 0)
    logs, end = estimate(words, documents, path, passes)
    ln10, below = math.log(10), math.log10(train_tokens + 0.5 * (distinct + 1))

    def score_words(batches):
        voc = vocabulary(path)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for r, lattice in lattices(batch["word"], voc):
                out[r] = lattice.forward(logs)[:, -1] / ln10
            data, off = texts_of(batch["word"])
            has = np.diff(off) > 0
            h = np.zeros(batch.num_rows, np.uint64)
            h[has] = hash_spans(data, off[:-1][has], off[1:][has])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch["c"], pa.array(out)], names=["word", "c", "log10_p"])

    scored = written(words.mapInArrow(score_words, "word long, c long, log10_p double"))
    # the most frequent words, `common` at most: counts from a level up, levels being eighths of a doubling
    level = F.floor(F.log2(F.greatest("c", F.lit(1))) * 8)
    sizes = {r["level"]: r["n"] for r in scored.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # at most 504 levels
    lowest, total = 1 << 20, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > common:
            break
        lowest = k
    top = scored.where(level >= lowest).toPandas().sort_values("word")
    keys, counts, probs = top["word"].to_numpy("int64"), top["c"].to_numpy("int64"), top["log10_p"].to_numpy(float)
    base_of = np.log10(counts + 0.5) - below
    table = docs.sparkSession.sparkContext.broadcast((keys, counts > 0, base_of, probs))

    def score_documents(batches):
        keys, known, base_of, probs = table.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, off = texts_of(part["text"])
                starts, ends, first = word_bounds(data, off)
                h = hash_spans(data, starts, ends).view(np.int64)
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    has = keys[at] == h
                else:
                    at, has = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                sums = [np.bincount(row[has], v[at[has]], len(n)) for v in (known.astype(float), base_of, probs)]
                rest = np.flatnonzero(~has)
                ids, k = part["row"].to_numpy(), len(n)
                none = np.zeros(len(rest))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((ids, ids[row[rest]]))),
                        pa.concat_arrays([part["doc_id"], pa.nulls(len(rest), pa.int64())]),
                        pa.concat_arrays([part["held"], pa.nulls(len(rest), pa.bool_())]),
                        pa.array(np.concatenate((n, none)).astype(np.int64)),
                        *(pa.array(np.concatenate((s, none)).astype(t)) for s, t in zip(sums, (np.int64, float, float), strict=True)),
                        pa.array(np.concatenate((mix(ids.astype(np.uint64)).view(np.int64), h[rest]))),
                        pa.array(np.concatenate((np.zeros(k, np.int64), np.ones(len(rest), np.int64)))),
                    ],
                    names=["row", "doc_id", "held", "n_words", "known", "base", "log10_p", "word", "times"],
                )

    schema = "row long, doc_id long, held boolean, n_words long, known long, base double, log10_p double, word long, times long"
    parts = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score_documents, schema)
    rare = scored.select("word", F.col("c").alias("w_c"), F.col("log10_p").alias("w_log10_p"))
    joined = parts.join(rare, "word", "left").withColumn("used", F.when(F.col("w_c").isNotNull(), F.col("times")).otherwise(0))
    each = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.sum("n_words").alias("n_words"),
        F.sum(F.col("known") + F.when(F.col("w_c") > 0, F.col("used")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(F.col("used") > 0, F.log10(F.col("w_c") + 0.5) - below).otherwise(0.0)).alias("base"),
        F.sum(F.col("log10_p") + F.when(F.col("used") > 0, F.col("w_log10_p")).otherwise(0.0)).alias("log10_p"),
    )
    end_base = math.log10(documents + 0.5) - below
    return each.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + int(documents > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + end_base).alias("base_score"), (F.col("log10_p") + end / ln10).alias("score"),
    )
