"""Quality rules: per-document counts and cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, white space collapsed and trimmed) and hashed. Per host, the
number of documents that hold a line is counted, a line of a document once. With distinct_texts,
documents of one text count once, so that exact copies don't make their own lines frequent. Lines
held by more than `max_docs` documents of their host are removed; a document is depleted, and
rejected, if fewer than `min_left` of its words are left. Hosts are the values of `source`; null is
a host of its own.

Texts are read once: counts and line hashes are written, and both the line counts and the judgement
go over those. The rows of a very common line are dealt to many groups.

A document is a row: repeated rows count and are judged like any other. Null text has no words and
fails the base rule, as does an empty text. Lines without a word are not counted. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, hot_keys, salted_join, written

MAX_DOCS, MIN_LEFT = 10, 0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[#*$%&|<>]"


def _windows(words: str):
    """Hashes of the 3-word windows of the array column `words`."""
    return F.expr(f"transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (w, i) -> xxhash64(w, get({words}, i + 1), get({words}, i + 2)))")


def document_counts(docs: DataFrame) -> DataFrame:
    """docs' doc_id, source, text_hash, lines and the counts n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = rows.select(
        "doc_id", "host", "text_hash",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full_lines"),
    )
    rows = rows.select(
        "doc_id", "host", "text_hash", "n_symbols", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        _windows("words").alias("windows"),
        "full_lines",
    )
    # windows by hash, then the places of those with an equal neighbour, in order; each covers three words
    ordered = F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END")
    rows = rows.withColumn("ordered", ordered)
    rows = rows.withColumn("again", F.expr("sort_array(transform(filter(ordered, (x, k) -> get(ordered, k - 1).h <=> x.h OR get(ordered, k + 1).h <=> x.h), y -> y.i))"))
    covered = F.expr("coalesce(aggregate(zip_with(again, slice(again, 2, size(again)), (p, q) -> least(3, coalesce(q - p, 3))), 0L, (a, n) -> a + n), 0L)")
    return rows.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "full_lines")


def _normal(line):
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, row (a number of its own for each row), host (as a text, never null),
    text_hash and lines: line (hash) and words of every line with a word."""
    lines = F.transform("full_lines", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")))
    host = F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("~"))
    rows = document_counts(docs).withColumns({"lines": lines, "host": host, "row": F.monotonically_increasing_id()})
    return rows.drop("full_lines")


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, distinct_texts: bool = False) -> DataFrame:
    """host, line and n of the lines in rows (of lines_of) that n > max_docs documents of a host hold."""
    each = rows.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    each = each.distinct() if distinct_texts else each
    return each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)


def quality_rules(
    docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, distinct_texts: bool = False,
) -> DataFrame:
    """doc_id, the counts, words_left, base_failed and kept, a row for each of docs."""
    rows = written(lines_of(docs))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = ["host", "line"]
    common = written(frequent_lines(rows, max_docs, distinct_texts))
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
    hot = hot_keys(common, key, "n", common.agg(F.sum("n")).first()[0] or 0)
    gone = salted_join(lines, common.select(*key), key, hot, ["row"], "left_semi").groupBy("row").agg(F.sum("words").alias("gone"))
    judged = rows.select("row", "doc_id", *counts).join(gone, "row", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return judged.select("doc_id", *counts, left.alias("words_left"), failed.alias("base_failed"), (~failed & (left >= min_left * F.col("n_words"))).alias("kept"))
