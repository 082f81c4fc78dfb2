"""Spans along chains: extension from posts, unions, tiling, projection, placeholders.

Distances are whole units (hundredths, say), so equality is exact. A face is one side of one chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(posts: DataFrame, face: list[str], family: str, at: str) -> DataFrame:
    """posts with same_before, same_after (nearest post of the family strictly before or after) and
    any_before, any_after (of another family)."""
    up, down = F.col(at).asc(), F.col(at).desc()
    strictly = (Window.unboundedPreceding, -1)  # running frames in both directions: a face of n posts costs n
    near = lambda keys, order, pick: pick(at).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(*strictly))
    return posts.withColumns({
        "same_before": near([*face, family], up, F.max), "any_before": near(face, up, F.max),
        "same_after": near([*face, family], down, F.min), "any_after": near(face, down, F.min),
    })


def single_arrow(posts: DataFrame, face: list[str], family: str, at: str, length: str, forward: Column) -> DataFrame:
    """A post whose arrow points one way reaches to the next post of its family that way, or the end.
    A span shorter than one unit covers the whole side."""
    rows = neighbours(posts, face, family, at)
    start = F.when(forward, F.col(at)).otherwise(F.coalesce("same_before", F.lit(0)))
    end = F.when(forward, F.coalesce("same_after", length)).otherwise(F.col(at))
    rows = rows.withColumns({"span_start": start, "span_end": end}).drop("same_before", "same_after", "any_before", "any_after")
    return _whole_side(rows, length)


def double_arrow(posts: DataFrame, face: list[str], family: str, at: str, length: str) -> DataFrame:
    """A post whose arrow points both ways reaches, each way, to the next of its family, else the next
    of any family, else the end."""
    rows = neighbours(posts, face, family, at)
    rows = rows.withColumns({"span_start": F.coalesce("same_before", "any_before", F.lit(0)), "span_end": F.coalesce("same_after", "any_after", length)})
    return _whole_side(rows.drop("same_before", "same_after", "any_before", "any_after"), length)


def _whole_side(rows: DataFrame, length: str) -> DataFrame:
    short = F.col("span_end") - F.col("span_start") < 1
    return rows.withColumns({"whole_side": short, "span_start": F.when(short, F.lit(0)).otherwise(F.col("span_start")), "span_end": F.when(short, F.col(length)).otherwise(F.col("span_end"))})


def union_touching(spans: DataFrame, keys: list[str], start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Spans of equal keys that overlap or touch become one; n counts them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def flatten(spans: DataFrame, face: list[str], member: str, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Overlapping spans of a face as pieces that don't overlap, each with the sorted set of members
    that cover it; neighbours with equal sets are one piece. Uncovered stretches are left out."""
    held = spans.select(*face, F.col(member).alias("m"), F.col(start).alias("s"), F.col(end).alias("e"))
    ends = held.withColumn("t", F.explode(F.array("s", "e"))).withColumn("_i", F.dense_rank().over(Window.partitionBy(*face).orderBy("t")))
    # a span covers the pieces from its start's number to the one before its end's: work goes with the
    # output, and all of it stays in the one exchange by face
    pieces = ends.groupBy(*face, "_i").agg(F.first("t").alias("a")).withColumn("b", F.lead("a").over(Window.partitionBy(*face).orderBy("_i")))
    held = ends.groupBy(*face, "m", "s", "e").agg(F.min("_i").alias("_from"), F.max("_i").alias("_to")).where("s < e")
    held = held.select(*face, "m", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_i"))
    sets = held.groupBy(*face, "_i").agg(F.array_sort(F.collect_set("m")).alias("members"))
    sets = sets.join(pieces, [*face, "_i"]).select(*face, "a", "b", "members")
    w = Window.partitionBy(*face).orderBy("a")
    starts = F.when((F.lag("b").over(w) == F.col("a")) & (F.lag("members").over(w) == F.col("members")), 0).otherwise(1)
    runs = sets.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*face, "_run").agg(F.min("a").alias(start), F.max("b").alias(end), F.first("members").alias("members")).drop("_run")


def overlaps(spans: DataFrame, face: list[str], start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Spans that begin before an earlier one of their face ends."""
    w = Window.partitionBy(*face).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(end).over(w)).where(F.col(start) < F.col("_reach")).drop("_reach")


def project(spans: DataFrame, members: DataFrame, chain: str, order: str, length: str, backwards: Column) -> DataFrame:
    """Spans of a chain in the frames of its members: chain columns, member columns, local_start and
    local_end; members walked backwards are turned round. members have their length and order."""
    w = Window.partitionBy(chain).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = members.withColumn("_from", F.coalesce(F.sum(length).over(w), F.lit(0)))
    rows = spans.join(placed, chain)
    low = F.greatest(F.col("span_start") - F.col("_from"), F.lit(0))
    high = F.least(F.col("span_end") - F.col("_from"), F.col(length))
    rows = rows.withColumns({"_low": low, "_high": high}).where("_high > _low").withColumn("_back", backwards)
    return rows.withColumns({
        "local_start": F.when(F.col("_back"), F.col(length) - F.col("_high")).otherwise(F.col("_low")),
        "local_end": F.when(F.col("_back"), F.col(length) - F.col("_low")).otherwise(F.col("_high")),
    }).drop("_low", "_high", "_from", "_back")


def majority(rows: DataFrame, key: str, letter: str, weight: str) -> DataFrame:
    """The letter with the greatest weight of each key, the first in the alphabet on a tie."""
    sums = rows.groupBy(key, letter).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(key).agg(F.min_by(letter, F.struct(-F.col("_w"), letter)).alias(letter), F.max("_w").alias("weight"))


def placeholders(keys: DataFrame, covered: DataFrame, side: str, sides: list[str]) -> DataFrame:
    """A row for every key and side that covered lacks."""
    every = keys.withColumn(side, F.explode(F.array(*map(F.lit, sides))))
    return every.join(covered, [*keys.columns, side], "left_anti")
