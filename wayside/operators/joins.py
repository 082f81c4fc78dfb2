"""Joins beyond equality: nearest, as-of, ranges with parity, ladders, ordered list keys, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_interpolate(points: DataFrame, known: DataFrame, keys: list[str], at: str, value: str, widest: int) -> DataFrame:
    """points with before_at, after_at (nearest known places strictly below and above, of equal keys)
    and interpolated: the value on the line between them if they are at most `widest` apart. Two sorts
    of a key's rows, each gone over once."""
    cols = [*keys, at]
    both = points.select(*cols, F.lit(None).cast("struct<a:bigint,v:double>").alias("_k")).withColumn("_p", F.lit(True))
    both = both.union(known.select(*cols, F.struct(F.col(at).cast("bigint").alias("a"), F.col(value).cast("double").alias("v")), F.lit(False)))
    w, strictly = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)  # running frames, up and down
    low = F.max("_k").over(w.orderBy(F.asc(at)).rangeBetween(*strictly))
    high = F.min("_k").over(w.orderBy(F.desc(at)).rangeBetween(*strictly))
    rows = both.withColumns({"_lo": low, "_hi": high}).where("_p")
    part = (F.col(at) - F.col("_lo.a")) / (F.col("_hi.a") - F.col("_lo.a"))
    near = F.col("_hi.a") - F.col("_lo.a") <= widest
    return rows.select(*cols, F.col("_lo.a").alias("before_at"), F.col("_hi.a").alias("after_at"), F.when(near, F.col("_lo.v") + part * (F.col("_hi.v") - F.col("_lo.v"))).alias("interpolated"))


def nearest_key(points: DataFrame, known: DataFrame, keys: list[str], at: str) -> DataFrame:
    """points with the nearest known key, the lower one on a tie."""
    both = points.select(*keys, at, F.lit(True).alias("_p"), F.lit(None).cast("bigint").alias("_k")).union(known.select(*keys, at, F.lit(False), F.col(at).cast("bigint")))
    w, upto = Window.partitionBy(*keys), (Window.unboundedPreceding, 0)  # running frames, up and down
    rows = both.withColumns({"_lo": F.max("_k").over(w.orderBy(F.asc(at)).rangeBetween(*upto)), "_hi": F.min("_k").over(w.orderBy(F.desc(at)).rangeBetween(*upto))}).where("_p")
    lower = F.col("_hi").isNull() | (F.col(at) - F.col("_lo") <= F.col("_hi") - F.col(at))
    return rows.select(*keys, at, F.when(F.col("_lo").isNotNull() & lower, F.col("_lo")).otherwise(F.col("_hi")).alias("nearest"))


def range_lookup(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, width: int, parity: bool = True) -> DataFrame:
    """Inner join of points with the ranges (low, high, inclusive) that hold them and, with parity,
    whose low end is as even or odd. Ranges are dealt to cells of `width`, so it is an equi-join."""
    cell = F.floor(F.col(at) / width)
    dealt = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    rows = points.withColumn("_cell", cell).join(dealt, [*keys, "_cell"]).where((F.col(at) >= F.col("low")) & (F.col(at) <= F.col("high")))
    return (rows.where(F.pmod(F.col(at), F.lit(2)) == F.pmod("low", F.lit(2))) if parity else rows).drop("_cell")


def first_rung(rungs: list[DataFrame], key: str) -> DataFrame:
    """The union of candidate frames, of which each key keeps the rows of its first rung that has any."""
    out = None
    for i, r in enumerate(rungs, 1):
        r = r.withColumn("rung", F.lit(i))
        out = r if out is None else out.unionByName(r)
    return out.withColumn("_m", F.min("rung").over(Window.partitionBy(key))).where("rung = _m").drop("_m")


def ordered_lookup(lists: DataFrame, key: str, ids: str, names: DataFrame, id_col: str, name: str) -> DataFrame:
    """Arrays of ids as arrays of names in the same order; unknown ids are dropped and counted."""
    each = lists.select(key, F.posexplode_outer(ids).alias("_i", id_col))
    found = each.join(names.select(id_col, F.col(name).alias("_n")), id_col, "left")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_i", "_n")))), lambda x: x["_n"])
    return found.groupBy(key).agg(listed.alias("names"), F.count(F.when(F.col(id_col).isNotNull() & F.col("_n").isNull(), 1)).alias("dangling"))


def pairs_both_ways(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Every pair of different items that share a group, in both orders. Groups are small by nature (the
    streets of a corner); pairs are made inside one row."""
    sets = rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("_s")).where("size(_s) > 1")
    pairs = F.flatten(F.transform("_s", lambda x: F.transform(F.filter("_s", lambda y: y != x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(group, F.explode(pairs).alias("_p")).select(group, "_p.a", "_p.b")


def contested(good: DataFrame, bad: DataFrame, face: list[str], start: str, end: str, width: int) -> DataFrame:
    """Rows of good that overlap a bad span of their face. Spans meet in cells of `width`."""
    cells = lambda: F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    spans = bad.where(F.col(end) > F.col(start)).select(*face, F.col(start).alias("_s"), F.col(end).alias("_e"), cells().alias("_cell"))
    keyed = good.where(F.col(end) > F.col(start)).withColumn("_cell", cells())
    cond = [keyed[c] == spans[c] for c in (*face, "_cell")] + [keyed[start] < spans["_e"], spans["_s"] < keyed[end]]
    return keyed.join(spans, cond, "left_semi").drop("_cell").distinct()


def overlapping_pairs(spans: DataFrame, key: str, face: list[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs (a, b), a < b, of keys whose spans overlap on a face; a pair is made only in the first
    cell that both lie in, so it needs no distinct."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    dealt = spans.where(F.col(end) > F.col(start)).select(key, *face, start, end, cells.alias("_cell"))
    x, y = dealt.alias("x"), dealt.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*face, "_cell")]
    later = F.greatest(F.col(f"x.{start}"), F.col(f"y.{start}"))
    rows = x.join(y, [*same, F.col(f"x.{key}") < F.col(f"y.{key}"), F.col(f"x.{start}") < F.col(f"y.{end}"), F.col(f"y.{start}") < F.col(f"x.{end}")])
    rows = rows.where(F.floor(later / width) == F.col("x._cell"))
    overlap = F.least(F.col(f"x.{end}"), F.col(f"y.{end}")) - later
    return rows.select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"), overlap.alias("overlap"))


def labelled(segments: DataFrame, nodes: DataFrame, own: Column) -> DataFrame:
    """segments (from_node, to_node) with the first name of each end other than their own, and a label."""
    for side in ("from", "to"):
        n = nodes.select(F.col("node").alias(f"{side}_node"), F.col("names").alias(f"_{side}"))
        segments = segments.join(n, f"{side}_node", "left")
    fold = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    other = lambda side: F.get(F.filter(F.coalesce(F.col(f"_{side}"), F.array()), lambda x: fold(x) != fold(own)), 0)
    a, b = other("from"), other("to")
    label = F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" to "), b)).when(a.isNotNull() | b.isNotNull(), F.concat(F.lit("at "), F.coalesce(a, b)))
    return segments.withColumn("label", label).drop("_from", "_to")
