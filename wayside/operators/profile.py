"""Profiling: frequency tables, cross tables, ranks, null rates, join outcomes, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    """n and share of every combination of keys."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def nested_counts(df: DataFrame, key: str, inner: str) -> DataFrame:
    """n by key, and its counts by inner as 'value:n|value:n', most common first. Inner values of a
    key are few; they are listed in one row."""
    counts = df.groupBy(key, inner).agg(F.count("*").alias("k"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.col(inner).alias("v"), "k")))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["v"], x["k"].cast("string"))), "|")
    return counts.groupBy(key).agg(F.sum("k").alias("n"), text.alias("detail"))


def floor_percentiles(df: DataFrame, group: str, value: str, shares: list[float], buckets: int = 1024) -> DataFrame:
    """group, share, value: the value at place min(n - 1, floor(share * n)) in rising order.

    Equal values are counted first; counts are summed over equal-width buckets of a group's range, and
    only the buckets that hold a wanted place are sorted. No task sorts a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    range_ = counts.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets))).otherwise(0)
    placed = counts.join(range_, group).withColumn("bucket", width.cast("int"))
    ahead = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(group, "total", "bucket").agg(F.sum("n").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(ahead), F.lit(0)))
    wanted = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    wanted = sums.select("*", wanted).withColumn("place", F.least(F.col("total") - 1, F.floor(F.col("share") * F.col("total"))).cast("long"))
    wanted = wanted.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("k"))).select(group, "bucket", "share", "place", "before")
    inside = Window.partitionBy(group, "bucket", "share").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(wanted, [group, "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.where((F.col("place") >= F.col("at")) & (F.col("place") < F.col("at") + F.col("n"))).select(group, "share", value)


def size_histogram(df: DataFrame, key: str, tail: int) -> DataFrame:
    """How many keys have 1, 2, ... rows; over tail they count as one bucket, tail + 1."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    return sizes.groupBy(F.least("size", F.lit(tail + 1)).alias("size")).agg(F.count("*").alias("n_keys"))


def null_profile(df: DataFrame) -> DataFrame:
    """column, n, n_null of every column, in one pass."""
    sums = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]
    wide = df.agg(F.count("*").alias("_n"), *sums)
    return wide.unpivot(["_n"], df.columns, "column", "n_null").select("column", F.col("_n").alias("n"), F.coalesce("n_null", F.lit(0)).alias("n_null"))


def multi_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and n_values of the keys with several values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def stratified_sample(df: DataFrame, stratum: str, id_col: str, most: int, seed: str) -> DataFrame:
    """The rows of each stratum with the `most` smallest hashes of the id: the same at every run.
    Candidates are cut to a bounded number in each task before any stratum is gathered."""
    keyed = df.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)).cast("binary")))
    near = Window.partitionBy(stratum, F.substring("_h", 1, 2)).orderBy("_h", id_col)
    rows = keyed.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most)
    whole = Window.partitionBy(stratum).orderBy("_h", id_col)
    return rows.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= most).drop("_h", "_r")


def weighted_rate(df: DataFrame, hit: Column, weight: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.sum(weight).alias("weight"), F.sum(F.when(hit, weight).otherwise(0)).alias("hit_weight"))


def drift(counts: DataFrame, most: float = 0.2) -> DataFrame:
    """key, previous, n -> ok: whether n is within a part `most` of the previous number. Without a
    previous number, or with 0, it passes."""
    known = F.col("previous").isNotNull() & (F.col("previous") != 0)
    return counts.withColumn("ok", ~known | (F.abs(F.col("n") - F.col("previous")) <= most * F.col("previous")))


def join_outcomes(df: DataFrame, reference: DataFrame, a: str, b: str) -> DataFrame:
    """Each row of df by how its unordered pair (a, b) is found in the reference: exact, one (either
    is in some pair), or miss; n rows and n_pairs distinct pairs of each outcome. Pairs are joined
    once each."""
    pair = lambda x, y: (F.least(x, y), F.greatest(x, y))
    lo, hi = pair(F.col(a), F.col(b))
    groups = df.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"))
    rlo, rhi = pair(F.col(a), F.col(b))
    exact = reference.select(rlo.alias("lo"), rhi.alias("hi")).distinct().withColumn("exact", F.lit(True))
    ends = reference.select(F.col(a).alias("v")).union(reference.select(b)).distinct()
    found = groups.join(exact, ["lo", "hi"], "left")
    for side in ("lo", "hi"):
        found = found.join(ends.select(F.col("v").alias(side), F.lit(True).alias(f"has_{side}")), side, "left")
    kind = F.when(F.col("exact"), "exact").when(F.col("has_lo") | F.col("has_hi"), "one").otherwise("miss")
    return found.groupBy(kind.alias("outcome")).agg(F.sum("n").alias("n"), F.count("*").alias("n_pairs"))


def dictionary_codes(df: DataFrame, order: str, value: str, buckets: int = 256) -> DataFrame:
    """value and code: codes number the values by first appearance (the least `order`, a whole number; values that
    first appear together go by value); null has -1. Values are ranged into buckets of that place, numbered inside, and the
    few buckets' sizes are added up before, so no task holds all values."""
    first = df.groupBy(value).agg(F.min(order).alias("first"))
    known = first.where(F.col(value).isNotNull())
    bounds = known.agg(F.min("first").alias("_lo"), F.max("first").alias("_hi"))
    bucket = F.floor((F.col("first") - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    placed = known.crossJoin(F.broadcast(bounds)).withColumn("_b", bucket)  # one row
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_b").agg(F.count("*").alias("k")).select("_b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("first", value))
    rows = placed.join(F.broadcast(sums), "_b").select(value, (F.col("_before") + inside - 1).cast("int").alias("code"))  # a row a bucket
    return rows.unionByName(first.where(F.col(value).isNull()).select(value, F.lit(-1).alias("code")))


def list_offsets(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """key, size and the offset of its list in a flat column: lists in key order. Keys are ranged into
    buckets, so running sums are made inside a bucket and over bucket totals."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    bounds = sizes.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    bucket = F.floor((F.col(key) - F.col("lo")) * buckets / (F.col("hi") - F.col("lo") + 1)).cast("int")
    placed = sizes.crossJoin(F.broadcast(bounds)).withColumn("bucket", bucket).drop("lo", "hi")  # one row
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("bucket").agg(F.sum("size").alias("k")).select("bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(sums, "bucket")
    return rows.select(key, "size", (F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("offset"))
