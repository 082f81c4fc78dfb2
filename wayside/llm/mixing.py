"""Mixing sources to target weights.

Every row gets a random key, the hash of its id. Within a source, rows are ranged by that key into
equal-width buckets of the key space; bucket totals and then rows inside a bucket are summed up in
key order, so each row knows how many tokens of its source precede it. A source's budget is then
cut exactly: so many whole epochs, and of one more epoch the tokens up to the remainder. No window
holds more than one bucket, so a source with a third of all rows is spread over `BUCKETS` groups.

Sources are ordered by code point, null last, and weigh WEIGHTS, repeating. Targets share the total
by weight; a source stops at `cap` times its size and its excess is reshared by weight among the
rest. Null text has size 0 and takes no budget; a source of size 0 gets nothing. Equal rows have equal
keys: each counts by itself, and which of them is cut is of no consequence. Rows with a null id share
a key, and are ordered by size. Rows of size 0 come with the epoch that reaches their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS, CAP, BUCKETS = (5, 2, 1), 3, 4096
_NO_SOURCE = "~"


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(_NO_SOURCE)).alias("part"),
        key.alias("key"),
        F.substring(key, 1, 3).alias("bucket"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *more,
    )


def source_budgets(buckets: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """part, source_size, target and budget (the target in whole tokens), from sizes by part and
    bucket. It has one row per source; those few are ordered in one window."""
    sizes = buckets.groupBy("part").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("part")
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    sources = sizes.withColumn("weight", pick).withColumn("total", F.sum("source_size").over(everything))
    # those that fill up first: the smallest size per weight
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "part")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    sources = sources.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)),
        "open_weight": F.sum("weight").over(rest),
    }).withColumn("full", cap * F.col("source_size") * F.col("open_weight") <= F.col("weight") * F.col("left"))
    sources = sources.withColumns({
        "free": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), cap * F.col("source_size"))).over(everything), F.lit(0)),
        "free_weight": F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything),
    })
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("free").cast("double") * F.col("weight") / F.col("free_weight"))
    return sources.select("part", "source_size", target.alias("target")).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))


def _placed(rows: DataFrame, weights, cap: int) -> DataFrame:
    """rows (of _sized) with source_size, target, budget, before (tokens of the source ahead of this row
    in key order), epochs (whole copies) and part_epoch (tokens of the last epoch)."""
    buckets = rows.groupBy("part", "bucket").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).drop("size")
    starts = starts.join(source_budgets(buckets, weights, cap), "part")
    inside = Window.partitionBy("part", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["part", "bucket"]).withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = F.col("source_size") > 0
    return placed.withColumns({
        "epochs": F.when(full, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"),
        "part_epoch": F.when(full, F.pmod("budget", F.greatest("source_size", F.lit(1)))).otherwise(0),
    })


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, before, part_epoch, epochs and taken (tokens the mix takes)
    of every row."""
    placed = _placed(_sized(docs), weights, cap)
    last = F.greatest(F.lit(0), F.least("size", F.col("part_epoch") - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", "before", "part_epoch", "epochs", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself, in the columns of docs: a row appears once for each time it is taken. Of the
    row that the budget cuts, the text is taken whole if at least half of it is due. Rows go through
    the plan whole, in one exchange, so repeated rows and rows without an id count one by one."""
    placed = _placed(_sized(docs, F.struct(*docs.columns).alias("row")), weights, cap)
    due = F.col("part_epoch") - F.col("before")
    times = (F.col("epochs") + (2 * due >= F.col("size")).cast("long")).cast("int")
    taken = placed.where(F.col("source_size") > 0).select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])
