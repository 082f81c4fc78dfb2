"""Small readings of records: the rule to quote for a verdict, why nothing is known of a stretch, whether a calendar can
be relied on, texts of dates and clocks, segments of raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import names, staging

#: fixed values: how a ban is said; what a recorded "no" looks like
BANS = {"park": "no parking", "stand": "no standing", "stop": "no stopping"}
NOT_SET = ["", "0", "false", "no"]


def deciding_rules(outcomes: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """key, verdict, deciding: the one rule to quote. An illegal span names what bit first: the first ban, or for a stay
    over the limit the first rule that states it; a legal one that rests on a posted permission names the first
    permission; nothing is quoted where nothing was read for sure, or nothing was in force."""
    first = lambda when: F.min_by("deciding", F.when(when, F.col("piece_start")))
    sums = outcomes.groupBy(key).agg(
        first(~F.col("permitted")).alias("_ban"), F.min("limit_min").alias("_limit"), F.min_by(F.struct("deciding", "limit_min"), F.when(F.col("limit_min").isNotNull(), F.struct("limit_min", "piece_start"))).alias("_tight"),
        first(F.col("permitted") & F.col("deciding").isNotNull()).alias("_yes"),
    )
    rows = verdicts.join(sums, key)
    said = F.when(F.col("verdict") == "illegal", F.coalesce("_ban", "_tight.deciding")).when((F.col("verdict") == "legal") & (F.col("basis") == "posted"), F.col("_yes"))
    return rows.select(key, "verdict", said.alias("deciding"))


def ban_text(action: Column, permitted: Column, exclusive: Column, vehicle: Column) -> Column:
    """What a rule that keeps a passenger car away says; null for one that doesn't."""
    said = F.coalesce(*[F.when(action == a, t) for a, t in BANS.items()])
    return F.when(permitted & exclusive, F.concat(F.lit("reserved for "), vehicle, F.lit(" vehicles"))).when(~permitted, said)


def gap_texts(gap: Column) -> Column:
    """struct(reason, caveat) of a stretch without rules: that no signs are listed is not that some couldn't be placed; a
    stretch whose gap is unknown has no caveat."""
    reason = F.when(gap == "unposted", "no signs are listed here").when(gap == "unmatched", "signs are listed here that could not be placed").otherwise("nothing is known of this stretch")
    caveat = F.when(gap == "unposted", "unknown is not the same as unrestricted").when(gap == "unmatched", "read the posted signs")
    return F.struct(reason.alias("reason"), caveat.alias("caveat"))


def missing_calendars(keys: DataFrame, calendar: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """key, missing: whether a key has no calendar days, or its load recorded that it found none (value of meta)."""
    has = calendar.select(key).distinct().withColumn("_has", F.lit(True))
    said = meta.groupBy(key).agg(F.max(~F.lower(F.trim(F.coalesce("value", F.lit("")))).isin(NOT_SET)).alias("_said"))
    rows = keys.select(key).distinct().join(has, key, "left").join(said, key, "left")
    return rows.select(key, (F.col("_has").isNull() | F.coalesce("_said", F.lit(False))).alias("missing"))


def is_clock(text: Column) -> Column:
    """HH:MM of a day."""
    return F.coalesce(text.rlike(r"^[0-9]{2}:[0-9]{2}$") & (F.substring(text, 1, 2).try_cast("int") < 24) & (F.substring(text, 4, 2).try_cast("int") < 60), F.lit(False))


def is_month_day(text: Column) -> Column:
    """MM-DD, any month with up to 31 days."""
    return F.coalesce(text.rlike(r"^[0-9]{2}-[0-9]{2}$") & F.substring(text, 1, 2).try_cast("int").between(1, 12) & F.substring(text, 4, 2).try_cast("int").between(1, 31), F.lit(False))


def raw_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, one row with the number skipped) of raw rows (id, full_name, label, kind, width, line): ids and kinds trimmed,
    the full name or else the label, the usual width where none is given; a row without id, name or a line of
    two points is skipped. Nodes are the line's rounded ends, its length is measured."""
    name = F.coalesce(F.nullif(F.trim(F.coalesce(F.nullif("full_name", F.lit("")), "label")), F.lit("")))
    sound = (F.trim(F.coalesce("id", F.lit(""))) != "") & name.isNotNull() & F.coalesce(F.size("line") >= 2, F.lit(False))
    end = lambda i: staging.node_id(F.element_at("line", i)["x"], F.element_at("line", i)["y"])
    width = staging.width_or_usual(F.col("width"))
    kept = rows.where(sound).select(
        F.trim("id").alias("segment"), name.alias("name"), names.normalize(name).alias("street"), F.trim(F.coalesce("kind", F.lit(""))).alias("kind"), end(1).alias("from_node"), end(-1).alias("to_node"),
        F.aggregate(F.transform(staging.steps(F.col("line")), lambda g: g["n"]), F.lit(0.0), lambda a, n: a + n).alias("length"), width["width"].alias("width"), width["assumed"].alias("assumed"),
    )
    return kept, rows.where(~sound).agg(F.count("*").alias("skipped"))
