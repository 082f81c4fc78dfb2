"""Rates of blockfaces brought to the segments of their chains, with how far to trust each, and zones for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import network, signs, staging

#: fixed values: feet between the middles of a blockface and its chain beyond which trust is halved; trust in a zone
MIDDLES_APART, HALVED, ZONE_TRUST = 150.0, 0.5, 0.6


def face_rates(faces: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed faces, misses). faces have face, side, rates_text, limit_text, label and x, y (the middle of their published
    line, or null); found has face, chain, reason (why there is none), quality (of the three names) and cx, cy (the
    chain's middle). Placed: face, chain, side, rates, unreadable, limit_min, label, far, confidence. Misses: reason
    and n; a side that is no compass letter counts before anything about the block."""
    side = staging.side_code(F.substring(F.trim("side"), 1, 1))
    rows = faces.join(found, "face", "left").withColumn("side", side)
    reason = F.when(F.col("side").isNull(), "side").when(F.col("chain").isNull(), F.coalesce("reason", F.lit("not looked up")))
    rows = rows.withColumn("reason", reason)
    misses = rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    text = lambda c: F.when(staging.not_available(F.col(c)).isNotNull(), F.trim(c))
    rates = signs.hour_rates(text("rates_text"))
    apart = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    far = F.coalesce(apart > MIDDLES_APART, F.lit(False))
    placed = rows.where("reason IS NULL").select(
        "face", "chain", "side", rates.alias("rates"), (text("rates_text").isNotNull() & (F.size(rates) == 0)).alias("unreadable"), signs.session_limit(text("limit_text")).alias("limit_min"),
        text("label").alias("label"), far.alias("far"), F.round(F.col("quality") * F.when(far, HALVED).otherwise(1.0), 4).alias("confidence"),
    )
    return placed, misses


def segment_rates(placed: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each segment of each placed face's chain, since a chain may run over several."""
    return placed.join(members.select("chain", "segment"), "chain").select("segment", "side", "face", "label", "rates", "limit_min", "confidence", F.lit("face").alias("source"))


def zone_rates(spans: DataFrame, priced: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows like segment_rates for metered spans (segment, side, x, y) whose curb has no price: one for each curb and
    the smallest zone (zone, ring, area, rates) that holds a span of it and has rates."""
    have = priced.where(F.size("rates") > 0).select("segment", "side").distinct()
    left = spans.join(have, ["segment", "side"], "left_anti").select("segment", "side", "x", "y").distinct().withColumn("_n", F.struct("segment", "side", "x", "y"))
    held = network.smallest_polygon(left.select("_n", "x", "y"), zones, "x", "y", "_n", "zone", "ring", "area")
    rows = left.join(held, "_n").join(zones.select("zone", "rates").where(F.size("rates") > 0), "zone").select("segment", "side", "zone", "rates").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("segment", "side", none("long").alias("face"), F.col("zone").alias("label"), "rates", none("int").alias("limit_min"), F.lit(ZONE_TRUST).alias("confidence"), F.lit("zone").alias("source"))


def price_counts(rates: DataFrame, metered: DataFrame) -> DataFrame:
    """One row: curbs with one price and with several by faces, metered spans, and those without any price."""
    per = rates.where((F.size("rates") > 0) & (F.col("source") == "face")).groupBy("segment", "side").agg(F.countDistinct("rates").alias("k"))
    one = per.agg(F.count(F.when(F.col("k") == 1, 1)).alias("one_price"), F.count(F.when(F.col("k") > 1, 1)).alias("several_prices"))
    have = rates.where(F.size("rates") > 0).select("segment", "side").distinct().withColumn("_p", F.lit(True))
    bare = metered.join(have, ["segment", "side"], "left").agg(F.count("*").alias("metered"), F.count(F.when(F.col("_p").isNull(), 1)).alias("unpriced"))
    return one.crossJoin(bare)  # one row each


def cents(rates: Column) -> Column:
    return F.array_join(rates.cast("array<string>"), "|")
