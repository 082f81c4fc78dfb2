"""Price, risk, score, anchored bands, caps."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: metres a second, detour factor, fine in dollars, chance of a citation, decay of trust
WALK_SPEED, DETOUR, FINE, CHANCE = 1.34, 1.3, 65, 0.5
WEIGHTS = (1.0, 1.0, 0.5)


def progressive_price(rates: Column, minutes: Column) -> Column:
    """Hour i costs rates[min(i, last)], the last hour by the minute; one rounding, half up, to cents.
    rates is an array of decimal(12, 2). Null without rates; 0 for no minutes."""
    hours = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(minutes / 60).cast("int") - 1))
    cents = lambda i: (F.element_at(rates, F.least(i + 1, F.size(rates))) * 100).cast("long") * F.greatest(F.lit(0), F.least(F.lit(60), minutes - i * 60))
    total = F.aggregate(hours, F.lit(0).cast("long"), lambda a, i: a + cents(i))
    exact = F.floor((2 * total + 60) / 120)
    return F.when((F.size(rates) > 0) & minutes.isNotNull(), (exact / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)"))


def risk_dollars(confidence: Column) -> Column:
    """Expected fine: the chance, times what the least confidence lacks, times the fine."""
    lack = F.lit(1).cast("decimal(9,4)") - F.greatest(F.lit(0).cast("decimal(9,4)"), F.least(F.lit(1).cast("decimal(9,4)"), confidence.cast("decimal(9,4)")))
    return F.round(lack * F.lit(CHANCE * FINE).cast("decimal(9,4)"), 2).cast("decimal(12,2)")


def walk_minutes(metres: Column) -> Column:
    return metres * DETOUR / WALK_SPEED / 60


def total_cost(walk: Column, price: Column, risk: Column, weights=WEIGHTS) -> Column:
    """An unknown price counts as 0."""
    w, m, r = weights
    return walk * w + F.coalesce(price.cast("double"), F.lit(0.0)) * m + risk.cast("double") * r


#: fixed values: what is said beside a price
UNPRICED, SEVERAL = "metered, but no rate is published", "more than one zone covers this curb"


def price_spans(spans: DataFrame, rates: DataFrame) -> DataFrame:
    """spans (segment, side, verdict, charged_minutes, placeholder and others) with price, price_known, rate_label and
    price_note. rates have segment, side, label, rates (an array of hourly prices); a curb may be in several zones.

    A stretch without rules is unpriced, not free; without charged minutes the price is 0; without a rate there is
    none; of several prices the dearest is given, marked as not known (of equal ones the first label is named). The zones
    of a curb are few and held in its row, so each span is joined once."""
    zones = rates.where(F.size("rates") > 0).groupBy("segment", "side").agg(F.collect_set(F.struct("label", "rates")).alias("_z"))
    rows = spans.join(zones, ["segment", "side"], "left")
    each = F.transform("_z", lambda z: F.struct((-progressive_price(z["rates"], F.col("charged_minutes").cast("int"))).alias("p"), z["label"].alias("l")))
    rows = rows.withColumn("_p", F.when(F.col("charged_minutes") > 0, each))
    blank = F.col("placeholder") | (F.col("verdict") == "no_data")
    free, several = F.col("charged_minutes") == 0, F.size(F.array_distinct(F.transform("_p", lambda x: x["p"]))) > 1
    best = F.array_min("_p")
    zero = F.lit(0).cast("decimal(12,2)")
    rows = rows.withColumns({
        "price": F.when(blank, None).when(free, zero).otherwise((-best["p"]).cast("decimal(12,2)")),
        "price_known": F.when(blank, False).when(free, True).otherwise(F.coalesce(F.col("_p").isNotNull() & ~several, F.lit(False))),
        "rate_label": F.when(~blank & ~free, best["l"]),
        "price_note": F.when(blank | free, None).when(F.col("_p").isNull(), UNPRICED).when(several, SEVERAL),
    })
    return rows.drop("_z", "_p")


def anchored_bands(rows: DataFrame, group: str, key: str, score: str, width: float) -> DataFrame:
    """group, key, score, band: in rising order of (score, key), a new band begins where the score
    exceeds the first of the current band by more than width.

    Bands depend on each other in a chain, so a group's distinct scores are gone over in order, in one
    streaming pass that holds a batch and the current anchor; rows then look up their score's band.
    """
    scores = rows.select(group, F.col(score).cast("double").alias("_s")).where(F.col("_s").isNotNull()).distinct()
    kind = scores.schema[group].dataType.simpleString()

    def apply(batches):
        now, anchor, band = None, None, 0
        for batch in batches:
            names, values, out = batch[group].to_pylist(), batch["_s"].to_numpy(), np.empty(batch.num_rows, np.int32)
            edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for a, b in pairwise(edges):
                if anchor is None or names[a] != now:
                    now, anchor, band = names[a], values[a], 0
                while a < b:  # from a, the scores that the current band holds
                    end = a + int(np.searchsorted(values[a:b] - anchor > width, True))
                    out[a:end] = band
                    if end < b:
                        anchor, band = values[end], band + 1
                    a = end
            yield pa.RecordBatch.from_arrays([batch[group], batch["_s"], pa.array(out)], names=[group, "_s", "band"])

    ordered = scores.repartition(group).sortWithinPartitions(group, "_s")
    bands = ordered.mapInArrow(apply, f"`{group}` {kind}, _s double, band int")
    joined = rows.withColumn("_s", F.col(score).cast("double")).join(bands, [group, "_s"])
    return joined.select(group, key, score, "band")


def split_and_cap(rows: DataFrame, good: Column, score: str, near: str, key: str, most_good: int, most_other: int) -> DataFrame:
    """The best `most_good` good rows by score and the `most_other` nearest others, with the numbers of
    both before the cap. Each cap is a bounded top-k."""
    counts = rows.agg(F.count(F.when(good, 1)).alias("n_good"), F.count(F.when(~good, 1)).alias("n_other"))
    best = rows.where(good).orderBy(score, key).limit(most_good).withColumn("part", F.lit("good"))
    other = rows.where(~good).orderBy(near, key).limit(most_other).withColumn("part", F.lit("other"))
    return best.union(other).crossJoin(F.broadcast(counts))  # one row
