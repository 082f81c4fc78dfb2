"""Meter rates over stand-in tables: customers are blockfaces, chains of three parts each, suppliers metered spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import meters
from .curbs import _segments
from .tables import query, read
from .texts import RATES

_LIMITS = [("1 Hour", 60), ("2 Hours", 120), ("30 Minutes", 30), ("1 Hour, 2 Hours (Sat)", 60), (None, None)]
_SIDES = ["x", "s", " East", "N", "E", "S", "W", "", None]
_ZONES = {"a": (0, 0, 100, 100, "1.25"), "b": (50, 0, 300, 150, "2.50|4.00"), "c": (0, 0, 300, 200, "")}
_one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_list = lambda vs: "[" + ", ".join(map(_one, vs)) + "]"
_SQL = f"""n AS (SELECT max(p_partkey) // 3 AS chains, max(p_partkey) AS parts FROM part),
    faces AS (SELECT c_custkey AS face, {_list([None if not s or s.strip()[:1].upper() not in "NESW" else s.strip()[:1].upper() for s in _SIDES])}[c_custkey % 9 + 1] AS side, {_list([r for _, r in RATES])}[c_custkey % 7 + 1] AS rates,
      {_list([m for _, m in _LIMITS])}[c_custkey % 5 + 1] AS limit_min, CASE WHEN c_custkey % 10 > 0 THEN 'Zone ' || c_custkey % 3 END AS label, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 300 END AS off, [1.0, 0.95, 0.9][c_custkey % 3 + 1]::DOUBLE AS quality,
      CASE WHEN c_custkey % 7 = 3 THEN 'street' WHEN c_custkey % 13 = 5 THEN 'no way' END AS lost, c_custkey % chains AS chain FROM customer, n),
    why AS (SELECT *, CASE WHEN side IS NULL THEN 'side' ELSE lost END AS reason FROM faces),
    by_face AS (SELECT p_partkey AS segment, side, face, label, rates, limit_min, round(quality * CASE WHEN off > 150 THEN 0.5 ELSE 1 END, 4) AS confidence, 'face' AS source FROM why JOIN part ON p_partkey // 3 = chain WHERE reason IS NULL),
    metered AS (SELECT s_suppkey * 3 % parts + 1 AS segment, ['N', 'E', 'S', 'W'][s_suppkey % 4 + 1] AS side, s_suppkey % 300 AS x, s_suppkey % 200 AS y FROM supplier, n),
    zones(zone, x0, y0, x1, y1, zrates) AS (VALUES {", ".join(f"('{k}', {a}, {b}, {c}, {d}, '{r}')" for k, (a, b, c, d, r) in _ZONES.items())}),
    inside AS (SELECT DISTINCT segment, side, arg_min(zone, (x1 - x0) * (y1 - y0)) AS zone FROM metered, zones WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND (segment, side) NOT IN (SELECT segment, side FROM by_face WHERE rates <> '') GROUP BY segment, side, x, y),
    all_rates AS (SELECT * FROM by_face UNION ALL SELECT segment, side, NULL, zone, zrates, NULL, 0.6, 'zone' FROM inside JOIN zones USING (zone) WHERE zrates <> '')"""


def _faces(spark, d):
    k = F.col("c_custkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    chains = read(spark, d, "part").agg(F.floor(F.max("p_partkey") / 3).alias("chains"))
    rows = read(spark, d, "customer").crossJoin(F.broadcast(chains))  # one row
    lost = F.when(k % 7 == 3, "street").when(k % 13 == 5, "no way")
    chain = k % F.col("chains")
    off = F.when(k % 4 > 0, k % 300)
    faces = rows.select(
        k.alias("face"), pick(_SIDES, 9).alias("side"), pick([t for t, _ in RATES], 7).alias("rates_text"), pick([t for t, _ in _LIMITS], 5).alias("limit_text"),
        F.when(k % 10 > 0, F.concat(F.lit("Zone "), (k % 3).cast("string"))).otherwise("N/A").alias("label"), (chain * 10 + off).cast("double").alias("x"), F.when(off.isNotNull(), 0.0).alias("y"),
    )
    found = rows.select(k.alias("face"), F.when(lost.isNull(), chain).alias("chain"), lost.alias("reason"), pick([1.0, 0.95, 0.9], 3).alias("quality"), (chain * 10).cast("double").alias("cx"), F.lit(0.0).alias("cy"))
    return meters.face_rates(faces, found)


def _metered(spark, d):
    parts = read(spark, d, "part").agg(F.max("p_partkey").alias("parts"))
    k = F.col("s_suppkey")
    rows = read(spark, d, "supplier").crossJoin(F.broadcast(parts))  # one row
    return rows.select((k * 3 % F.col("parts") + 1).alias("segment"), F.get(F.array(*map(F.lit, "NESW")), (k % 4).cast("int")).alias("side"), (k % 300).cast("double").alias("x"), (k % 200).cast("double").alias("y"))


def _rates(spark, d):
    placed, _ = _faces(spark, d)
    by_face = meters.segment_rates(placed, _segments(spark, d))
    zones = [(k, [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, e), (a, e), (a, b))], float((c - a) * (e - b)), [v for v in r.split("|") if v]) for k, (a, b, c, e, r) in _ZONES.items()]
    table = spark.createDataFrame(zones, "zone string, ring array<struct<x: double, y: double>>, area double, rates array<string>").withColumn("rates", F.col("rates").cast("array<decimal(12,2)>"))
    return by_face.unionByName(meters.zone_rates(_metered(spark, d), by_face, table))


@query(f"WITH {_SQL} SELECT segment, side, face, label, rates, limit_min, confidence, source FROM all_rates")
def meter_rates(spark, d):
    """Prices of every curb: by the faces whose chain runs over it, else by the zone around its metered spans."""
    return _rates(spark, d).withColumn("rates", meters.cents(F.col("rates")))


@query(f"WITH {_SQL} SELECT reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY reason")
def meter_misses(spark, d):
    return _faces(spark, d)[1]


@query(f"""WITH {_SQL}, per AS (SELECT count(DISTINCT rates) AS k FROM by_face WHERE rates <> '' GROUP BY segment, side)
    SELECT count(*) FILTER (k = 1) AS one_price, count(*) FILTER (k > 1) AS several_prices, (SELECT count(*) FROM metered) AS metered,
      (SELECT count(*) FROM metered WHERE (segment, side) NOT IN (SELECT segment, side FROM all_rates WHERE rates <> '')) AS unpriced FROM per""")
def meter_counts(spark, d):
    return meters.price_counts(_rates(spark, d), _metered(spark, d))
