"""The whole search over stand-in tables: radius, verdict, price, risk, score, bands, caps; and the
smaller column operators around it (query kinds, snapping, sides)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import common as fn
from ..operators import names, network, ranking
from ..operators.lineage import written
from .rules import _BASE, _VERDICTS, _verdicts
from .spans import _RATES
from .tables import posted, query, read, sql_posted


def score_results(spans: DataFrame, verdicts: DataFrame, key: str, rates: Column) -> DataFrame:
    """spans (key, metres) with their verdicts, priced and scored."""
    rows = spans.join(verdicts, key)
    priced = F.when(F.col("verdict") == "legal", F.when(F.col("charged_minutes") > 0, ranking.progressive_price(rates, F.col("charged_minutes").cast("int"))).otherwise(F.lit(0).cast("decimal(12,2)")))
    rows = rows.withColumns({"walk": ranking.walk_minutes(F.col("metres")), "price": priced, "risk": ranking.risk_dollars(F.coalesce("confidence", F.lit(1.0)))})
    return rows.withColumn("score", F.round(ranking.total_cost(F.col("walk"), F.col("price"), F.col("risk")), 6))


def rank_results(rows: DataFrame, key: str, most_good: int, most_other: int, width: float = 0.5) -> DataFrame:
    """Scored rows; the legal ones in anchored bands, posted before absence inside a band, capped last;
    the others nearest first, capped. place is the order in a part; n_legal, n_illegal, n_ambiguous,
    n_no_data and n_total count all rows before the caps.

    Only bands up to the one that holds the most_good-th score can reach the list, and their anchors are
    among the most_good lowest scores; rows of these bands are taken from all legal ones.
    """
    counts = rows.agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}") for v in ("legal", "illegal", "ambiguous", "no_data")], F.count("*").alias("n_total"))
    legal = rows.where("verdict = 'legal'")
    first = legal.orderBy("score", key).limit(most_good).withColumn("_all", F.lit(1))
    anchors = ranking.anchored_bands(first, "_all", key, "score", width).groupBy("band").agg(F.min("score").alias("_a"))
    ends = F.lead("_a").over(Window.orderBy("_a"))  # most_good rows at most
    near = (F.col("score") >= F.col("_a")) & F.when(F.col("_b").isNull(), F.col("score") - F.col("_a") <= width).otherwise(F.col("score") < F.col("_b"))
    banded = legal.join(F.broadcast(anchors.withColumn("_b", ends)), near)
    banded = banded.withColumn("_o", F.struct("band", F.when(F.col("basis") == "posted", 0).otherwise(1).alias("basis"), "score", key))
    other = rows.where("verdict <> 'legal'").withColumn("band", F.lit(None).cast("int")).orderBy("walk", key).limit(most_other)
    order = F.when(F.col("verdict") == "ambiguous", 1).when(F.col("verdict") == "illegal", 2).otherwise(3)
    other = other.withColumn("_o", F.struct(order.alias("band"), F.lit(0).alias("basis"), "score", key))
    cols = [key, "part", "place", "band", "verdict", "why", "price", "risk", "score"]
    placed = lambda df, part: df.withColumns({"part": F.lit(part), "place": F.row_number().over(Window.orderBy("_o"))}).select(*cols)
    return placed(banded.orderBy("_o").limit(most_good), "legal").union(placed(other, "other")).crossJoin(F.broadcast(counts))  # one row


def _scored(spark, d, n_points: int):
    e = lambda i: F.get("embedding", i).cast("double")
    points = network.within_radius(read(spark, d, "embeddings").select("vec_id", e(0).alias("x"), e(1).alias("y")), "x", "y", 0.0, 0.0, 0.15)
    spans = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % n_points).alias("vec_id")).join(points, "vec_id")
    rates = F.array(*[F.lit(r).cast("decimal(12,2)") for r in _RATES])
    near = read(spark, d, "orders").join(spans.select("o_orderkey"), "o_orderkey", "left_semi")  # only what is near gets a verdict
    scored = score_results(spans.select("o_orderkey", (F.col("distance") * 3000).alias("metres")), _verdicts(spark, d, near), "o_orderkey", rates)
    return written(scored)  # ranked, counted and capped from one table


@query(f"""WITH RECURSIVE {_BASE}{_VERDICTS},
    near AS (SELECT o_orderkey, sqrt(x * x + y * y) * 3000 AS metres FROM orders JOIN (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings) WHERE sqrt(x * x + y * y) <= 0.15),
    priced AS (SELECT o_orderkey, verdict, why, basis, metres * 1.3 / 1.34 / 60 AS walk,
        CASE WHEN verdict = 'legal' THEN CASE WHEN charged_minutes > 0 THEN CAST(((2 * list_sum(list_transform(range(0, (charged_minutes + 59) // 60), lambda i: [500, 825, 1050][least(i + 1, 3)] * least(60, charged_minutes - i * 60))) + 60)::BIGINT // 120) / 100.0 AS DECIMAL(12, 2)) ELSE 0::DECIMAL(12, 2) END END AS price,
        CAST(round((1 - coalesce(confidence, 1.0)::DECIMAL(9, 4)) * 32.5, 2) AS DECIMAL(12, 2)) AS risk FROM near JOIN verdicts USING (o_orderkey)),
    scored AS (SELECT *, round(walk + coalesce(price::DOUBLE, 0) + risk::DOUBLE * 0.5, 6) AS score FROM priced),
    legal AS (SELECT * FROM scored WHERE verdict = 'legal'),
    walked AS (SELECT min(score) AS anchor, 0 AS band FROM legal UNION ALL SELECT min(l.score), w.band + 1 FROM walked w JOIN legal l ON l.score - w.anchor > 0.5 GROUP BY w.band),
    banded AS (SELECT l.*, w.band FROM legal l ASOF JOIN walked w ON l.score >= w.anchor),
    placed AS (SELECT 'legal' AS part, *, row_number() OVER (ORDER BY band, CASE basis WHEN 'posted' THEN 0 ELSE 1 END, score, o_orderkey) AS place FROM banded QUALIFY place <= 100),
    others AS (SELECT 'other' AS part, *, NULL::INT AS band FROM scored WHERE verdict <> 'legal' ORDER BY walk, o_orderkey LIMIT 200),
    both_parts AS (SELECT part, place, band, o_orderkey, verdict, why, price, risk, score FROM placed
      UNION ALL SELECT part, row_number() OVER (ORDER BY CASE verdict WHEN 'ambiguous' THEN 1 WHEN 'illegal' THEN 2 ELSE 3 END, score, o_orderkey), band, o_orderkey, verdict, why, price, risk, score FROM others)
    SELECT b.*, n.* FROM both_parts b, (SELECT count(*) FILTER (verdict = 'legal') AS n_legal, count(*) FILTER (verdict = 'illegal') AS n_illegal, count(*) FILTER (verdict = 'ambiguous') AS n_ambiguous,
      count(*) FILTER (verdict = 'no_data') AS n_no_data, count(*) AS n_total FROM scored) n""")
def search_ranked(spark, d):
    return rank_results(_scored(spark, d, read(spark, d, "embeddings").count()), "o_orderkey", 100, 200)


MAX_QUERY = 120


def query_kind(text: Column) -> Column:
    """struct(kind, a, b, number) of what someone typed: a ZIP code, a corner, an address, or a street;
    null for a text of more than MAX_QUERY characters when cleaned."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cntrl}]", " "), r"\s+", " "))
    corner = F.split(clean, r"(?i)\s*&\s*|\s+(?:and|at)\s+", 2)
    number = F.regexp_extract(clean, r"^(\d{1,6})(?:-\d+)?[A-Za-z]?\s+\S", 1)
    rest = F.regexp_extract(clean, r"^\d{1,6}(?:-\d+)?[A-Za-z]?\s+(.*)$", 1)
    kind = F.when(clean.rlike(r"^\d{5}$"), "zip").when((F.size(corner) == 2) & (F.get(corner, 0) != "") & (F.get(corner, 1) != ""), "corner").when(number != "", "address").otherwise("street")
    a = F.when(kind == "corner", F.get(corner, 0)).when(kind == "address", rest).otherwise(clean)
    found = F.struct(kind.alias("kind"), names.fold(a).alias("a"), F.when(kind == "corner", names.fold(F.get(corner, 1))).alias("b"), F.when(kind == "address", number.try_cast("int")).alias("number"))
    return F.when(F.length(F.upper(clean)) <= MAX_QUERY, found)


_TYPED = {
    "10001": ("zip", "10001", None, None), "5th ave & w 42nd st": ("corner", "5 AVE", "W 42 ST", None), "broadway at wall street": ("corner", "BROADWAY", "WALL ST", None),
    "1519 3rd avenue": ("address", "3 AVE", None, 1519), "86th st": ("street", "86 ST", None, None), "12-14 main road": ("address", "MAIN RD", None, 12), "7a first st": ("address", "1 ST", None, 7),
}


@query(sql_posted([(k, *row) for k, row in _TYPED.items()], "typed, kind, a, b, number"))
def query_kinds(spark, d):
    rows = posted(spark, d, list(_TYPED), "typed").groupBy("typed").agg(F.count("*").alias("n_posts"))
    return rows.select("typed", query_kind(F.col("typed")).alias("q"), "n_posts").select("typed", "q.*", "n_posts")


def snap_confidence(name_quality: Column, n_members: Column, distance: Column, length: Column, off: Column, unclear_side: Column) -> Column:
    """0.45 name + 0.20 chain + 0.20 distance + 0.15 place, times 0.8 where the side is unclear. Distances
    past the end lose in proportion; published places agree up to 75 ft and not at all from 400."""
    chain = F.when(n_members == 1, 1.0).otherwise(F.lit(1.0) / F.greatest(n_members, F.lit(1)))
    fits = F.when(distance <= length, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (distance - length) / F.greatest(length, F.lit(1.0))))
    place = F.when(off.isNull(), 0.7).when(off <= 75, 1.0).when(off >= 400, 0.0).otherwise((400 - off) / 325)
    total = (0.45 * name_quality + 0.20 * chain + 0.20 * fits + 0.15 * place) * F.when(unclear_side, 0.8).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def side_sign(dx: Column, dy: Column, side: Column, least: float = 0.3420201433) -> Column:
    """1 if a compass side lies left of the direction (dx, dy), -1 right, 0 if too nearly along it."""
    ex = F.when(side == "E", 1.0).when(side == "W", -1.0).otherwise(0.0)
    ny = F.when(side == "N", 1.0).when(side == "S", -1.0).otherwise(0.0)
    cos = (-dy * ex + dx * ny) / F.sqrt(dx * dx + dy * dy)
    return F.when(F.abs(cos) < least, 0).when(cos > 0, 1).otherwise(-1)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_discount AS disc, l_tax AS tax, l_returnflag AS f,
      CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity * 9 END AS off FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(round(greatest(0.0, least(1.0, (0.45 * (1 - disc) + 0.20 / l_linenumber
      + 0.20 * CASE WHEN q <= 30 THEN 1.0 ELSE greatest(0.0, 1 - (q - 30) / 30.0) END
      + 0.15 * CASE WHEN off IS NULL THEN 0.7 WHEN off <= 75 THEN 1.0 WHEN off >= 400 THEN 0.0 ELSE (400 - off) / 325 END) * CASE WHEN f = 'R' THEN 0.8 ELSE 1.0 END)), 4) * 100 + 1e-6) AS INT) AS hundredths,
      CAST(CASE WHEN abs((-(q - 20) * (f = 'A')::INT + (tax * 100 + 1) * (f <> 'A')::INT) / sqrt((tax * 100 + 1) * (tax * 100 + 1) + (q - 20) * (q - 20))) < 0.3420201433 THEN 0
           WHEN -(q - 20) * (f = 'A')::INT + (tax * 100 + 1) * (f <> 'A')::INT > 0 THEN 1 ELSE -1 END AS INT) AS side FROM l""")
def snap_scores(spark, d):
    off = F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_quantity") * 9)
    score = snap_confidence(1 - F.col("l_discount"), F.col("l_linenumber"), F.col("l_quantity"), F.lit(30.0), off, F.col("l_returnflag") == "R")
    side = side_sign(F.col("l_tax") * 100 + 1, F.col("l_quantity") - 20, F.when(F.col("l_returnflag") == "A", "E").otherwise("N"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(score * 100 + 1e-6).cast("int").alias("hundredths"), side.alias("side"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^\\s*\\d') THEN 1 ELSE NULL END AS number, c_acctbal > 0 AS up, CAST((c_custkey % 2 = 0)::INT + 2 * (c_custkey % 3 = 0)::INT + 4 * (c_acctbal > 0)::INT AS INT) AS bits FROM customer""")
def flag_bitmask(spark, d):
    bits = fn.flag_bits(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0, F.col("c_acctbal") > 0)
    return read(spark, d, "customer").select("c_custkey", fn.leading_int(F.col("c_name")).alias("number"), (F.col("c_acctbal") > 0).alias("up"), bits.alias("bits"))


_ZONES = [("A", [1.50]), ("B", [5.50, 9.00]), ("C", [2.00, 3.00, 4.50]), ("D", []), ("E", [1.50])]


@query(f"""WITH {_BASE}{_VERDICTS},
    zones(k, label, cents) AS (VALUES {", ".join(f"({i}, '{n}', {[round(100 * v) for v in r]}::INT[])" for i, (n, r) in enumerate(_ZONES))}),
    held AS (SELECT DISTINCT c_custkey % 60 AS segment, ['E', 'W'][c_custkey % 2 + 1] AS side, label, cents FROM customer JOIN zones ON k = c_custkey // 60 % 5 WHERE c_custkey % 60 < 45 AND len(cents) > 0),
    s AS (SELECT o_orderkey, o_custkey % 60 AS segment, ['E', 'W'][o_orderkey % 2 + 1] AS side, verdict, charged_minutes, o_orderkey % 10 = 0 AS placeholder FROM verdicts JOIN orders USING (o_orderkey)),
    p AS (SELECT o_orderkey, label, ((2 * list_sum(list_transform(range(0, (charged_minutes + 59) // 60), lambda i: cents[least(i + 1, len(cents))] * least(60, charged_minutes - i * 60))) + 60)::BIGINT // 120) AS c FROM s JOIN held USING (segment, side) WHERE charged_minutes > 0),
    b AS (SELECT o_orderkey, max(c) AS c, arg_min(label, (-c, label)) AS label, count(DISTINCT c) AS n FROM p GROUP BY o_orderkey)
    SELECT o_orderkey, segment, side, CASE WHEN placeholder OR verdict = 'no_data' THEN NULL WHEN charged_minutes = 0 THEN 0 ELSE c / 100.0 END::DECIMAL(12, 2) AS price,
      NOT (placeholder OR verdict = 'no_data') AND (charged_minutes = 0 OR coalesce(n = 1, false)) AS price_known, CASE WHEN NOT (placeholder OR verdict = 'no_data') AND charged_minutes > 0 THEN label END AS rate_label,
      CASE WHEN placeholder OR verdict = 'no_data' OR charged_minutes = 0 THEN NULL WHEN n IS NULL THEN '{ranking.UNPRICED}' WHEN n > 1 THEN '{ranking.SEVERAL}' END AS price_note,
      verdict <> 'no_data' AND coalesce(basis <> 'absence', true) AS confidence_shown
    FROM s LEFT JOIN b USING (o_orderkey) JOIN (SELECT o_orderkey, basis FROM verdicts) USING (o_orderkey)""")
def span_prices(spark, d):
    """What every window at every curb costs: rates by segment and side, curbs in no, one or several zones."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    side = lambda n: F.when(n % 2 == 0, "E").otherwise("W")
    table = spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(_ZONES)], "k int, label string, rates array<double>").withColumn("rates", F.col("rates").cast("array<decimal(12,2)>"))
    faces = read(spark, d, "customer").where(c % 60 < 45).select((c % 60).alias("segment"), side(c).alias("side"), (F.floor(c / 60) % 5).cast("int").alias("k"))
    rates = faces.join(F.broadcast(table), "k")  # five rows
    spans = _verdicts(spark, d).join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    spans = spans.select("o_orderkey", (F.col("o_custkey") % 60).alias("segment"), side(k).alias("side"), "verdict", "charged_minutes", (k % 10 == 0).alias("placeholder"), "basis")
    shown = (F.col("verdict") != "no_data") & F.coalesce(F.col("basis") != "absence", F.lit(True))
    return ranking.price_spans(spans, rates).select("o_orderkey", "segment", "side", "price", "price_known", "rate_label", "price_note", shown.alias("confidence_shown"))
