"""Span, join and ranking queries: suppliers stand for chains, dates for distances along them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, ranking, spans
from .tables import query, read

_LENGTH = 3000
_POSTS = f"""posts AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, CAST(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS INT) AS "at", {_LENGTH} AS len, l_linestatus = 'O' AS forward FROM lineitem)"""


def _posts(spark, d):
    at = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    return read(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", at.alias("at"), F.lit(_LENGTH).alias("len"), (F.col("l_linestatus") == "O").alias("forward"))


_OUT = ["l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "at", "span_start", "span_end", "whole_side"]
_NEAR = """near AS (SELECT *, max("at") OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb,
    min("at") OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY "at" RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sa,
    max("at") OVER (PARTITION BY l_suppkey ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ab,
    min("at") OVER (PARTITION BY l_suppkey ORDER BY "at" RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aa FROM posts)"""
_SIDE = """SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, "at", CASE WHEN e - s < 1 THEN 0 ELSE s END AS span_start, CASE WHEN e - s < 1 THEN len ELSE e END AS span_end, e - s < 1 AS whole_side FROM x"""


@query(f"""WITH {_POSTS}, {_NEAR}, x AS (SELECT *, CASE WHEN forward THEN "at" ELSE coalesce(sb, 0) END AS s, CASE WHEN forward THEN coalesce(sa, len) ELSE "at" END AS e FROM near) {_SIDE}""")
def arrow_single(spark, d):
    return spans.single_arrow(_posts(spark, d), ["l_suppkey"], "l_returnflag", "at", "len", F.col("forward")).select(*_OUT)


@query(f"WITH {_POSTS}, {_NEAR}, x AS (SELECT *, coalesce(sb, ab, 0) AS s, coalesce(sa, aa, len) AS e FROM near) {_SIDE}")
def arrow_double(spark, d):
    return spans.double_arrow(_posts(spark, d), ["l_suppkey"], "l_returnflag", "at", "len").select(*_OUT)


def _spans(spark, d):
    at = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    return read(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", at.alias("span_start"), (at + F.col("l_quantity").cast("int")).alias("span_end"))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT AS a, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT + l_quantity::INT AS b FROM lineitem),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT l_suppkey, l_returnflag, min(a) AS span_start, max(b) AS span_end, count(*) AS n FROM g GROUP BY l_suppkey, l_returnflag, island""")
def union_touching(spark, d):
    return spans.union_touching(_spans(spark, d).select("l_suppkey", "l_returnflag", "span_start", "span_end"), ["l_suppkey", "l_returnflag"])


_FLAT = """s AS (SELECT l_orderkey, l_linenumber AS m, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT AS a, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT + l_quantity::INT AS b FROM lineitem),
    edges AS (SELECT l_orderkey, a AS t FROM s UNION SELECT l_orderkey, b FROM s),
    atoms AS (SELECT l_orderkey, t AS x, lead(t) OVER (PARTITION BY l_orderkey ORDER BY t) AS y FROM edges QUALIFY y IS NOT NULL),
    sets AS (SELECT l_orderkey, x, y, list_sort(list_distinct(list(m))) AS members FROM atoms JOIN s USING (l_orderkey) WHERE a <= x AND b >= y AND a < b GROUP BY ALL),
    runs AS (SELECT *, CASE WHEN lag(y) OVER w = x AND lag(members) OVER w = members THEN 0 ELSE 1 END AS fresh FROM sets WINDOW w AS (PARTITION BY l_orderkey ORDER BY x)),
    flat AS (SELECT l_orderkey, min(x) AS span_start, max(y) AS span_end, array_to_string(any_value(members), '+') AS members
             FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM runs) GROUP BY l_orderkey, run)"""


def _flat(spark, d):
    return spans.flatten(_spans(spark, d), ["l_orderkey"], "l_linenumber").withColumn("members", F.array_join(F.col("members").cast("array<string>"), "+"))


@query(f"WITH {_FLAT} SELECT * FROM flat")
def flatten_tiling(spark, d):
    return _flat(spark, d)


@query(f"WITH {_FLAT} SELECT count(*) AS n_pieces, CAST(0 AS BIGINT) AS n_overlaps FROM flat")
def tiling_invariant(spark, d):
    flat = _flat(spark, d)
    return flat.agg(F.count("*").alias("n_pieces")).crossJoin(spans.overlaps(flat, ["l_orderkey"]).agg(F.count("*").alias("n_overlaps")))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_quantity)::INT AS len FROM lineitem GROUP BY ALL),
    m AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM u),
    s AS (SELECT o_orderkey AS l_orderkey, (o_orderkey % 20)::INT AS a, (o_orderkey % 20 + 60)::INT AS b FROM orders),
    p AS (SELECT *, greatest(a - f, 0) AS lo, least(b - f, len) AS hi FROM s JOIN m USING (l_orderkey))
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN len - hi ELSE lo END AS BIGINT) AS local_start, CAST(CASE WHEN l_returnflag = 'R' THEN len - lo ELSE hi END AS BIGINT) AS local_end FROM p WHERE hi > lo""")
def project_span(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_quantity").cast("int").alias("len"))
    start = (F.col("o_orderkey") % 20).cast("int")
    chains = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), start.alias("span_start"), (start + 60).alias("span_end"))
    rows = spans.project(chains, lines, "l_orderkey", "l_linenumber", "len", F.col("l_returnflag") == "R")
    return rows.select("l_orderkey", "l_linenumber", F.col("local_start").cast("long").alias("local_start"), F.col("local_end").cast("long").alias("local_end"))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT l_suppkey, arg_min(l_returnflag, (-w, l_returnflag)) AS l_returnflag, max(w) AS weight FROM s GROUP BY l_suppkey""")
def side_vote(spark, d):
    return spans.majority(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity")


@query("""SELECT p_partkey, side FROM part, (VALUES ('A'), ('N'), ('R')) s(side) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = side)""")
def placeholders(spark, d):
    seen = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("side"))
    return spans.placeholders(read(spark, d, "part").select("p_partkey"), seen, "side", ["A", "N", "R"])


@query("""WITH e AS (SELECT user_id, event_id, CAST(value * 100 AS BIGINT)::DOUBLE AS v, event_type = 'error' AS known FROM events),
    k AS (SELECT user_id, event_id AS a, v FROM e WHERE known), p AS (SELECT user_id, event_id FROM e WHERE NOT known),
    x AS (SELECT p.user_id, p.event_id, max(k.a) FILTER (k.a < p.event_id) AS before_at, min(k.a) FILTER (k.a > p.event_id) AS after_at,
          arg_max(k.v, k.a) FILTER (k.a < p.event_id) AS v0, arg_min(k.v, k.a) FILTER (k.a > p.event_id) AS v1 FROM p LEFT JOIN k ON k.user_id = p.user_id GROUP BY ALL)
    SELECT user_id, event_id, before_at, after_at, round(CASE WHEN after_at - before_at <= 5000 THEN v0 + (event_id - before_at) / (after_at - before_at) * (v1 - v0) END, 4) AS interpolated FROM x""")
def asof_interpolate(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("value") * 100).alias("x"))
    e = e.withColumn("v", F.expr("cast(round(x) as bigint)").cast("double"))
    rows = joins.asof_interpolate(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), ["user_id"], "event_id", "v", 5000)
    return rows.withColumn("interpolated", F.round("interpolated", 4))


@query("""WITH k AS (SELECT DISTINCT p_brand, p_size::BIGINT AS k FROM part WHERE p_partkey % 3 = 0)
    SELECT p_partkey, p_brand, p_size, (SELECT arg_min(k, (abs(k - p_size), k)) FROM k WHERE k.p_brand = part.p_brand) AS nearest FROM part WHERE p_partkey % 3 <> 0""")
def nearest_key(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    points = part.where("p_partkey % 3 <> 0")
    near = joins.nearest_key(points.select("p_brand", "p_size").distinct(), part.where("p_partkey % 3 = 0").select("p_brand", "p_size").distinct(), ["p_brand"], "p_size")
    return points.join(near, ["p_brand", "p_size"]).select("p_partkey", "p_brand", "p_size", "nearest")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, s_suppkey * 7 % 900 AS low, s_suppkey * 7 % 900 + 60 AS high FROM supplier)
    SELECT c_custkey, s_suppkey FROM customer JOIN r ON s_nationkey = c_nationkey AND c_custkey % 1000 BETWEEN low AND high AND c_custkey % 1000 % 2 = low % 2""")
def range_parity(spark, d):
    points = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 1000).alias("at"))
    low = F.col("s_suppkey") * 7 % 900
    ranges = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), low.alias("low"), (low + 60).alias("high"))
    return joins.range_lookup(points, ranges, ["nation"], "at", 64).select("c_custkey", "s_suppkey")


@query("""WITH c AS (SELECT c_custkey AS k, 1 AS rung, o_orderkey AS v FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
      UNION ALL SELECT c_custkey, 2, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%' UNION ALL SELECT c_custkey, 3, -1 FROM customer)
    SELECT k AS c_custkey, rung, count(*) AS n, min(v) AS first FROM (SELECT *, min(rung) OVER (PARTITION BY k) AS m FROM c) WHERE rung = m GROUP BY ALL""")
def ladder_first_rung(spark, d):
    orders = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    rung = lambda df: df.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("v"))
    last = read(spark, d, "customer").select("c_custkey", F.lit(-1).cast("long").alias("v"))
    rows = joins.first_rung([rung(orders.where("o_orderstatus = 'F'")), rung(orders.where("o_orderpriority LIKE '1%'")), last], "c_custkey")
    return rows.groupBy("c_custkey", "rung").agg(F.count("*").alias("n"), F.min("v").alias("first"))


@query("""SELECT l_orderkey, coalesce(string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey), '') AS names, count(*) FILTER (p_name IS NULL) AS dangling
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = l_partkey GROUP BY l_orderkey""")
def array_fk_ordered(spark, d):
    lists = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    names = read(spark, d, "part").where("p_partkey % 10 <> 0").select("p_partkey", "p_name")
    rows = joins.ordered_lookup(lists, "l_orderkey", "ids", names, "p_partkey", "p_name")
    return rows.withColumn("names", F.array_join("names", "|"))


@query("""SELECT DISTINCT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey""")
def pair_both_ways(spark, d):
    return joins.pairs_both_ways(read(spark, d, "lineitem"), "l_orderkey", "l_partkey")


_FACE = "SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT AS span_start, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT + l_quantity::INT AS span_end FROM lineitem"


@query(f"""WITH s AS ({_FACE}) SELECT DISTINCT * FROM s g WHERE l_returnflag = 'N' AND EXISTS (SELECT 1 FROM s b WHERE b.l_returnflag = 'R' AND b.l_suppkey = g.l_suppkey AND g.span_start < b.span_end AND b.span_start < g.span_end)""")
def contested_demote(spark, d):
    rows = _spans(spark, d)
    return joins.contested(rows.where("l_returnflag = 'N'"), rows.where("l_returnflag = 'R'"), ["l_suppkey"], "span_start", "span_end", 32)


@query("""WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT AS span_start, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT + l_quantity::INT AS span_end FROM lineitem),
    s AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber, l_partkey ORDER BY span_start, span_end)) AS id FROM l)
    SELECT a.id AS a, b.id AS b, least(a.span_end, b.span_end) - greatest(a.span_start, b.span_start) AS overlap FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.id < b.id AND a.span_start < b.span_end AND b.span_start < a.span_end""")
def bucketed_overlap_pairs(spark, d):
    at = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    own = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = read(spark, d, "lineitem").select("l_suppkey", *own, at.alias("span_start"), (at + F.col("l_quantity").cast("int")).alias("span_end"))
    nth = F.row_number().over(Window.partitionBy("l_suppkey", *own).orderBy("span_start", "span_end"))  # an order may have a line twice
    rows = rows.withColumn("id", F.concat_ws("-", *own, nth))
    return joins.overlapping_pairs(rows, "id", ["l_suppkey"], "span_start", "span_end", 32)


@query("""SELECT s_suppkey, CASE WHEN n_name IS NOT NULL AND r_name IS NOT NULL THEN n_name || ' to ' || r_name WHEN n_name IS NOT NULL OR r_name IS NOT NULL THEN 'at ' || coalesce(n_name, r_name) END AS label
    FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 7 <> 0) ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = s_suppkey % 6""")
def outer_labels(spark, d):
    nation = read(spark, d, "nation").where("n_nationkey % 7 <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.array(F.lit("Own  Street"), "n_name").alias("names"))
    region = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.array("r_name").alias("names"))
    segments = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("from_node"), F.concat(F.lit("r"), F.col("s_suppkey") % 6).alias("to_node"))
    return joins.labelled(segments, nation.union(region), F.lit("OWN STREET")).select("s_suppkey", "label")


_RATES = ["5.00", "8.25", "10.50"]


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, (l_quantity * 7)::INT AS minutes, [500, 825, 1050][:1 + (l_partkey % 3)::INT] AS cents FROM lineitem)
    SELECT l_orderkey, l_linenumber, minutes, CAST(((2 * list_sum(list_transform(range(0, (minutes + 59) // 60), lambda i: cents[least(i + 1, len(cents))] * least(60, minutes - i * 60))) + 60)::BIGINT // 120) / 100.0 AS DECIMAL(12, 2)) AS price FROM m""")
def progressive_price(spark, d):
    rates = F.slice(F.array(*[F.lit(r).cast("decimal(12,2)") for r in _RATES]), 1, (1 + F.col("l_partkey") % 3).cast("int"))
    minutes = (F.col("l_quantity") * 7).cast("int")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", minutes.alias("minutes"), ranking.progressive_price(rates, minutes).alias("price"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round((1 - l_discount::DECIMAL(9, 4)) * 32.5, 2) AS DECIMAL(12, 2)) AS risk,
    round(l_quantity * 10 * 1.3 / 1.34 / 60 + l_tax::DECIMAL(12, 2)::DOUBLE + CAST(round((1 - l_discount::DECIMAL(9, 4)) * 32.5, 2) AS DECIMAL(12, 2))::DOUBLE * 0.5, 6) AS score FROM lineitem""")
def risk_score(spark, d):
    risk = ranking.risk_dollars(F.col("l_discount"))
    score = ranking.total_cost(ranking.walk_minutes(F.col("l_quantity") * 10), F.col("l_tax").cast("decimal(12,2)"), risk)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", risk.alias("risk"), F.round(score, 6).alias("score"))


@query("""WITH RECURSIVE s AS (SELECT p_brand, p_retailprice AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i FROM (SELECT DISTINCT p_brand, p_retailprice FROM part)),
    w AS (SELECT p_brand, x, i, x AS anchor, 0 AS band FROM s WHERE i = 1
          UNION ALL SELECT s.p_brand, s.x, s.i, CASE WHEN s.x - w.anchor > 25 THEN s.x ELSE w.anchor END, CASE WHEN s.x - w.anchor > 25 THEN w.band + 1 ELSE w.band END FROM w JOIN s ON s.p_brand = w.p_brand AND s.i = w.i + 1)
    SELECT p.p_brand, p_partkey, p_retailprice, band FROM part p JOIN w ON w.p_brand = p.p_brand AND w.x = p_retailprice""")
def anchored_bands(spark, d):
    return ranking.anchored_bands(read(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", 25.0)


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS good, o_custkey FROM orders), n AS (SELECT count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_other FROM o)
    SELECT * FROM (SELECT o_orderkey, o_totalprice, o_custkey, 'good' AS part FROM o WHERE good ORDER BY o_totalprice, o_orderkey LIMIT 100), n
    UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, o_custkey, 'other' FROM o WHERE NOT good ORDER BY o_custkey, o_orderkey LIMIT 500), n""")
def split_and_cap(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    return ranking.split_and_cap(rows, F.col("o_orderstatus") == "F", "o_totalprice", "o_custkey", "o_orderkey", 100, 500).drop("o_orderstatus")


@query("""SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) JOIN customer ON c_custkey = o_custkey""")
def late_materialize(spark, d):
    top = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return names.join(F.broadcast(top), "o_custkey").select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")  # 50 rows
