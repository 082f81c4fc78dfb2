"""Queries of reading, checking, ordering and rolling up raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, profile, spans, staging
from . import spans as span_plans
from .tables import query, read

#: lines carry no mode of their own: a list by part stands for the names of streets and kinds
_MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]


def _moded(sql: str) -> str:
    return sql.replace("lineitem", f"(SELECT *, {_MODES}[CAST(l_partkey % 7 AS INT) + 1] AS l_shipmode FROM lineitem)")


def _lines(spark, d):
    return read(spark, d, "lineitem").withColumn("l_shipmode", F.get(F.array(*map(F.lit, _MODES)), (F.col("l_partkey") % 7).cast("int")))


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O' GROUP BY 1")
def constant_column(spark, d):
    return staging.constant_violations(read(spark, d, "orders"), "o_orderstatus", "O")


_GEO = """CASE c_custkey % 5 WHEN 0 THEN '{"type":"Point","coordinates":[' || (c_custkey % 90) || '.5,' || (c_custkey % 45) || ']}' WHEN 1 THEN '{"type":"LineString","coordinates":[[1,2],[3,4]]}'
    WHEN 2 THEN 'no json' WHEN 3 THEN '{"type":"Point","coordinates":["NaN",1]}' ELSE '{"type":"Point","coordinates":[7]}' END"""


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 90 + 0.5::DOUBLE END AS lon, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 45 AS DOUBLE) END AS lat FROM customer")
def geo_points(spark, d):
    return read(spark, d, "customer").select("c_custkey", staging.geo_point(F.expr(_GEO)).alias("p")).select("c_custkey", "p.lon", "p.lat")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size - 25 AS DOUBLE) ELSE 34.0::DOUBLE END AS width, coalesce(p_size <= 25, true) AS assumed FROM part""")
def usual_width(spark, d):
    return read(spark, d, "part").select("p_partkey", staging.width_or_usual(F.col("p_size") - 25).alias("w")).select("p_partkey", "w.width", "w.assumed")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 IN (0, 1) THEN NULL ELSE trim(n_name) END AS name FROM nation WHERE lower(trim((SELECT r_name FROM region WHERE r_regionkey = n_regionkey))) = 'asia' OR n_regionkey < 2""")
def folded_names(spark, d):
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region").select("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    raw = F.when(F.col("n_nationkey") % 4 == 0, " n/a ").when(F.col("n_nationkey") % 4 == 1, "  ").otherwise(F.col("n_name"))
    return n.where(staging.same_folded(F.concat(F.lit(" "), "r_name"), "Asia") | (F.col("n_regionkey") < 2)).select("n_nationkey", staging.not_available(raw).alias("name"))


@query(_moded("SELECT l_shipmode AS type, count(*) AS n FROM lineitem WHERE l_shipmode NOT IN ('AIR', 'RAIL', 'TRUCK') GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM lineitem WHERE l_shipmode IN ('AIR', 'RAIL', 'TRUCK')"))
def skipped_types(spark, d):
    kept, skipped = staging.kept_types(_lines(spark, d), "l_shipmode", ["AIR", "RAIL", "TRUCK"])
    return skipped.union(kept.agg(F.lit("kept"), F.count("*")))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN o_orderkey % 9 = 0 THEN 'price is no number' WHEN o_orderkey % 7 = 0 THEN 'price has parts of a cent' END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'geometry is no line' END]) AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY 1""")
def sink_refusals(spark, d):
    price = F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("nan"))).otherwise((F.col("o_orderkey") % 1000) / 4 + F.when(F.col("o_orderkey") % 7 == 0, 0.005).otherwise(0.0))
    shape = F.when(F.col("o_orderkey") % 5 == 0, '{"type":"LineString","coordinates":[[1,2]]}').otherwise('{"type":"LineString","coordinates":[[1,2],[3,4]]}')
    return staging.refusals(read(spark, d, "orders"), price, shape)


@query("""WITH f AS (SELECT 'days-' || (1990 + s_suppkey % 38) || CASE WHEN s_suppkey % 3 = 0 THEN '-draft' ELSE '' END || '.ics' AS name FROM supplier)
    SELECT year, coalesce((SELECT max(name) FROM f WHERE contains(name, year)), (SELECT max(name) FROM f)) AS name FROM (VALUES ('1995'), ('2025'), ('2031'), ('any')) t(year)""")
def newest_files(spark, d):
    """The newest of the files that suppliers sent, for a year, for one that none names, and for any."""
    k = F.col("s_suppkey")
    files = read(spark, d, "supplier").select(F.concat(F.lit("days-"), (1990 + k % 38).cast("string"), F.when(k % 3 == 0, "-draft").otherwise(""), F.lit(".ics")).alias("name"))
    pick = lambda year, label: staging.newest_file(files, "name", year).select(F.lit(label).alias("year"), "name")
    return pick("1995", "1995").union(pick("2025", "2025")).union(pick("2031", "2031")).union(pick(None, "any"))


@query("SELECT max(p_name) FILTER (p_partkey = 2) AS one, coalesce(max(p_name) FILTER (p_partkey = -5), max(p_name) FILTER (p_partkey = 3)) AS two, NULL::VARCHAR AS three FROM part")
def summary_keys(spark, d):
    meta = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("v"))
    return staging.first_of_keys(meta, "k", "v", {"one": ["2", "3"], "two": ["-5", "3"], "three": ["-6", "-7"]})


@query("SELECT c_custkey, printf('%.7f', (c_custkey - 700) / 8.0) || ',' || printf('%.7f', (c_custkey % 91) / 16.0) AS node FROM customer")
def node_ids(spark, d):
    return read(spark, d, "customer").select("c_custkey", staging.node_id((F.col("c_custkey") - 700) / 8, (F.col("c_custkey") % 91) / 16).alias("node"))


@query(_moded("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_shipmode = 'AIR') AND bool_or(l_shipmode = 'RAIL')"))
def meeting_nodes(spark, d):
    return staging.nodes_with_both(_lines(spark, d), "l_orderkey", "l_shipmode", "AIR", "RAIL")


@query("SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), '+') AS chain FROM lineitem GROUP BY 1")
def chain_keys(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda v: v["l_partkey"])
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(staging.chain_key(ids).alias("chain"))


@query("""SELECT o_orderkey, (o_orderkey % 3 = 0) <> (o_orderkey % 5 = 0) AS half, CASE WHEN substr(o_orderpriority, 3, 1) IN ('N') THEN 'N' END AS side,
    CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 ELSE 0.0 END::DOUBLE AS quality, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 4 = 3 THEN 0.5::DOUBLE END AS confidence,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 200 // 22 AS INT) END AS cars, greatest(0, CAST(o_orderkey % 100 AS INT) - 40) AS minutes FROM orders""")
def row_readings(spark, d):
    """The small column readings side by side."""
    k = F.col("o_orderkey")
    day = F.lit("2026-01-01 00:40:00").cast("timestamp_ntz")
    verdict = F.when(k % 4 == 0, "no_data").otherwise("legal")
    basis = F.when(k % 4 == 2, "absence").when(k % 4 == 1, "posted")
    return read(spark, d, "orders").select(
        "o_orderkey", staging.half_named(F.when(k % 3 == 0, "A"), F.when(k % 5 == 0, "B")).alias("half"), staging.side_code(F.lower(F.substring("o_orderpriority", 3, 1))).alias("side"),
        staging.name_quality(F.element_at(F.array(*map(F.lit, ("exact", "alias", "edit", "similar", "none"))), (k % 5 + 1).cast("int"))).alias("quality"),
        staging.shown_confidence(F.lit(0.5), verdict, basis).alias("confidence"), staging.capacity(k % 200, k % 3 == 0).alias("cars"),
        staging.window_minutes(day, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 100).cast("int"))).alias("minutes"),
    )


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem""")
def curb_order(spark, d):
    rows = read(spark, d, "lineitem").withColumn("at", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")))
    return staging.placed(rows, ["l_suppkey"], F.col("at").asc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("SELECT p_type AS text, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY n DESC, text LIMIT 20")
def residue(spark, d):
    """The most frequent texts that were not read, a report of twenty."""
    return read(spark, d, "part").where("p_size > 10").groupBy(F.col("p_type").alias("text")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(20)


_LINE = "array(struct(0D AS x, 0D AS y), struct(3D AS x, 4D AS y), struct(3D AS x, 10D AS y), struct(11D AS x, 16D AS y))"
_AT = "least(21.0, greatest(0.0, CAST(c_custkey % 27 AS DOUBLE) - 2))"


@query(f"""SELECT c_custkey, round(CASE WHEN s < 5 THEN s * 0.6 WHEN s < 11 THEN 3 ELSE 3 + (s - 11) * 0.8 END, 6) AS x, round(CASE WHEN s < 5 THEN s * 0.8 WHEN s < 11 THEN 4 + s - 5 ELSE 10 + (s - 11) * 0.6 END, 6) AS y,
    round(CASE WHEN s < 5 THEN s * 0.6 - 2 * 0.8 WHEN s < 11 THEN 3 - 2 ELSE 3 + (s - 11) * 0.8 - 2 * 0.6 END, 6) AS curb_x, round(CASE WHEN s < 5 THEN s * 0.8 + 2 * 0.6 WHEN s < 11 THEN 4 + s - 5 ELSE 10 + (s - 11) * 0.6 + 2 * 0.8 END, 6) AS curb_y
    FROM (SELECT c_custkey, {_AT} AS s FROM customer)""")
def points_along(spark, d):
    """A place along a line, and the kerb two units to its left."""
    rows = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 27 - 2).cast("double").alias("at"), staging.steps(F.expr(_LINE)).alias("legs"))
    rows = rows.select("c_custkey", staging.point_along(F.col("legs"), F.col("at")).alias("p"), staging.point_along(F.col("legs"), F.col("at"), F.lit(2.0)).alias("c"))
    return rows.select("c_custkey", *[F.round(F.col(v), 6).alias(n) for v, n in (("p.x", "x"), ("p.y", "y"), ("c.x", "curb_x"), ("c.y", "curb_y"))])


@query("""SELECT c_custkey, round((c_custkey % 7 - 3) / 100.0 * 111132.0 * cos(radians(40.75)), 4) AS x, round((c_custkey % 11 - 5) / 100.0 * 111132.0, 4) AS y FROM customer""")
def local_frame(spark, d):
    lon, lat = F.lit(-74.0), F.lit(40.75)
    p = staging.local_metres(lon + (F.col("c_custkey") % 7 - 3) / 100, lat + (F.col("c_custkey") % 11 - 5) / 100, lon, lat)
    return read(spark, d, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("""WITH m AS (SELECT c_nationkey, avg(c_custkey % 101) AS x, avg(c_custkey % 53) AS y FROM customer GROUP BY 1)
    SELECT c_nationkey, arg_min(c_custkey, (round((c_custkey % 101 - x) ** 2 + (c_custkey % 53 - y) ** 2, 6), c_custkey)) AS c_custkey FROM customer JOIN m USING (c_nationkey) GROUP BY 1""")
def street_pin(spark, d):
    rows = read(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 101).alias("x"), (F.col("c_custkey") % 53).alias("y"))
    return staging.nearest_to_mean(rows, "c_nationkey", "x", "y", "c_custkey")


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(upper(l_linestatus) || ' RULE ' || l_returnflag))), '|') AS rules FROM lineitem GROUP BY 1""")
def rule_identity(spark, d):
    raw = F.concat(F.lit(" "), F.lower(F.concat_ws("  rule ", "l_linestatus", "l_returnflag")), F.when(F.col("l_linenumber") % 2 == 0, " (supersedes R1-7)").otherwise(""))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(staging.rule_identity(raw).alias("rules"))


@query(_moded("""WITH f AS (SELECT o_orderkey, o_custkey, list(DISTINCT l_shipmode) AS names, count(*) > 2 AS whole FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    c AS (SELECT *, ['AIR', 'RAIL', 'SHIP', 'MAIL', 'FOB'] AS crossing FROM f)
    SELECT o_orderkey, CASE WHEN len(names) > 0 AND CASE WHEN whole THEN len(list_filter(names, lambda n: NOT list_contains(crossing, n))) = 0 ELSE list_has_any(names, crossing) END THEN 'unmatched' ELSE 'unposted' END AS kind FROM c"""))
def gap_kinds(spark, d):
    faces = _lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_shipmode").alias("names"), (F.count("*") > 2).alias("whole"))
    crossing = F.array(*map(F.lit, ("AIR", "RAIL", "SHIP", "MAIL", "FOB")))
    faces = faces.join(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return faces.select("o_orderkey", staging.gap_kind(F.col("names"), crossing, F.col("whole")).alias("kind"))


_MISS = [("late", "timing"), ("small", "size"), ("cheap", "price")]


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN dayofmonth(l_shipdate) > 28 THEN 0 WHEN l_quantity < 5 THEN 1 WHEN l_extendedprice < 5000 THEN 2 END AS i FROM lineitem)
    SELECT l_orderkey, count(*) AS n, count(i) AS n_missed, ['late', 'small', 'cheap'][min(i) + 1] AS reason, ['timing', 'size', 'price'][min(i) + 1] AS class FROM r GROUP BY 1""")
def snap_misses(spark, d):
    rows = read(spark, d, "lineitem")
    late = F.dayofmonth("l_shipdate") <= 28
    checks = [("late", late), ("small", F.col("l_quantity") >= 5), ("cheap", F.col("l_extendedprice") >= 5000)]
    return staging.first_miss(rows, "l_orderkey", checks, dict(_MISS))


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity) AS declared, sum(l_linenumber * 12) AS measured FROM lineitem GROUP BY 1), e AS (SELECT abs(declared - measured) / measured AS e FROM s),
    r AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM e), q AS (SELECT unnest([0.5, 0.9, 0.99]) AS p)
    SELECT CAST(p AS DOUBLE) AS p, round(CAST(e AS DOUBLE), 6) AS error FROM q JOIN r ON i = least(n - 1, CAST(floor(n * p) AS BIGINT))""")
def relative_errors(spark, d):
    """Quantiles of the relative error of declared against measured lengths, by their floor rank."""
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), F.sum(F.col("l_linenumber") * 12).alias("b"))
    rows = rows.select(F.lit(1).alias("g"), (F.abs(F.col("a") - F.col("b")) / F.col("b")).cast("double").alias("e"))
    found = profile.floor_percentiles(rows, "g", "e", [0.5, 0.9, 0.99])
    return found.select(F.col("share").alias("p"), F.round("e", 6).alias("error"))


@query("""WITH j AS (SELECT l_orderkey, CASE WHEN p_partkey IS NULL THEN 'no part' WHEN s_suppkey IS NULL THEN 'no supplier' ELSE 'both' END AS outcome FROM lineitem
      LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey)
    SELECT outcome, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_groups FROM j GROUP BY 1""")
def feasible_joins(spark, d):
    parts = read(spark, d, "part").where("p_size > 5").select("p_partkey")
    suppliers = read(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    rows = read(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    outcome = F.when(F.col("p_partkey").isNull(), "no part").when(F.col("s_suppkey").isNull(), "no supplier").otherwise("both")
    each = rows.groupBy(outcome.alias("outcome"), "l_orderkey").agg(F.count("*").alias("n"))  # rows first: two exchanges of what is already small
    return each.groupBy("outcome").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) THEN 'governing' ELSE 'other' END AS part FROM lineitem""")
def governing_signs(spark, d):
    keys = read(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return staging.partition_signs(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), keys, "l_partkey")


@query(_moded("""WITH links AS (SELECT l_suppkey AS owner, l_orderkey * 8 + l_linenumber AS sign, l_orderkey AS post FROM lineitem WHERE l_linenumber = 1), metas AS (SELECT l_orderkey * 8 + l_linenumber AS sign, l_orderkey AS post FROM lineitem WHERE l_shipmode = 'AIR')
    SELECT DISTINCT l.owner, m.sign FROM links l JOIN metas m USING (post) EXCEPT SELECT owner, sign FROM links"""))
def meta_siblings(spark, d):
    li = _lines(spark, d).select(F.col("l_suppkey").alias("owner"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sign"), F.col("l_orderkey").alias("post"), "l_linenumber", "l_shipmode")
    return staging.attach_siblings(li.where("l_linenumber = 1").select("owner", "sign"), li, li.where("l_shipmode = 'AIR'"), "owner", "sign", ["post"])


@query(_moded("""SELECT l_suppkey, l_shipmode, l_returnflag, min(l_orderkey) AS l_orderkey, substr(sha256(concat_ws('|', l_suppkey, l_shipmode, l_returnflag)), 1, 16) AS rule_hash FROM lineitem GROUP BY l_suppkey, l_shipmode, l_returnflag"""))
def emitted_rules(spark, d):
    rows = staging.emit_rules(_lines(spark, d), "l_suppkey", ["l_shipmode", "l_returnflag"], ["l_orderkey", "l_linenumber"])
    return rows.select("l_suppkey", "l_shipmode", "l_returnflag", "l_orderkey", "rule_hash")


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.05)")
def metered_spans(spark, d):
    metered = read(spark, d, "lineitem").where("l_tax > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(metered, "o_orderkey", "left_semi").distinct()


_A, _B = ["AIR", "SHIP"], ["RAIL", "TRUCK", "AIR"]


@query(_moded(f"""WITH p AS (SELECT DISTINCT x.l_orderkey, x.l_shipmode AS a, y.l_shipmode AS b FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_shipmode <> y.l_shipmode)
    SELECT l_orderkey, a, b, list_position({_A}, a) + list_position({_B}, b) AS rank FROM p WHERE a IN {tuple(_A)} AND b IN {tuple(_B)}"""))
def street_corners(spark, d):
    pairs = joins.pairs_both_ways(_lines(spark, d), "l_orderkey", "l_shipmode")
    cand = lambda names, c: spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], f"{c} string, rank int")
    return staging.corners(cand(_A, "a"), cand(_B, "b"), pairs).select("l_orderkey", "a", "b", "rank")


_SUGGEST = """found AS (SELECT 'street' AS kind, p_brand AS label, (p_size % 10) / 10.0 AS confidence, p_partkey % 97 AS lon, p_partkey % 31 AS lat, p_partkey % 40 AS cell FROM part
      UNION ALL SELECT 'place', s_name, (s_suppkey % 10) / 10.0, s_suppkey % 97, s_suppkey % 31, s_suppkey % 40 FROM supplier
      UNION ALL SELECT 'zip', n_name, 0.9, n_nationkey, n_regionkey, n_nationkey % 40 FROM nation),
    covered AS (SELECT * FROM found WHERE cell IN (SELECT c_custkey % 40 FROM customer WHERE c_nationkey < 3)),
    best AS (SELECT kind, label, max(CAST(confidence AS DOUBLE)) AS confidence, arg_min((lon, lat), (-confidence, lon, lat)) AS spot FROM covered GROUP BY ALL)"""


@query(f"WITH {_SUGGEST} SELECT kind, label, confidence, spot[1] AS lon, spot[2] AS lat FROM best ORDER BY confidence DESC, length(label), label, lon, lat LIMIT 8")
def suggest(spark, d):
    one = lambda df, kind, label, conf, k, lat=None: df.select(F.lit(kind).alias("kind"), F.col(label).alias("label"), conf.alias("confidence"), *(v.cast("long").alias(n) for v, n in zip(k, ("lon", "lat", "cell"), strict=True)))
    at = lambda c: (F.col(c) % 97, F.col(c) % 31, F.col(c) % 40)
    found = [
        one(read(spark, d, "part"), "street", "p_brand", (F.col("p_size") % 10) / 10, at("p_partkey")),
        one(read(spark, d, "supplier"), "place", "s_name", (F.col("s_suppkey") % 10) / 10, at("s_suppkey")),
        one(read(spark, d, "nation"), "zip", "n_name", F.lit(0.9), (F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_nationkey") % 40)),
    ]
    coverage = read(spark, d, "customer").where("c_nationkey < 3").select((F.col("c_custkey") % 40).cast("long").alias("cell"))
    return staging.suggestions(found, coverage)


@query(f"""WITH {span_plans._POSTS}, {span_plans._NEAR}, x AS (SELECT *, coalesce(sb, ab, 0) AS s, coalesce(sa, aa, len) AS e FROM near),
    y AS (SELECT l_suppkey, l_returnflag, CASE WHEN e - s < 1 THEN 0 ELSE s END AS a, CASE WHEN e - s < 1 THEN len ELSE e END AS b FROM x),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM y),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT l_suppkey, l_returnflag, min(a) AS a, max(b) AS b FROM g GROUP BY l_suppkey, l_returnflag, island),
    seg AS (SELECT k AS segment, k * 1000 AS lo, 1000 AS len FROM range(3) t(k)),
    pr AS (SELECT l_suppkey, l_returnflag, segment, CASE WHEN segment = 1 THEN 1000 - (least(b - lo, 1000)) ELSE greatest(a - lo, 0) END AS a, CASE WHEN segment = 1 THEN 1000 - greatest(a - lo, 0) ELSE least(b - lo, 1000) END AS b
           FROM u JOIN seg ON least(b - lo, 1000) > greatest(a - lo, 0)),
    edges AS (SELECT l_suppkey, segment, a AS t FROM pr UNION SELECT l_suppkey, segment, b FROM pr),
    atoms AS (SELECT *, lead(t) OVER (PARTITION BY l_suppkey, segment ORDER BY t) AS z FROM edges QUALIFY z IS NOT NULL),
    sets AS (SELECT l_suppkey, segment, t, z, array_to_string(list_sort(list_distinct(list(l_returnflag))), '+') AS members FROM atoms JOIN pr USING (l_suppkey, segment) WHERE a <= t AND b >= z GROUP BY ALL),
    runs AS (SELECT *, CASE WHEN lag(z) OVER w = t AND lag(members) OVER w = members THEN 0 ELSE 1 END AS fresh FROM sets WINDOW w AS (PARTITION BY l_suppkey, segment ORDER BY t)),
    flat AS (SELECT l_suppkey, segment, min(t) AS local_start, max(z) AS local_end, any_value(members) AS members FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey, segment ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM runs) GROUP BY l_suppkey, segment, run)
    SELECT l_suppkey, segment, local_start, local_end, members, CAST((local_end - local_start) // 22 AS INT) AS cars FROM flat
    UNION ALL SELECT s_suppkey, segment, 0, 1000, NULL, NULL FROM supplier, seg WHERE (s_suppkey, segment) NOT IN (SELECT l_suppkey, segment FROM flat)""")
def curb_pipeline(spark, d):
    """Posts of a chain of three segments, whole: extend, unite what one family states, project onto the
    segments (the middle one is walked backwards), tile, count cars, and fill what nothing covers."""
    reach = spans.double_arrow(span_plans._posts(spark, d), ["l_suppkey"], "l_returnflag", "at", "len")
    united = spans.union_touching(reach.select("l_suppkey", "l_returnflag", "span_start", "span_end"), ["l_suppkey", "l_returnflag"])
    chains = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    members = chains.select("l_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("segment"), F.lit(1000).alias("seg_len"))
    local = spans.project(united, members, "l_suppkey", "segment", "seg_len", F.col("segment") == 1)
    local = local.select("l_suppkey", "segment", "l_returnflag", F.col("local_start").alias("span_start"), F.col("local_end").alias("span_end"))
    face = ["l_suppkey", "segment"]
    tiles = spans.flatten(local, face, "l_returnflag").select(*face, F.col("span_start").alias("local_start"), F.col("span_end").alias("local_end"), F.array_join("members", "+").alias("members"))
    gaps = members.select(*face).join(tiles.select(*face), face, "left_anti").select(*face, F.lit(0).alias("local_start"), F.lit(1000).alias("local_end"), F.lit(None).cast("string").alias("members"))
    rows = tiles.unionByName(gaps)
    return rows.withColumn("cars", staging.capacity(F.col("local_end") - F.col("local_start"), F.col("members").isNull()))
