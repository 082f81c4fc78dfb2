"""Profiling and staging queries over the star schema, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import common as fn
from ..operators import profile
from .tables import query, read


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY ALL""")
def freq_table(spark, d):
    return profile.frequency(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS k FROM customer GROUP BY ALL)
    SELECT c_mktsegment, CAST(sum(k) AS BIGINT) AS n, string_agg(c_nationkey || ':' || k, '|' ORDER BY k DESC, c_nationkey) AS detail FROM c GROUP BY c_mktsegment""")
def nested_counts(spark, d):
    return profile.nested_counts(read(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def crosstab(spark, d):
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, share, l_extendedprice FROM r, (VALUES (0.1::DOUBLE), (0.5), (0.9), (1.0)) s(share) WHERE i = least(n - 1, floor(share * n))""")
def floor_percentile(spark, d):
    return profile.floor_percentiles(read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.1, 0.5, 0.9, 1.0])


@query("""WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) SELECT least(size, 6) AS size, count(*) AS n_keys FROM s GROUP BY ALL""")
def hist_tail(spark, d):
    return profile.size_histogram(read(spark, d, "lineitem"), "l_orderkey", 5)


@query("""SELECT p_name, count(DISTINCT p_brand) AS n_values FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def distinct_per_group(spark, d):
    return profile.multi_valued(read(spark, d, "part"), "p_name", "p_brand")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null FROM e" for c in ("event_id", "user_id", "event_type", "value", "props", "k")).join(["WITH e AS (SELECT event_id, user_id, event_type, value, props, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) ", ""]))
def null_profile(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return profile.null_profile(events)


@query("""WITH l AS (SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, l_linenumber FROM lineitem),
    ref AS (SELECT * FROM l WHERE l_linenumber = 1), ends AS (SELECT lo AS v FROM ref UNION SELECT hi FROM ref),
    g AS (SELECT lo, hi, count(*) AS n FROM l GROUP BY ALL),
    o AS (SELECT n, CASE WHEN (lo, hi) IN (SELECT (lo, hi) FROM ref) THEN 'exact' WHEN lo IN (SELECT v FROM ends) OR hi IN (SELECT v FROM ends) THEN 'one' ELSE 'miss' END AS outcome FROM g)
    SELECT outcome, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_pairs FROM o GROUP BY outcome""")
def join_outcomes(spark, d):
    lines = read(spark, d, "lineitem")
    return profile.join_outcomes(lines, lines.where("l_linenumber = 1"), "l_partkey", "l_suppkey")


@query("""SELECT lang, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(n_chars) AS BIGINT) AS weight,
    CAST(sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) AS BIGINT) AS hit_weight FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def weighted_match_rate(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return profile.weighted_rate(rows, F.col("quality") == 1, F.col("n_chars"), "lang")


@query("""SELECT c_nationkey, round(avg(c_acctbal), 6) AS mean_balance, round(avg(c_custkey), 6) AS mean_key, count(*) AS n FROM customer GROUP BY c_nationkey""")
def centroid(spark, d):
    return read(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("mean_balance"), F.round(F.avg("c_custkey"), 6).alias("mean_key"), F.count("*").alias("n"))


@query("""SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL HAVING count(*) >= 2""")
def having_pairs(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders")).where("n >= 2")


@query("""WITH n AS (SELECT o_orderstatus AS key, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS previous, count(*) AS n FROM orders GROUP BY ALL)
    SELECT key, previous, n, previous = 0 OR abs(n - previous) <= 0.2 * previous AS ok FROM n""")
def drift_guard(spark, d):
    before = F.count(F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), 1))
    return profile.drift(read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("key")).agg(before.alias("previous"), F.count("*").alias("n")))


@query("""WITH m AS (SELECT count(*) AS line_rows, count(DISTINCT l_orderkey) AS order_keys, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem)
    SELECT key, CAST(value AS VARCHAR) AS value FROM m UNPIVOT (value FOR key IN (line_rows, order_keys, quantity))""")
def metrics_long(spark, d):
    wide = read(spark, d, "lineitem").agg(F.count("*").alias("line_rows"), F.countDistinct("l_orderkey").alias("order_keys"), F.sum("l_quantity").cast("long").alias("quantity"))
    return wide.unpivot([], wide.columns, "key", "value").select("key", F.col("value").cast("string").alias("value"))


@query("""WITH f AS (SELECT c_mktsegment, min(c_custkey) AS first FROM customer GROUP BY ALL) SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS code FROM f""")
def dictionary_encode(spark, d):
    return profile.dictionary_codes(read(spark, d, "customer"), "c_custkey", "c_mktsegment")


@query("""WITH s AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY ALL) SELECT l_orderkey, size, CAST(coalesce(sum(size) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s""")
def offset_lists(spark, d):
    return profile.list_offsets(read(spark, d, "lineitem"), "l_orderkey")


@query("""SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || 'seed'), o_orderkey) <= 20""")
def stratified_sample(spark, d):
    return profile.stratified_sample(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 20, "seed")


@query("""WITH u AS (SELECT event_id, user_id, event_type, value, 0 AS part FROM events UNION ALL SELECT event_id, user_id, event_type, value, 1 FROM events WHERE event_type = 'error'),
    k AS (SELECT *, md5(concat_ws('|', event_id, user_id, event_type)) AS key FROM u WHERE coalesce(trim(event_type), '') <> '')
    SELECT key, event_id, part, n FROM (SELECT key, event_id, part, row_number() OVER (PARTITION BY key ORDER BY part, event_id) AS r, count(*) OVER (PARTITION BY key) AS n FROM k) WHERE r = 1""")
def stage_active_dedupe(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    rows = events.withColumn("part", F.lit(0)).union(events.where("event_type = 'error'").withColumn("part", F.lit(1)))
    rows = rows.where(fn.blank_to_null(F.coalesce("event_type", F.lit(""))).isNotNull())
    key = F.md5(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type").cast("binary"))
    first = rows.groupBy(key.alias("key")).agg(F.min_by(F.struct("event_id", "part"), F.struct("part", "event_id")).alias("f"), F.count("*").alias("n"))
    return first.select("key", "f.event_id", "f.part", "n")


@query("""WITH e AS (SELECT TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, value, event_type FROM events),
    r AS (SELECT CASE WHEN event_type IS NULL OR trim(event_type) = '' THEN 'missing type' WHEN k IS NULL THEN 'unreadable k' WHEN value < 0 THEN 'negative value' WHEN k > 50 THEN 'k out of range' ELSE 'ok' END AS reason FROM e)
    SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def validate_reject_reasons(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    reason = F.when(fn.blank_to_null(F.col("event_type")).isNull(), "missing type").when(k.isNull(), "unreadable k").when(F.col("value") < 0, "negative value").when(k > 50, "k out of range").otherwise("ok")
    return read(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' || substr(text, 1, 20) WHEN 1 THEN '-' || role ELSE substr(text, 1, 20) END AS cell FROM conversations)""")
def neutralize_cells(spark, d):
    cell = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("="), F.substring("text", 1, 20))).when(F.col("turn") % 3 == 1, F.concat(F.lit("-"), "role")).otherwise(F.substring("text", 1, 20))
    return read(spark, d, "conversations").select("conv_id", "turn", fn.neutral_cell(cell).alias("cell"))


_CLASSES = [("metal", "STEEL|TIN|BRASS|COPPER|NICKEL"), ("sized", "^(SMALL|LARGE|MEDIUM)"), ("plain", "PLATED|STANDARD")]


@query("SELECT CASE " + " ".join(f"WHEN regexp_matches(upper(p_type), '{r}') THEN '{k}'" for k, r in _CLASSES) + " ELSE 'other' END AS class, count(*) AS n, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")
def classify_ordered_case(spark, d):
    kind = F.lit("other")
    for k, r in reversed(_CLASSES):
        kind = F.when(F.upper("p_type").rlike(r), k).otherwise(kind)
    return read(spark, d, "part").groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("n_names"))
