"""Queries of small record readings, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, records
from .rules import _BASE, _VERDICTS, _outcomes, _rules
from .tables import query, read

_DECIDING = """SELECT o_orderkey, verdict, CASE verdict WHEN 'illegal' THEN coalesce(ban, tight) WHEN 'legal' THEN CASE WHEN basis = 'posted' THEN yes END END AS deciding FROM verdicts JOIN
      (SELECT o_orderkey, arg_min(deciding, piece_start) FILTER (NOT permitted) AS ban, arg_min(deciding, (limit_min, piece_start)) FILTER (limit_min IS NOT NULL) AS tight,
              arg_min(deciding, piece_start) FILTER (permitted AND deciding IS NOT NULL) AS yes FROM outcomes GROUP BY o_orderkey) USING (o_orderkey)"""


@query(f"WITH {_BASE}{_VERDICTS} {_DECIDING}")
def span_deciding(spark, d):
    """The rule to quote for every window's verdict."""
    outcomes = _outcomes(spark, d)
    found = intervals.verdicts(outcomes, _rules(spark), "o_orderkey", "stack")
    return records.deciding_rules(outcomes, found, "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' AND l_tax < 0.04 THEN 'reserved for ' || CASE l_suppkey % 3 WHEN 0 THEN 'bus' WHEN 1 THEN 'taxi' ELSE 'truck' END || ' vehicles'
      WHEN l_linestatus <> 'O' THEN CASE l_returnflag WHEN 'A' THEN 'no parking' WHEN 'N' THEN 'no standing' ELSE 'no stopping' END END AS said,
      CASE l_linenumber % 3 WHEN 0 THEN 'no signs are listed here' WHEN 1 THEN 'signs are listed here that could not be placed' ELSE 'nothing is known of this stretch' END AS reason,
      CASE l_linenumber % 3 WHEN 0 THEN 'unknown is not the same as unrestricted' WHEN 1 THEN 'read the posted signs' END AS caveat FROM lineitem""")
def reason_texts(spark, d):
    """What each rule says to a driver, and what each kind of gap does."""
    action = F.when(F.col("l_returnflag") == "A", "park").when(F.col("l_returnflag") == "N", "stand").otherwise("stop")
    vehicle = F.get(F.array(*map(F.lit, ("bus", "taxi", "truck"))), (F.col("l_suppkey") % 3).cast("int"))
    n = F.col("l_linenumber") % 3
    gap = records.gap_texts(F.when(n == 0, "unposted").when(n == 1, "unmatched"))
    said = records.ban_text(action, F.col("l_linestatus") == "O", F.col("l_tax") < 0.04, vehicle)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", said.alias("said"), gap["reason"].alias("reason"), gap["caveat"].alias("caveat"))


@query("""SELECT n_nationkey, n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 = 0) OR coalesce(lower(trim([' No ', '0', 'yes', NULL, 'missing', ''][n_nationkey % 6 + 1])) NOT IN ('', '0', 'false', 'no'), false) AS missing FROM nation""")
def calendar_states(spark, d):
    """Which nations have no calendar to rely on: customers' rows are its days, a note may say that none was found."""
    nations = read(spark, d, "nation")
    days = read(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_custkey % 4 = 0").select(F.col("c_nationkey").alias("n_nationkey"))
    notes = F.get(F.array(*[F.lit(v) for v in (" No ", "0", "yes", None, "missing", "")]), (F.col("n_nationkey") % 6).cast("int"))
    return records.missing_calendars(nations, days, nations.select("n_nationkey", notes.alias("value")), "n_nationkey")


@query("""WITH t AS (SELECT o_orderkey, printf('%02d:%02d', CAST(o_orderkey % 27 AS INT), CAST(o_orderkey % 63 AS INT)) AS a, printf('%02d-%02d', CAST(o_orderkey % 15 AS INT), CAST(o_orderkey % 34 AS INT)) AS b FROM orders)
    SELECT o_orderkey, o_orderkey % 27 < 24 AND o_orderkey % 63 < 60 AS clock, o_orderkey % 15 BETWEEN 1 AND 12 AND o_orderkey % 34 BETWEEN 1 AND 31 AS day, false AS odd FROM t""")
def valid_marks(spark, d):
    """Clocks and days of a year that orders carry as text, whole and with a letter behind."""
    k = F.col("o_orderkey")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    clock, day = F.concat_ws(":", two(27), two(63)), F.concat_ws("-", two(15), two(34))
    return read(spark, d, "orders").select(
        "o_orderkey", records.is_clock(clock).alias("clock"), records.is_month_day(day).alias("day"), (records.is_clock(F.concat(clock, F.lit("x"))) | records.is_month_day(F.concat(F.lit("x"), day))).alias("odd"),
    )


_RAW = """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE ' ' || p_partkey || ' ' END AS id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name || ' Avenue' END AS full_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name || ' street' END AS label,
      p_size, p_partkey % 13 = 0 AS bare FROM part), s AS (SELECT *, id <> ' ' AND coalesce(nullif(full_name, ''), label) IS NOT NULL AND NOT bare AS sound FROM r)"""


@query(f"""{_RAW} SELECT trim(id) AS segment, upper(p.p_name) || CASE WHEN s.full_name <> '' THEN ' AVE' ELSE ' ST' END AS street, CAST(s.p_size % 50 * 5 + 10 AS DOUBLE) AS length, CASE WHEN s.p_size % 4 > 0 THEN s.p_size % 4 * 10.0 ELSE 34.0 END::DOUBLE AS width, s.p_size % 4 = 0 AS assumed
    FROM s JOIN part p ON p.p_partkey = s.k WHERE sound""")
def built_segments(spark, d):
    """Segments of raw rows: trimmed, named by the full name or the label, measured, with the usual width where none is given."""
    return records.raw_segments(_raw_rows(spark, d))[0].select("segment", "street", "length", "width", "assumed")


@query(f"{_RAW} SELECT count(*) AS skipped FROM s WHERE NOT sound")
def skipped_segments(spark, d):
    return records.raw_segments(_raw_rows(spark, d))[1]


def _raw_rows(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.when(k % 13 != 0, F.array(point(F.lit(0), F.lit(0)), point(size % 50 * 3, size % 50 * 4), point(size % 50 * 3 + 10, size % 50 * 4)))
    return read(spark, d, "part").select(
        F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).alias("id"), F.when(k % 3 == 0, "").when(k % 3 == 2, F.concat("p_name", F.lit(" Avenue"))).alias("full_name"),
        F.when(k % 7 != 0, F.concat("p_name", F.lit(" street"))).alias("label"), F.lit(" 1 ").alias("kind"), (size % 4 * 10).alias("width"), line.alias("line"),
    )
