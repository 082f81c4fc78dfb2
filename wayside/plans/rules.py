"""Window and rule queries: orders stand for windows at a place, a literal table holds the rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import intervals
from .tables import query, read

RULE_COLUMNS = (
    "stack int, rule_id string, ordinal int, action string, permitted boolean, vehicle string, exclusive boolean, days int, from_min int, to_min int, "
    "season_from int, season_to int, metered boolean, limit_min int, cleaning boolean, school boolean, except_sunday boolean, including_sunday boolean, "
    "snow boolean, holiday_exempt boolean, meta boolean, readable boolean, confidence double"
)
_N = [c.split()[0] for c in RULE_COLUMNS.split(", ")]
_DEFAULT = dict(action="park", permitted=False, vehicle="all", exclusive=False, days=127, from_min=None, to_min=None, season_from=None, season_to=None, metered=False, limit_min=None, cleaning=False, school=False, except_sunday=False, including_sunday=False, snow=False, holiday_exempt=False, meta=False, readable=True, confidence=1.0)
RULES = [
    tuple((_DEFAULT | dict(stack=s, rule_id=f"r{i}", ordinal=i) | r)[n] for n in _N)
    for i, (s, r) in enumerate([
        (0, dict(permitted=True, days=63, from_min=480, to_min=1140, metered=True, limit_min=120)),
        (0, dict(action="stop", days=31, from_min=420, to_min=540)),
        (0, dict(action="stand", days=31, from_min=420, to_min=600)),
        (1, dict(days=10, from_min=510, to_min=600, cleaning=True)),
        (1, dict(permitted=True, metered=True, limit_min=2000, including_sunday=True)),
        (2, dict(action="stand", from_min=1320, to_min=360, except_sunday=True)),
        (2, dict(action="stop", vehicle="truck", permitted=True, exclusive=False)),
        (3, dict(action="stand", vehicle="bus", permitted=True, exclusive=True, days=96)),
        (4, dict(action="stop", season_from=1115, season_to=315, from_min=60, to_min=120)),
        (5, dict(permitted=True, confidence=0.7)),
        (6, dict(readable=False, confidence=0.0)),
        (6, dict(action="stop")),
        (7, dict(school=True, days=31, from_min=420, to_min=960)),
        (7, dict(snow=True, action="stop")),
    ])
]
CALENDAR = [(dt.date(1992 + k % 7, 1 + k % 12, 1 + (k * 7) % 28), k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 4 == 0) for k in range(84)]
CALENDAR = sorted({c[0]: c for c in CALENDAR}.values())


def _sql(v) -> str:
    return "NULL" if v is None else f"DATE '{v}'" if isinstance(v, dt.date) else f"'{v}'" if isinstance(v, str) else str(v)


_VALUES = ", ".join(f"({', '.join(map(_sql, r))})" for r in RULES)
_DAYS = ", ".join(f"({', '.join(map(_sql, r))})" for r in CALENDAR)
#: windows: 26 hours from a minute of the order's date, at the stack of the order's key
_BASE = f"""
    rules({', '.join(_N)}) AS (VALUES {_VALUES}),
    cal(date, suspended, meters_off, major, no_school) AS (VALUES {_DAYS}),
    win AS (SELECT o_orderkey, CAST(o_orderkey % 9 AS INT) AS stack, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS start,
                   o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) + INTERVAL 26 HOUR AS "end" FROM orders),
    mins AS (SELECT stack, from_min AS m FROM rules WHERE from_min IS NOT NULL UNION SELECT stack, to_min FROM rules WHERE to_min IS NOT NULL UNION SELECT s, 0 FROM range(9) t(s)),
    edges AS (SELECT o_orderkey, stack, start AS t FROM win UNION SELECT o_orderkey, stack, "end" FROM win
              UNION SELECT w.o_orderkey, w.stack, x.t FROM win w JOIN mins m USING (stack), range(3) k(k),
                    LATERAL (SELECT date_trunc('day', w.start) + to_days(CAST(k.k AS INT)) + to_minutes(CAST(m.m AS INT)) AS t) x WHERE x.t > w.start AND x.t < w."end"),
    pieces AS (SELECT o_orderkey, stack, CAST(t AS TIMESTAMP) AS piece_start, CAST(lead(t) OVER (PARTITION BY o_orderkey ORDER BY t) AS TIMESTAMP) AS piece_end FROM edges
               QUALIFY piece_end IS NOT NULL),
    timed AS (SELECT *, CAST(date_diff('minute', piece_start, piece_end) AS INT) AS minutes FROM pieces),
    act AS (SELECT t.*, r.* EXCLUDE (stack),
               coalesce(((r.days >> (isodow(piece_start) - 1)) & 1) = 1 AND NOT (except_sunday AND isodow(piece_start) = 7)
               AND CASE WHEN season_from IS NULL THEN true WHEN season_to >= season_from THEN month(piece_start) * 100 + day(piece_start) BETWEEN season_from AND season_to
                        ELSE month(piece_start) * 100 + day(piece_start) >= season_from OR month(piece_start) * 100 + day(piece_start) <= season_to END
               AND CASE WHEN from_min IS NULL THEN true WHEN to_min > from_min THEN hour(piece_start) * 60 + minute(piece_start) >= from_min AND hour(piece_start) * 60 + minute(piece_start) < to_min
                        ELSE hour(piece_start) * 60 + minute(piece_start) >= from_min OR hour(piece_start) * 60 + minute(piece_start) < to_min END
               AND NOT (cleaning AND coalesce(suspended, false) OR holiday_exempt AND coalesce(major, false) OR snow OR school AND coalesce(no_school, false)), false) AS active,
               CASE WHEN vehicle IN ('all', 'passenger') THEN permitted WHEN exclusive THEN false END AS says,
               metered AND (including_sunday OR isodow(piece_start) <> 7 AND NOT (coalesce(meters_off, false) OR coalesce(major, false))) AS charges
            FROM timed t LEFT JOIN rules r ON r.stack = t.stack LEFT JOIN cal c ON c.date = CAST(piece_start AS DATE)),
    marked AS (SELECT *, active AND says = false AS no, active AND says AND action = 'park' AS yes, CASE action WHEN 'park' THEN 1 WHEN 'stand' THEN 2 ELSE 3 END AS rank FROM act),
    grouped AS (SELECT o_orderkey, stack, piece_start, piece_end, minutes, coalesce(bool_or(no), false) AS prohibited, coalesce(bool_or(yes), false) AS posted,
               arg_max(rule_id, rank * 1000 - ordinal) FILTER (no) AS prohibited_by, min(limit_min) FILTER (yes) AS lim,
               arg_min(rule_id, coalesce(limit_min, 1073741824) * 1000::BIGINT + ordinal) FILTER (yes) AS permitted_by, coalesce(bool_or(yes AND charges), false) AS charging
               FROM marked GROUP BY ALL),
    outcomes AS (SELECT o_orderkey, stack, piece_start, piece_end, minutes, NOT prohibited AS permitted, CASE WHEN prohibited THEN prohibited_by ELSE permitted_by END AS deciding,
               NOT prohibited AND NOT posted AS by_absence, NOT prohibited AND charging AS charged, CASE WHEN NOT prohibited THEN lim END AS limit_min FROM grouped)"""


def _rules(spark):
    return spark.createDataFrame(RULES, RULE_COLUMNS)


def _calendar(spark):
    return spark.createDataFrame(CALENDAR, "date date, suspended boolean, meters_off boolean, major boolean, no_school boolean")


def _pieces(spark, d, orders=None):
    start = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    windows = (read(spark, d, "orders") if orders is None else orders).select("o_orderkey", (F.col("o_orderkey") % 9).cast("int").alias("stack"), start.alias("start"))
    windows = windows.withColumn("end", F.col("start") + F.make_dt_interval(F.lit(0), F.lit(26)))
    minutes = _rules(spark).groupBy("stack").agg(F.array_union(F.collect_set("from_min"), F.collect_set("to_min")).alias("at"))
    joined = windows.join(F.broadcast(minutes), "stack", "left")  # a row per literal stack
    return intervals.cut_windows(joined, F.col("at"), zone=None, key="o_orderkey").select("o_orderkey", "stack", "piece_start", "piece_end", "minutes")


def _outcomes(spark, d, orders=None):
    return intervals.resolve(_pieces(spark, d, orders), _rules(spark), _calendar(spark), "o_orderkey", "stack")


@query(f"WITH {_BASE} SELECT o_orderkey, piece_start, piece_end, minutes FROM timed")
def window_cut(spark, d):
    return _pieces(spark, d).select("o_orderkey", "piece_start", "piece_end", "minutes")


@query(f"WITH {_BASE} SELECT rule_id, count(*) AS n_pieces, count(*) FILTER (active) AS n_active FROM marked WHERE rule_id IS NOT NULL GROUP BY rule_id")
def rule_activity(spark, d):
    rows = _pieces(spark, d).join(_rules(spark), "stack").join(F.broadcast(_calendar(spark)), F.to_date("piece_start") == F.col("date"), "left")
    on = intervals.is_active(F.col("piece_start"), F.col, F.col)
    return rows.groupBy("rule_id").agg(F.count("*").alias("n_pieces"), F.count(F.when(on, 1)).alias("n_active"))


@query(f"WITH {_BASE} SELECT rule_id, CAST(isodow(piece_start) - 1 AS INT) AS day, CAST(coalesce(sum(minutes) FILTER (active AND charges), 0) AS BIGINT) AS charged_minutes FROM marked WHERE metered GROUP BY ALL")
def meter_calendar(spark, d):
    rows = _pieces(spark, d).join(_rules(spark).where("metered"), "stack").join(F.broadcast(_calendar(spark)), F.to_date("piece_start") == F.col("date"), "left")
    on = intervals.is_active(F.col("piece_start"), F.col, F.col) & intervals.is_charged(F.col("piece_start"), F.col, F.col)
    return rows.groupBy("rule_id", F.weekday("piece_start").alias("day")).agg(F.sum(F.when(on, F.col("minutes")).otherwise(0)).alias("charged_minutes"))


@query(f"WITH {_BASE} SELECT * FROM outcomes")
def most_restrictive(spark, d):
    return _outcomes(spark, d)


_VERDICTS = """,
    spans AS (SELECT o_orderkey, stack, bool_and(permitted) AS free, bool_and(by_absence) AS absent, min(piece_start) FILTER (NOT permitted) AS first,
        arg_min(deciding, piece_start) FILTER (NOT permitted) AS by_rule, min(limit_min) AS lim, coalesce(sum(minutes) FILTER (limit_min IS NOT NULL), 0) AS in_limit,
        CAST(sum(minutes) AS BIGINT) AS minutes, CAST(coalesce(sum(minutes) FILTER (charged), 0) AS BIGINT) AS charged_minutes FROM outcomes GROUP BY ALL),
    poison AS (SELECT stack, bool_or(NOT readable) AS unread, bool_or(meta) AS meta, bool_or(confidence < 0.8) AS unsure, min(confidence)::DOUBLE AS confidence FROM rules GROUP BY stack),
    said AS (SELECT s.*, p.confidence, CASE WHEN unread IS NULL THEN 'nothing posted' WHEN unread THEN 'unreadable' WHEN meta THEN 'meta' WHEN unsure THEN 'unsure'
        WHEN NOT free THEN 'prohibited by ' || by_rule || strftime(first, ' %H:%M') WHEN lim < in_limit THEN 'over the limit' WHEN absent THEN 'absence' ELSE 'posted' END AS why
        FROM spans s LEFT JOIN poison p USING (stack)),
    verdicts AS (SELECT o_orderkey, stack, CASE WHEN why = 'nothing posted' THEN 'no_data' WHEN why IN ('unreadable', 'meta', 'unsure') THEN 'ambiguous'
        WHEN why LIKE 'prohibited%' OR why = 'over the limit' THEN 'illegal' ELSE 'legal' END AS verdict, why, CASE WHEN why IN ('absence', 'posted') THEN why END AS basis,
        minutes, charged_minutes, confidence FROM said)"""


def _verdicts(spark, d, orders=None):
    return intervals.verdicts(_outcomes(spark, d, orders), _rules(spark), "o_orderkey", "stack")


@query(f"WITH {_BASE}{_VERDICTS} SELECT * FROM verdicts")
def span_verdict(spark, d):
    return _verdicts(spark, d)


@query(f"""WITH {_BASE} SELECT o_orderkey, rule_id, CAST(coalesce(sum(minutes) FILTER (active), 0) AS BIGINT) AS active_minutes,
    CASE WHEN NOT readable THEN NULL WHEN coalesce(sum(minutes) FILTER (active), 0) = 0 THEN 'none' WHEN sum(minutes) FILTER (active) = sum(minutes) THEN 'all' ELSE 'part' END AS coverage
    FROM marked WHERE rule_id IS NOT NULL GROUP BY o_orderkey, rule_id, readable""")
def rule_coverage(spark, d):
    return intervals.coverage(_pieces(spark, d), _rules(spark), _calendar(spark), "o_orderkey", "stack")


@query(f"""WITH {_BASE}, per AS (SELECT o_orderkey, piece_start, coalesce(bool_or(no), false) AS bad, coalesce(bool_or(yes), false) AS good, coalesce(bool_or(yes AND metered), false) AS metered,
        coalesce(bool_or(yes AND charges), false) AS charged, coalesce(bool_or(snow), false) AS snow, coalesce(bool_or(active AND school), false) AS school, coalesce(bool_or(cleaning), false) AS cleaning,
        coalesce(bool_or(EXISTS (SELECT 1 FROM cal WHERE cal.date = CAST(piece_start AS DATE) AND cal.suspended)), false) AS suspended FROM marked GROUP BY ALL),
    k AS (SELECT o_orderkey, bool_or(snow) AS snow, bool_or(school) AS school, bool_or(cleaning) AND bool_or(suspended) AS swept, bool_or(NOT bad AND metered AND NOT charged) AS off,
        bool_and(NOT bad AND NOT good) AS absent, bool_or(NOT bad AND NOT good) AS partly FROM per GROUP BY 1)
    SELECT o_orderkey, concat_ws('|', CASE WHEN snow THEN 'snow rule' END, CASE WHEN school THEN 'school days assumed' END, CASE WHEN swept THEN 'cleaning suspended' END,
        CASE WHEN off THEN 'meters off in part' END, CASE WHEN absent THEN 'nothing posted' WHEN partly THEN 'nothing posted in part' END) AS caveats FROM k""")
def span_caveats(spark, d):
    rows = intervals.caveats(_pieces(spark, d), _rules(spark), _calendar(spark), "o_orderkey", "stack")
    return rows.select("o_orderkey", F.array_join("caveats", "|").alias("caveats"))


@query(f"""WITH {_BASE}{_VERDICTS} SELECT o_custkey, arg_min(verdict, CASE verdict WHEN 'legal' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'illegal' THEN 2 ELSE 3 END) AS best, count(*) AS n
    FROM verdicts JOIN orders USING (o_orderkey) GROUP BY o_custkey""")
def side_best(spark, d):
    rank = F.when(F.col("verdict") == "legal", 0).when(F.col("verdict") == "ambiguous", 1).when(F.col("verdict") == "illegal", 2).otherwise(3)
    rows = _verdicts(spark, d).join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return rows.groupBy("o_custkey").agg(F.min_by("verdict", rank).alias("best"), F.count("*").alias("n"))


_SHIFT = "CASE WHEN {0} < TIMESTAMP '2026-03-08 03:00' OR {0} >= TIMESTAMP '2026-11-01 02:00' THEN 300 ELSE 240 END"


@query(f"""WITH w AS (SELECT o_orderkey, TIMESTAMP '2026-01-01' + to_days(CAST(o_orderkey % 364 AS INT)) + to_minutes(CAST(o_orderkey * 7 % 1440 AS INT)) AS s FROM orders), x AS (SELECT *, s + INTERVAL 26 HOUR AS e FROM w)
    SELECT o_orderkey, CAST(1560 + {_SHIFT.format('e')} - {_SHIFT.format('s')} AS INT) AS minutes FROM x""")
def dst_elapsed(spark, d):
    """Minutes that pass in windows of 26 hours by the wall clock, all through a year with both changes of the clock."""
    k = F.col("o_orderkey")
    start = F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 364).cast("int"), F.lit(0), (k * 7 % 1440).cast("int"))
    wall = read(spark, d, "orders").select("o_orderkey", start.alias("start")).withColumn("end", F.col("start") + F.make_dt_interval(F.lit(0), F.lit(26)))
    return intervals.cut_windows(wall, F.array().cast("array<int>")).groupBy("o_orderkey").agg(F.sum("minutes").cast("int").alias("minutes"))


@query(f"""WITH {_BASE}, slots AS (SELECT CAST(s.s AS INT) AS slot, CAST(s.s // 288 AS INT) AS day, CAST(s.s % 288 * 5 AS INT) AS minute FROM range(2016) s(s)),
    placed AS (SELECT s_suppkey AS stack, action, permitted, vehicle, days, from_min, to_min, except_sunday FROM supplier JOIN rules ON rules.stack = s_suppkey % 9
        UNION ALL SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'park' WHEN 1 THEN 'stand' ELSE 'stop' END, false, 'all', s_suppkey % 127 + 1, s_suppkey * 7 % 1440, s_suppkey * 13 % 1440, s_suppkey % 4 = 0 FROM supplier)
    SELECT slot, stack, CAST(max(CASE WHEN ((days >> day) & 1) = 1 AND NOT (except_sunday AND day = 6) AND CASE WHEN from_min IS NULL THEN true WHEN to_min > from_min THEN minute >= from_min AND minute < to_min
        ELSE minute >= from_min OR minute < to_min END AND NOT permitted AND vehicle = 'all' THEN CASE action WHEN 'park' THEN 1 WHEN 'stand' THEN 2 ELSE 3 END ELSE 0 END) AS INT) AS effect
    FROM slots, placed GROUP BY slot, stack""")
def slot_effect(spark, d):
    """What the rules of each supplier's stack mean together, slot by slot: those posted there by its key, and one of its own."""
    from ..functions import common as fn

    columns = ["stack", "action", "permitted", "vehicle", "days", "from_min", "to_min", "except_sunday"]
    k, suppliers = F.col("s_suppkey"), read(spark, d, "supplier").select("s_suppkey")
    posted = suppliers.join(F.broadcast(_rules(spark).withColumnRenamed("stack", "sign")), k % 9 == F.col("sign")).withColumn("stack", k)  # a row per literal rule
    own = suppliers.select(
        k.alias("stack"), F.when(k % 3 == 0, "park").when(k % 3 == 1, "stand").otherwise("stop").alias("action"), F.lit(False).alias("permitted"), F.lit("all").alias("vehicle"), (k % 127 + 1).cast("int").alias("days"),
        (k * 7 % 1440).cast("int").alias("from_min"), (k * 13 % 1440).cast("int").alias("to_min"), (k % 4 == 0).alias("except_sunday"),
    )
    # a stack is one row with its rules before it becomes slots; a stated number of tasks, as few bytes are much work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = F.when(F.col("action") == "park", 1).when(F.col("action") == "stand", 2).otherwise(3)
    rule = F.when(~F.col("permitted") & (F.col("vehicle") == "all"), F.struct(rank.alias("rank"), "days", "from_min", "to_min", "except_sunday"))
    rules = posted.select(*columns).unionByName(own).repartition(parts, "stack").groupBy("stack").agg(F.collect_list(rule).alias("rules"))
    rules = rules.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(2015))))
    day, minute = F.floor(F.col("slot") / 288).cast("int"), F.col("slot") % 288 * 5
    rules = rules.select("slot", "stack", "rules", day.alias("day"), minute.alias("minute"))

    def stricter(effect, r):
        on = fn.has_day(r["days"], F.col("day")) & ~(r["except_sunday"] & (F.col("day") == 6)) & fn.in_clock_range(F.col("minute"), r["from_min"], r["to_min"])
        return F.when(on, F.greatest(effect, r["rank"])).otherwise(effect)

    return rules.select("slot", "stack", F.aggregate("rules", F.lit(0), stricter).alias("effect"))
