"""Queries over literal sign, rate and calendar texts, and the stream's batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, signs
from ..sources import snapshots
from ..streaming import windows
from .tables import posted, query, read, sql_posted

#: fixed values: worked examples of the language of signs
SIGNS = [
    "2 HMP SATURDAY 8AM-7PM", "NO PARKING (SANITATION BROOM SYMBOL) MONDAY THURSDAY 9AM-10:30AM", "NO STANDING ANYTIME", "NO PARKING ANYTIME",
    "1 HOUR METERED PARKING 9AM-7PM INCLUDING SUNDAY", "2 HOUR PARKING 8AM-6PM EXCEPT SUNDAY", "NO PARKING (SANITATION BROOM) TUES FRI 11:30AM-1PM <--",
    "NO STOPPING (SNOW EMERGENCY) ANYTIME", "3 HOUR PARKING 9AM-6PM MON-FRI (SYMBOL) COMMERCIAL VEHICLES ONLY", "NIGHT REGULATION NO STANDING 8PM-6AM ALL DAYS",
    "TRUCK (SYMBOL) FARMERS MARKET ONLY JUNE 1 - NOV 30 WEDNESDAY 8AM-4PM -->", "STAR (SYMBOL) AVO DEPT OF EDUCATION SCHOOL DAYS 7AM-4PM --> (PUBLIC SCHOOL SIGN)",
    "NO PARKING (SANITATION BROOM SYMBOL) MOON & STARS (SYMBOLS) MONDAY THURSDAY MIDNIGHT-3AM <->",
    "METERS ARE NOT IN EFFECT ABOVE TIMES (SUPERSEDES AB-473)", "NO STANDING (SINGLE ARROW) HANDICAP BUS (SYMBOL) W/4 ROUTES",
    "2 HMP 7AM-6PM EXCEPT SUNDAY 6 HMP 6PM-MIDNIGHT EXCEPT SUNDAY",
    "6 HMP MONDAY-FRIDAY 6PM-MIDNIGHT SATURDAY 8AM-MIDNIGHT <->", "NO STANDING MONDAY-FRIDAY 7AM-10AM 4PM-7PM",
    "NO STANDING 5PM-MIDNIGHT MON-FRI EXCEPT TLC LICENSED VEHICLES PRE-ARRANGED SERVICE ONLY W/ SINGLE ARROW", "NO STANDING FIRE ZONE", "NO STANDING HOTEL LOADING ZONE -->",
    "BUS STOP SIGN (BUS & HANDICAP SYMBOLS) NO STANDING <----->", "MICROHUB (SYMBOL) MICROHUB ZONE VEHICLES WITH PERMIT ONLY <->",
    "NO STANDING 8AM-6PM EXCEPT SUNDAY --> W/ ACCESS-A-RIDE (SYMBOL) ACCESS-A-RIDE BUS STOP", "FHV (SYMBOL) FOR-HIRE VEHICLES ONLY PICK-UP / DROP-OFF ONLY -->",
    "FOR HIRE VEHICLE (SYMBOL) FOR HIRE VEHICLES ONLY MONDAY -FRIDAY 8AM-MIDNIGHT <->", "2 HMP 9AM-7PM EXCEPT SUNDAY QWERTYUIOP", "NO PARKING ANYTIME QWERTYUIOP",
    #: further texts
    "2 HMP 25AM-9AM", "2 HMP 8AM-9:75PM", "1 HOUR PARKING 8-6", "2 HMP 8AM-10AM MONDAY 2PM-6PM SATURDAY", "NO STANDING 7AM-10AM OTHER TIMES NO PARKING", "NO PARKING MON THU RSDAY 10A M-11:30AM SW-473 REV 5-7-98",
]


@query()
def grammar_rules(spark, d):
    """Every sign text, on the rows of a table that repeats them."""
    texts = spark.createDataFrame(list(enumerate(SIGNS)), "k int, sign string")
    posted = read(spark, d, "part").select((F.col("p_partkey") % len(SIGNS)).cast("int").alias("k"), "p_partkey").join(F.broadcast(texts), "k")  # a row per literal
    rules = signs.read_signs(posted, "sign")
    return posted.groupBy("sign").agg(F.count("*").alias("n_posts")).join(rules, "sign")


#: rules of SIGNS by their place, worked out by hand: (sign, rule, action, permitted, vehicle, exclusive, days, from, to, metered, limit, season from, season to, arrow, confidence)
GOLDEN = [
    (0, 1, "park", True, "all", False, 32, 480, 1140, True, 120, None, None, "none", 1.0),
    (1, 1, "park", False, "all", False, 9, 540, 630, False, None, None, None, "none", 1.0),
    (2, 1, "stand", False, "all", False, 127, None, None, False, None, None, None, "none", 1.0),
    (3, 1, "park", False, "all", False, 127, None, None, False, None, None, None, "none", 1.0),
    (4, 1, "park", True, "all", False, 127, 540, 1140, True, 60, None, None, "none", 1.0),
    (5, 1, "park", True, "all", False, 63, 480, 1080, False, 120, None, None, "none", 1.0),
    (6, 1, "park", False, "all", False, 18, 690, 780, False, None, None, None, "one", 1.0),
    (7, 1, "stop", False, "all", False, 127, None, None, False, None, None, None, "none", 1.0),
    (8, 1, "park", True, "commercial", True, 31, 540, 1080, False, 180, None, None, "none", 1.0),
    (9, 1, "stand", False, "all", False, 127, 1200, 360, False, None, None, None, "none", 1.0),
    (10, 1, "stand", True, "other", True, 4, 480, 960, False, None, 601, 1130, "one", 1.0),
    (11, 1, "park", True, "authorized", True, 31, 420, 960, False, None, None, None, "one", 1.0),
    (12, 1, "park", False, "all", False, 9, 0, 180, False, None, None, None, "both", 1.0),
    (13, 1, "park", True, "all", False, 127, None, None, False, None, None, None, "none", 1.0),
    (14, 1, "stand", False, "all", False, 127, None, None, False, None, None, None, "one", 1.0),
    (15, 1, "park", True, "all", False, 63, 420, 1080, True, 120, None, None, "none", 1.0),
    (15, 2, "park", True, "all", False, 63, 1080, 0, True, 360, None, None, "none", 1.0),
    (16, 1, "park", True, "all", False, 31, 1080, 0, True, 360, None, None, "both", 1.0),
    (16, 2, "park", True, "all", False, 32, 480, 0, True, 360, None, None, "both", 1.0),
    (17, 1, "stand", False, "all", False, 31, 420, 600, False, None, None, None, "none", 1.0),
    (17, 2, "stand", False, "all", False, 31, 960, 1140, False, None, None, None, "none", 1.0),
    (18, 1, "stand", False, "all", False, 31, 1020, 0, False, None, None, None, "one", 1.0),
    (19, 1, "stand", True, "authorized", True, 127, None, None, False, None, None, None, "none", 1.0),
    (20, 1, "stand", True, "other", True, 127, None, None, False, None, None, None, "one", 1.0),
    (21, 1, "stand", True, "bus", True, 127, None, None, False, None, None, None, "both", 1.0),
    (22, 1, "stand", True, "other", True, 127, None, None, False, None, None, None, "both", 1.0),
    (23, 1, "stand", False, "all", False, 63, 480, 1080, False, None, None, None, "one", 1.0),
    (23, 2, "stand", True, "bus", True, 127, None, None, False, None, None, None, "one", 1.0),
    (24, 1, "stand", True, "taxi", True, 127, None, None, False, None, None, None, "one", 1.0),
    (25, 1, "stand", True, "taxi", True, 31, 480, 0, False, None, None, None, "both", 1.0),
    (26, 0, None, None, None, False, None, None, None, False, None, None, None, "none", 0.0),
    (27, 1, "park", False, "all", False, 127, None, None, False, None, None, None, "none", 0.7),
    (28, 0, None, None, None, False, None, None, None, False, None, None, None, "none", 0.0),
    (29, 0, None, None, None, False, None, None, None, False, None, None, None, "none", 0.0),
    (30, 0, None, None, None, False, None, None, None, False, None, None, None, "none", 0.0),
    (31, 0, None, None, None, False, None, None, None, False, None, None, None, "none", 0.0),
    (32, 1, "stand", False, "all", False, 127, 420, 600, False, None, None, None, "none", 0.7),
    (32, 2, "park", False, "all", False, 127, None, None, False, None, None, None, "none", 0.7),
    (33, 1, "park", False, "all", False, 9, 600, 690, False, None, None, None, "none", 1.0),
]
_GOLDEN_COLUMNS = "sign_no rule action permitted vehicle exclusive days from_min to_min metered limit_min season_from season_to arrow confidence".split()


def _values(rows) -> str:
    one = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), 2 * chr(39))}'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


@query(f"SELECT g.* REPLACE (CAST(confidence AS DOUBLE) AS confidence), n AS n_posts FROM (VALUES {_values(GOLDEN)}) g({', '.join(_GOLDEN_COLUMNS)}) JOIN (SELECT p_partkey % {len(SIGNS)} AS k, count(*) AS n FROM part GROUP BY k) ON k = sign_no")
def sign_rules(spark, d):
    """The rules of every sign text against those worked out by hand."""
    texts = spark.createDataFrame(list(enumerate(SIGNS)), "sign_no int, sign string")
    posted = read(spark, d, "part").select((F.col("p_partkey") % len(SIGNS)).cast("int").alias("sign_no")).join(F.broadcast(texts), "sign_no")  # a row per literal
    rules = signs.read_signs(posted, "sign").withColumnRenamed("ordinal", "rule")
    return posted.groupBy("sign_no", "sign").agg(F.count("*").alias("n_posts")).join(rules, "sign").select(*_GOLDEN_COLUMNS, "n_posts")


#: texts and (panel, outcome, family action, arity) by hand
READ = [
    ("NO PARKING ANYTIME <->", None, "full", "no-park", "double"), ("NO STANDINGBUZZARD 7AM-9AM", None, "partial", "no-stand", "none"), ("TAXI/FHV RELIEF STAND 8PM-4AM -->", None, "full", "no-stand", "single"),
    ("2 HMP 8AM-6PM NO STOPPING 6AM-8AM", None, "full", "no-stop", "none"), ("3 HOUR PARKING 9AM-5PM", None, "full", "park", "none"), ("METERS ARE NOT IN EFFECT ABOVE TIMES", None, "full", None, "none"),
    ("PAY-BY-CELL LOCATOR PLATE 104", "panel:pay_by_cell", "panel", None, None), ("M104 ROUTE PANEL", "panel:mta_route", "panel", None, None), ("STREET LOCATION PANEL", "panel:location", "panel", None, None),
    ("BACK IN ANGLE PARKING ONLY", "panel:parking_geometry", "panel", None, None), ("(SUPERSEDES R7-100)", "panel:supersedes_only", "panel", None, None), ("--", "panel:blank", "panel", None, None),
    ("DAY XYY-XYY", "panel:template", "panel", None, None), ("KEEP RIGHT", "panel:advisory", "panel", None, None), ("MICROHUB ZONE 7AM-7PM", None, "full", "no-stand", "none"), ("GRASS IS GREEN", None, "unparsed", None, None),
    ("NO PARKING 9AM-5PM EXCPET SHERIFF", None, "full", "no-park", "none"), ("NO STANDING " + 100 * "X ANYTIME ", None, "unparsed", None, None),
]


@query(sql_posted(READ, "sign, panel, outcome, family_action, arity"))
def sign_readings(spark, d):
    rows = posted(spark, d, [r[0] for r in READ], "sign")
    return rows.groupBy("sign").agg(F.count("*").alias("n_posts")).join(signs.sign_readings(rows, "sign"), "sign")


#: signs in other words: texts of one group mean the same
SAME = [
    ("NO PARKING 8AM-6PM MON-FRI", 0), ("NO PARKING MONDAY THRU FRIDAY 8AM TO 6PM", 0), ("NO PARKING 8AM-NOON MON-FRI NO PARKING NOON-6PM MON-FRI", 0), ("NO PARKING MON TUE WED THU FRI 8AM-6PM <->", 0),
    ("NO STANDING ANYTIME", 4), ("NO STANDING ALL DAYS", 4), ("NO STANDING", 4), ("BUS STOP NO STANDING", 4), ("NO STOPPING ANYTIME", 8), ("NO PARKING 8AM-6PM EXCEPT SUNDAY", 9), ("NO PARKING MONDAY-SATURDAY 8AM-6PM", 9),
    ("2 HMP 8AM-6PM", 11), ("120 MMP 8AM-6PM", 11), ("2 HOUR PARKING 8AM-6PM", 13), ("NO PARKING 8PM-6AM", 14), ("NO PARKING MIDNIGHT-6AM NO PARKING 8PM-MIDNIGHT", 14), ("NO PARKING JUNE 1 - AUG 31 8PM-6AM", 16), ("2 HMP 9AM-5PM QWERTY", 17),
]


@query(sql_posted(SAME, "sign, same_as"))
def same_effect(spark, d):
    """Signs that mean the same in every slot of a week and season, by one key; same_as is the first of them."""
    rows = posted(spark, d, [t for t, _ in SAME], "sign")
    keys = intervals.effect_keys(signs.read_signs(rows, "sign"), "sign")
    place = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(SAME) for x in (t, i)])
    first = keys.groupBy("effect").agg(F.min(F.element_at(place, F.col("sign"))).alias("same_as"))
    return rows.groupBy("sign").agg(F.count("*").alias("n_posts")).join(keys, "sign").join(first, "effect").select("sign", "same_as", "n_posts")


RATES = [("$1.50 per Hour", "1.50"), ("$5.50 1st Hour / $9.00 2nd Hour", "5.50|9.00"), ("$2.00 1st Hour / $3.00 2nd Hour / $4.50 Add'l", "2.00|3.00|4.50"), ("$3.00 2nd Hour", ""), ("N/A", ""), ("", ""), ("$1.00 per hour / $2.00 2nd hour", "")]


@query(sql_posted(RATES, "text, rates"))
def rate_parse(spark, d):
    rows = posted(spark, d, [r[0] for r in RATES], "text").groupBy("text").agg(F.count("*").alias("n_posts"))
    return rows.select("text", F.array_join(signs.hour_rates(F.col("text")).cast("array<string>"), "|").alias("rates"), "n_posts")


ICS = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nDTSTART;VALUE=DATE:20261225\nDTEND;VALUE=DATE:20261226\nDESCRIPTION:Alternate side parking suspended for Chris\n tmas Day. Parking meters will not be in effect.\nEND:VEVENT\nBEGIN:VEVENT\nDTSTART;VALUE=DATE:20260403\nDTEND;VALUE=DATE:20260405\nDESCRIPTION:Alternate side parking is suspended for Holy Days\\, spring. Meters remain.\nEND:VEVENT\nBEGIN:VEVENT\nDTSTART;VALUE=DATE:20260404\nDESCRIPTION:Alternate side suspended for Later Event.\nEND:VEVENT\nEND:VCALENDAR\n"


@query("""SELECT CAST(make_date(CAST(2000 + n_nationkey AS INT), m, d) AS DATE) AS date, label, meters_suspended, is_major FROM nation,
    (VALUES (12, 25, 'Christmas Day', true, true), (4, 3, 'Holy Days, spring', false, false), (4, 4, 'Later Event', false, false)) t(m, d, label, meters_suspended, is_major)""")
def ics_parse(spark, d):
    """A calendar a nation, each of another year."""
    year = (2000 + F.col("n_nationkey")).cast("string")
    return snapshots.calendar_days(read(spark, d, "nation").select(F.replace(F.lit(ICS), F.lit("2026"), year).alias("text")), "text")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    return windows.tumbling_counts(read(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
