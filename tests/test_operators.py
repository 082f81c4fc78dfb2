"""Exact behaviours on a few rows, and properties on random ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wayside.functions import common as fn
from wayside.operators import intervals, joins, names, network, profile, ranking, signs, spans
from wayside.plans import rules as rule_table


def cut(spark, a, b, minutes=(), zone=intervals.ZONE):
    df = spark.createDataFrame([(a, b)], "s string, e string").select(F.to_timestamp_ntz("s").alias("start"), F.to_timestamp_ntz("e").alias("end"))
    rows = intervals.cut_windows(df, F.array(*map(F.lit, minutes)).cast("array<int>"), zone).orderBy("piece_start").collect()
    return [(r.piece_start.strftime("%d %H:%M"), r.piece_end.strftime("%d %H:%M"), r.minutes) for r in rows]


def test_cut_at_rule_minutes_and_midnight(spark):
    got = cut(spark, "2026-09-18 22:30", "2026-09-19 09:00", (480, 1380))
    assert [g[:2] for g in got] == [("18 22:30", "18 23:00"), ("18 23:00", "19 00:00"), ("19 00:00", "19 08:00"), ("19 08:00", "19 09:00")]


@pytest.mark.parametrize("a, b, minutes", [("2026-03-08 01:00", "2026-03-08 04:00", 120), ("2026-11-01 00:00", "2026-11-02 00:00", 1500)])
def test_elapsed_minutes_over_clock_changes(spark, a, b, minutes):
    assert [g[2] for g in cut(spark, a, b)] == [minutes]


def test_wrapping_ranges(spark):
    minute = [r.v for r in spark.createDataFrame([(m,) for m in (0, 359, 360, 1199, 1200)], "m int").select(fn.in_clock_range(F.col("m"), F.lit(1200), F.lit(360)).alias("v")).collect()]
    day = [r.v for r in spark.createDataFrame([(m,) for m in (1115, 315, 316)], "m int").select(fn.in_season(F.col("m"), F.lit(1115), F.lit(315)).alias("v")).collect()]
    assert minute == [True, True, False, False, True] and day == [True, True, False]


def verdict(spark, stack_rules, a, b):
    rows = [tuple((rule_table._DEFAULT | dict(stack=1, rule_id=f"r{i}", ordinal=i) | r)[n] for n in rule_table._N) for i, r in enumerate(stack_rules)]
    rules = spark.createDataFrame(rows, rule_table.RULE_COLUMNS)
    cal = spark.createDataFrame([], "date date, suspended boolean, meters_off boolean, major boolean, no_school boolean")
    minutes = [m for r in stack_rules for m in (r.get("from_min"), r.get("to_min")) if m is not None]
    win = spark.createDataFrame([(1, 1, a, b)], "k int, stack int, s string, e string").select("k", "stack", F.to_timestamp_ntz("s").alias("start"), F.to_timestamp_ntz("e").alias("end"))
    pieces = intervals.cut_windows(win, F.array(*map(F.lit, minutes)).cast("array<int>"))
    return intervals.verdicts(intervals.resolve(pieces, rules, cal, "k", "stack"), rules, "k", "stack").first()


def test_most_restrictive_rule_decides(spark):
    v = verdict(spark, [dict(action="park"), dict(action="stop"), dict(action="stand")], "2026-09-16 10:00", "2026-09-16 12:00")
    assert (v.verdict, v.why) == ("illegal", "prohibited by r1 10:00")


def test_limit_counts_minutes_in_force(spark):
    rule = dict(permitted=True, metered=True, limit_min=120, from_min=480, to_min=1140)
    v = verdict(spark, [rule], "2026-09-16 18:00", "2026-09-16 21:00")
    assert (v.verdict, v.basis, v.charged_minutes) == ("legal", "posted", 60)
    assert verdict(spark, [rule], "2026-09-16 10:00", "2026-09-16 13:00").why == "over the limit"


def test_unreadable_rule_poisons_and_absence_permits(spark):
    day = ("2026-09-16 10:00", "2026-09-16 12:00")
    assert verdict(spark, [dict(permitted=True), dict(readable=False)], *day).verdict == "ambiguous"
    assert verdict(spark, [dict(vehicle="truck", permitted=True)], *day).basis == "absence"


POSTS = [("A1", "A", 100), ("B1", "B", 150), ("A2", "A", 200)]


def test_double_arrows_and_tiling(spark):
    posts = spark.createDataFrame([("f", *p, 300) for p in POSTS], "face string, id string, family string, at int, len int")
    got = spans.double_arrow(posts, ["face"], "family", "at", "len")
    assert {(r.id, r.span_start, r.span_end) for r in got.collect()} == {("A1", 0, 200), ("A2", 100, 300), ("B1", 100, 200)}
    flat = spans.flatten(got, ["face"], "id")
    assert {(r.span_start, r.span_end, tuple(r.members)) for r in flat.collect()} == {(0, 100, ("A1",)), (100, 200, ("A1", "A2", "B1")), (200, 300, ("A2",))}
    joined = spans.union_touching(got.where("family = 'A'"), ["face", "family"])
    assert [(r.span_start, r.span_end, r.n) for r in joined.collect()] == [(0, 300, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_tiling_keeps_cover_and_never_overlaps(spark, seed):
    rng = random.Random(seed)
    rows = [(f, i, a := rng.randrange(200), a + rng.randrange(60)) for f in range(4) for i in range(rng.randrange(2, 10))]
    flat = spans.flatten(spark.createDataFrame(rows, "face int, id int, span_start int, span_end int"), ["face"], "id")
    want = {(f, x): frozenset(i for g, i, a, b in rows if g == f and a <= x < b) for f in range(4) for x in range(260)}
    got = {}
    for r in flat.collect():
        for x in range(r.span_start, r.span_end):
            assert (r.face, x) not in got
            got[r.face, x] = frozenset(r.members)
    assert got == {k: v for k, v in want.items() if v}


def test_projection_turns_round(spark):
    chain = spark.createDataFrame([(1, 60, 120)], "c int, span_start int, span_end int")
    members = spark.createDataFrame([(1, 0, 50, False), (1, 1, 100, True)], "c int, o int, len int, back boolean")
    got = spans.project(chain, members, "c", "o", "len", F.col("back")).collect()
    assert [(r.o, r.local_start, r.local_end) for r in got] == [(1, 30, 90)]


def test_progressive_price(spark):
    rates = F.array(*[F.lit(x).cast("decimal(12,2)") for x in ("5.00", "8.25")])
    rows = spark.createDataFrame([(m,) for m in (0, 1, 30, 60, 90, 120, 150, 200)], "m int").select(ranking.progressive_price(rates, F.col("m")).alias("p")).collect()
    assert [str(r.p) for r in rows] == ["0.00", "0.08", "2.50", "5.00", "9.13", "13.25", "17.38", "24.25"]


def test_bands_are_anchored(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([0.0, 0.3, 0.5, 0.6, 1.1, 1.2])], "g string, k int, s double")
    assert [r.band for r in ranking.anchored_bands(rows, "g", "k", "s", 0.5).orderBy("s").collect()] == [0, 0, 0, 1, 2, 2]


def test_risk(spark):
    got = spark.createDataFrame([(0.98,), (0.7,)], "c double").select(ranking.risk_dollars(F.col("c")).alias("r")).collect()
    assert [str(r.r) for r in got] == ["0.65", "9.75"]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.fold(F.lit("W. 86th St."))) == "W 86 ST"
    assert sorted(one(names.variants(F.lit("E 86 ST")))) == ["86", "86 ST", "E 86", "E 86 ST"]
    words = F.array(F.lit("BRYANT"), F.lit("PARK"))
    rank = lambda *t: one(names.match_rank(F.array(*map(F.lit, t)), words))
    assert (rank("BRYANT", "PARK"), rank("BRY"), rank("PARK", "BRY"), rank("PARK"), rank("X")) == (4, 3, 2, 1, None) or (rank("BRYANT", "PARK"), rank("BRY"), rank("PARK")) == (4, 3, 1)


def test_one_edit_excludes_transposition(spark):
    w = spark.createDataFrame([("BLEEKER",), ("ABAB",)], "w string")
    t = spark.createDataFrame([("BLEECKER",), ("BAAB",)], "t string")
    assert [(r.w, r.t) for r in names.one_edit(w, t, "w", "t").collect()] == [("BLEEKER", "BLEECKER")]


def test_interpolation_between_doors(spark):
    known = spark.createDataFrame([("s", 0, 100, 1.0), ("s", 0, 104, 2.0), ("s", 1, 101, 5.0)], "s string, parity int, n int, v double")
    ask = spark.createDataFrame([("s", 0, 102), ("s", 1, 103)], "s string, parity int, n int")
    got = {r.n: r.interpolated for r in joins.asof_interpolate(ask, known, ["s", "parity"], "n", "v", 100).collect()}
    assert got == {102: 1.5, 103: None}


def test_floor_percentile_and_drift(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 2.0)], "g string, v double")
    assert profile.floor_percentiles(rows, "g", "v", [0.5]).first().v == 2.0
    got = profile.drift(spark.createDataFrame([("a", 100, 120), ("b", 100, 121), ("c", None, 5)], "k string, previous long, n long"))
    assert {r.k: r.ok for r in got.collect()} == {"a": True, "b": False, "c": True}


def test_point_in_ring_and_empty_inputs(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]])
    got = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)], "x double, y double").select(network.in_ring(F.col("x"), F.col("y"), ring).alias("i")).collect()
    assert [r.i for r in got] == [True, False]
    empty = spark.createDataFrame([], "face int, id int, span_start int, span_end int")
    assert spans.flatten(empty, ["face"], "id").count() == 0 and spans.union_touching(empty, ["face"]).count() == 0


@pytest.mark.parametrize("text, want", [
    ("2 HMP SATURDAY 8AM-7PM", dict(action="park", permitted=True, metered=True, limit_min=120, days=32, from_min=480, to_min=1140)),
    ("NO PARKING (SANITATION BROOM SYMBOL) MONDAY THURSDAY 9AM-10:30AM", dict(action="park", permitted=False, cleaning=True, days=9, from_min=540, to_min=630)),
    ("NO STOPPING (SNOW EMERGENCY) ANYTIME", dict(action="stop", permitted=False, snow=True, days=127, from_min=None)),
    ("NIGHT REGULATION NO STANDING 8PM-6AM ALL DAYS", dict(action="stand", from_min=1200, to_min=360, confidence=1.0)),
    ("3 HOUR PARKING 9AM-6PM MON-FRI (SYMBOL) COMMERCIAL VEHICLES ONLY", dict(vehicle="commercial", exclusive=True, days=31, limit_min=180)),
    ("TRUCK (SYMBOL) FARMERS MARKET ONLY JUNE 1 - NOV 30 WEDNESDAY 8AM-4PM -->", dict(exclusive=True, season_from=601, season_to=1130, days=4, arrow="one")),
    ("2 HOUR PARKING GIBBERISH", dict(action=None, permitted=None, confidence=0.0)),
    ("NO PARKING GIBBERISH", dict(permitted=False, confidence=0.7)),
    ("HELLO", dict(action=None, confidence=0.0)),
])
def test_sign_texts(spark, text, want):
    r = signs.read_signs(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert len(r) == 1 and {k: r[0][k] for k in want} == want


def test_calendar_from_text(spark):
    from wayside.plans.texts import ICS
    from wayside.sources.snapshots import calendar_days

    days = {r.date: r for r in calendar_days(spark.createDataFrame([(ICS.replace("\n", "\r\n"),)], "t string"), "t").collect()}
    assert days[dt.date(2026, 12, 25)].is_major and days[dt.date(2026, 4, 4)].label == "Later Event" and len(days) == 3


def test_stream_counts_equal_batch(spark, sf, tmp_path):
    from wayside.streaming import windows

    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(src))
    q = windows.tumbling_counts(windows.read_events(spark, str(src), 1)).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling_counts(spark.read.parquet(str(src)))
    assert sorted(map(tuple, spark.table("counts").select("start", "event_type", "n").collect())) == sorted(map(tuple, batch.select("start", "event_type", "n").collect()))
