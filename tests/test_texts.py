"""Signs taken apart: clocks, days, dates, marks, the fold of clauses; texts that are too long to read."""

import pytest
from pyspark.sql import functions as F

from wayside.operators import signs
from wayside.plans.search import query_kind


def test_too_long_signs_are_not_read(spark):
    fits = ("NO PARKING ANYTIME" + " " * 400)[:400]
    rows = signs.read_signs(spark.createDataFrame([(fits,), (fits + " ",), ("NO PARKING 8AM-6PM" + " X" * 200 + " EXCEPT SUNDAY",)], "t string"), "t").collect()
    assert len(rows) == 3 and {len(r.t): (r.action, r.confidence) for r in rows} == {400: ("park", 1.0), 401: (None, 0.0), 432: (None, 0.0)}


def test_too_long_queries_have_no_kind(spark):
    asked = [("spaces", "main " + " " * 200 + "road"), ("fits", "a" * 120), ("long", "a" * 121), ("corner", "a" * 119 + " & b st")]
    got = {r.n: r.kind for r in spark.createDataFrame(asked, "n string, t string").select("n", query_kind(F.col("t")).alias("q")).select("n", "q.kind").collect()}
    assert got == {"spaces": "street", "fits": "street", "long": None, "corner": None}


def values(spark, rows, f):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r.y for r in df.select(f(F.col("x")).alias("y")).collect()]


def test_clock_tokens(spark):
    asked = {"8AM": 480, "12AM": 0, "12PM": 720, "12:30AM": 30, "9:45PM": 1305, "0AM": 0, "NOON": 720, "MIDNIGHT": 0, "13PM": None, "25AM": None, "9:75PM": None, "8": None, "AM": None, "8:AM": None, "8PMX": None, "": None, "1:2:3AM": None}
    assert values(spark, asked, signs.clock) == list(asked.values())
    ranges = {"7-10AM": (420, 600), "11AM-2PM": (660, 840), "8PM-MIDNIGHT": (1200, 0), "8-NOON": None, "8-6": None, "25AM-9AM": None, "8AM-9:75PM": None, "8AM": None, "A-B": None, "NOON-MIDNIGHT": (720, 0)}
    assert [r and tuple(r) for r in values(spark, ranges, signs.clock_range)] == list(ranges.values())


def test_dates_and_days(spark):
    seasons = {"JUNE/1-NOV/30": (601, 1130), "MAY-SEPT": (501, 930), "FEB-FEB": (201, 229), "DEC/15-MAR/32": None, "MAYOR-X": None, "JUNE/1": None}
    assert [r and tuple(r) for r in values(spark, seasons, signs.season_range)] == list(seasons.values())
    days = {"MONDAY": 1, "MON WED FRIDAY": 21, "FRIDAY-MONDAY": 113, "SATURDAY SUNDAY HOLIDAYS": 96, "SUNDAY-SUNDAY": 64, "MON-": None, "DAY": None, "": None}
    assert values(spark, days, signs.days_of) == list(days.values())


def test_drafting_marks(spark):
    marks = ["W/4", "#2", "$50", "$1X0", "REV", "REV.3", "REV#2", "5-7-98", "12/4", "3.14", "-12", "13-5", "SW-473", "PS-1.G", "R7-100", "12\"", "12'X"]
    words = ["8-6", "X", "QWERTY-UIOP", "25AM-9AM", "8AM-9:75PM", "W/", "#", "REVERE", "A", "12", "--", "ONE-WAY"]
    assert values(spark, marks, signs.drafting_mark) == [True] * len(marks)
    assert values(spark, words, signs.drafting_mark) == [False] * len(words)


def test_one_form(spark):
    asked = {
        "10A M-11:30 A.M.": "10AM-11:30AM", "6AM - 5PM": "6AM-5PM", "8AM TO NOON": "8AM-NOON", "MONDAY -FRIDAY": "MONDAY-FRIDAY", "MON THRU FRI": "MON-FRI", "MON THU RSDAY": "MON THURSDAY",
        "MAY 15 - SEPT. 30 8AM-6PM": "MAY/15-SEPT/30 8AM-6PM", "TUESAY EXCPET SUNDAY": "TUESDAY EXCEPT SUNDAY", "NO PARKING - STOP": "NO PARKING - STOP",
    }
    assert values(spark, asked, signs.one_form) == list(asked.values())


def test_fold_of_clauses(spark):
    """Which days go with which hours, which words with which rule."""
    texts = {
        "NO PARKING MON 8AM-9AM TUE 10AM-11AM 1PM-2PM": [(1, 480, 540), (2, 600, 660), (2, 780, 840)],
        "NO PARKING 8AM-9AM MONDAY": [(1, 480, 540)], "NO PARKING MON TUE 8AM-9AM": [(3, 480, 540)], "NO PARKING ANYTIME": [(127, None, None)],
        "NO PARKING ALL DAY SUNDAY": [(64, None, None)], "8AM-9AM": [(None, None, None)], "NO STANDING EXCEPT TRUCKS LOADING & UNLOADING 8AM-9AM": [(127, 480, 540)],
        "MONDAY NO PARKING": [(127, None, None)], "(" * 200: [(None, None, None)], "2 HMP": [(127, None, None)], "2 HMP MON 9AM-5PM TUE": [(None, None, None)],
    }
    got = {}
    for r in signs.read_signs(spark.createDataFrame([(t,) for t in texts], "t string"), "t").orderBy("ordinal").collect():
        got.setdefault(r.t, []).append((r.days, r.from_min, r.to_min))
    assert got == texts
    words = {"NO PARKING X BUS STOP": [1.0], "NO PARKING 8AM-9AM X BUS STOP": [1.0, 1.0], "NO PARKING X": [0.7], "X NO PARKING": [0.7], "X BUS STOP": [1.0], "BUS STOP X": [1.0], "2 HMP 9AM-5PM X BUS STOP": [1.0], "2 HMP 9AM-5PM X NO PARKING": [0.0]}
    got = {}
    for r in signs.read_signs(spark.createDataFrame([(t,) for t in words], "t string"), "t").collect():
        got.setdefault(r.t, []).append(r.confidence)
    assert got == words


@pytest.mark.parametrize("raw", ["", "   ", "\x00", "NO PARKING\x00ANYTIME", "<script>alert(1)</script>", "=cmd|' /C calc'!A0", "你好世界", "-" * 200, "A" * 5000, "NO PARKING " * 30, "8AM-7PM " * 40, "2 " * 150, "99999999999 HMP"])
def test_odd_texts_permit_nothing(spark, raw):
    rows = signs.read_signs(spark.createDataFrame([(raw,)], "t string"), "t").collect()
    assert rows and not any(r.permitted and not r.exclusive for r in rows)
