"""Shared lengths of lines that repeat, of keys with several lines, and of many equal lines."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from wayside.operators import curbs

LINE = "array<struct<x:double,y:double>>"


@pytest.mark.parametrize("several", [False, True])
def test_equal_lines_and_keys_of_several_lines(spark, several):
    rng = random.Random(7)
    drawn = [(rng.randint(0, 2), rng.randint(0, 60), rng.randint(1, 90)) for _ in range(15)]
    pick = lambda: [(k % 40 if several else k, rng.choice(drawn)) for k in range(50)]
    a, b = pick(), pick()
    df = lambda rows, name: spark.createDataFrame([(k, [(float(x), float(y)), (x + n / 3, float(y)), (float(x + n), float(y))]) for k, (y, x, n) in rows] + [(99, None), (98, [(1.0, 1.0)])], f"{name} int, line {LINE}")
    want = collections.Counter()
    for i, (y, x, n) in a:
        for j, (z, v, m) in b:
            if y == z and min(x + n, v + m) > max(x, v):
                want[i, j] += min(x + n, v + m) - max(x, v)
    rows = curbs.shared_length(df(a, "a"), df(b, "b"), "a", "b", "line", 25.0).collect()
    got = {(r.a, r.b): r.shared for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_many_equal_lines_are_measured_once(spark):
    """10,000,000,000 pairs of equal lines, none of which share more than 100."""
    at = lambda x: F.struct(F.lit(float(x)).alias("x"), F.lit(3.0).alias("y"))
    lines = lambda name, x: spark.range(100_000).select(F.col("id").alias(name), F.array(at(x), at(x + 40)).alias("line"))
    began = time.time()
    shared = curbs.shared_length(lines("a", 0), lines("b", 10), "a", "b", "line", 100.0)
    assert shared.where("shared > 100").count() == 0
    assert shared.where("a = 5 AND b < 7").groupBy("shared").count().collect() == [(30.0, 7)]
    assert time.time() - began < 60
