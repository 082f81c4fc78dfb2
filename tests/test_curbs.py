"""Curb lines, chains, tiles and overlaps on random input, against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayside.operators import curbs

LINE = "array<struct<x: double, y: double>>"


def length(line):
    return sum(math.dist(p, q) for p, q in zip(line, line[1:], strict=False))


def at(line, d):
    d = max(0.0, min(d, length(line)))
    for p, q in zip(line, line[1:], strict=False):
        n = math.dist(p, q)
        if n and d <= n:
            return p[0] + (q[0] - p[0]) * d / n, p[1] + (q[1] - p[1]) * d / n
        d -= n
    return line[-1]


def off(p, a, b):
    """Signed distance of a point from the straight line through a and b, left is positive."""
    return ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / math.dist(a, b)


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        heading, p, line = rng.uniform(0, 6), (rng.uniform(0, 50), rng.uniform(0, 50)), []
        line.append(p)
        for _ in range(rng.randint(1, 6)):
            heading += rng.uniform(-1.2, 1.2)
            n = rng.uniform(5, 60)
            p = (p[0] + n * math.cos(heading), p[1] + n * math.sin(heading))
            line.append(p)
        a = rng.uniform(-5, length(line))
        rows.append((k, line, a, a + rng.choice([0.0, 3.0, 40.0, 500.0]), rng.uniform(-8, 8)))
    df = spark.createDataFrame(rows, f"k int, line {LINE}, a double, b double, off double")
    got = df.select("k", curbs.stretch(F.col("line"), F.col("a"), F.col("b")).alias("part"), curbs.curb_line(F.col("line"), F.col("a"), F.col("b"), F.col("off")).alias("c"), curbs.sampled(F.col("line"), F.col("off")).alias("many"))
    return rows, {r.k: r for r in got.collect()}


def test_stretches(drawn):
    for k, line, a, b, _ in drawn[0]:
        part, total = [tuple(p) for p in drawn[1][k].part], length(line)
        low, high = min(max(a, 0), total), min(max(b, 0), total)
        low, high = (low, high) if high > low else (min(low, total - 1), min(low, total - 1) + 1)
        assert part[0] == pytest.approx(at(line, low)) and part[-1] == pytest.approx(at(line, high)) and length(part) == pytest.approx(max(0, high - low), abs=1e-9)


def test_parallels(drawn):
    """Every leg of the curb is parallel to its leg of the street, at the wanted distance and side."""
    for k, _, _, _, aside in drawn[0]:
        part, curb = [tuple(p) for p in drawn[1][k].part], [tuple(p) for p in drawn[1][k].c.points]
        assert not drawn[1][k].c.fell_back
        legs = [(p, q) for p, q in zip(part, part[1:], strict=False) if math.dist(p, q) > 1e-9]
        assert len(curb) == len(legs) + 1 or len(legs) < len(part) - 1
        for (p, q), u, v in zip(legs, curb, curb[1:], strict=False):
            assert off(u, p, q) == pytest.approx(aside, abs=1e-6) and off(v, p, q) == pytest.approx(aside, abs=1e-6)


def test_samples(drawn):
    for k, line, _, _, aside in drawn[0]:
        many = [tuple(p) for p in drawn[1][k].many]
        assert len(many) == max(1, int(length(line) // curbs.STEP)) + 1 and math.dist(many[0], line[0]) == pytest.approx(abs(aside))
        for i, p in enumerate(many):
            assert math.dist(p, at(line, length(line) * i / (len(many) - 1))) == pytest.approx(abs(aside), abs=1e-6)


def test_a_line_that_turns_back_is_sampled(spark):
    back = [(0.0, 0.0), (50.0, 0.0), (0.0, 0.5)]
    r = spark.createDataFrame([(back,)], f"line {LINE}").select(curbs.curb_line(F.col("line"), F.lit(0.0), F.lit(100.0), F.lit(5.0)).alias("c")).first()
    assert r.c.fell_back and len(r.c.points) == 11


def test_chain_of_a_divided_street(spark):
    """Two carriageways going north: the west curb is the west one's, whichever way either is drawn."""
    for up_w, up_e in ((1, 1), (1, -1), (-1, -1)):
        rows = [(1, "w", 0.0, 0.0, 0.0, 9.0 * up_w, s, None, None) for s in "W"] + [(1, "e", 30.0, 0.0, 0.0, 9.0 * up_e, "W", None, None)]
        rows += [(2, "w", 0.0, 0.0, 0.0, 9.0 * up_w, "E", None, None), (2, "e", 30.0, 0.0, 0.0, 9.0 * up_e, "E", None, None)]
        rows += [(3, "w", 0.0, 0.0, 0.0, 9.0, None, 29.0, 0.0), (3, "e", 30.0, 0.0, 0.0, 9.0, None, 29.0, 0.0), (4, "x", 0.0, 0.0, 0.0, 0.0, "N", None, None)]
        df = spark.createDataFrame(rows, "r int, c string, x double, y double, dx double, dy double, side string, px double, py double")
        got = {r.r: (r.c, r.n_tied, r.note) for r in curbs.choose_chain(df, "r", "c").collect()}
        assert got == {1: ("w", 2, "side"), 2: ("e", 2, "side"), 3: ("e", 2, "place"), 4: ("x", 1, "only")}


def test_reaches_by_hand(spark):
    """Five posts of one side: single arrows stop at their family, double ones at any post where there is none of theirs."""
    posts = [("a", 1000, "f", "single", True), ("b", 3000, "f", "double", None), ("c", 4000, "g", "double", None), ("d", 5000, "f", "single", None), ("e", 5000, "h", "single", False)]
    df = spark.createDataFrame([(s, 1, "E", p, 9000, f, a, fw, s) for s, p, f, a, fw in posts], "sign string, chain int, side string, at int, length int, family string, arity string, forward boolean, rule string")
    got = {r.sign: (r.span_start, r.span_end) for r in curbs.reaches(df).collect()}
    assert got == {"a": (1000, 3000), "b": (1000, 5000), "c": (3000, 5000), "d": (0, 9000), "e": (0, 5000)}


def test_tiles_properties(spark):
    """Random posts on two chains over one segment: tiles of a curb don't overlap, and cover what the spans cover."""
    rng = random.Random(9)
    spans_of, rows = {}, []
    for _ in range(120):
        chain, side = rng.choice([1, 2, 3]), rng.choice("EW")
        a = rng.randint(0, 7000)
        b = rng.randint(a + 1, 8000)
        rows.append((chain, side, f"r{rng.randint(0, 5)}", a, b))
    found = spark.createDataFrame(rows, "chain int, side string, rules string, span_start int, span_end int")
    members = [(1, 0, 10, 5000, False), (1, 1, 11, 3000, True), (2, 0, 11, 3000, False), (2, 1, 12, 5000, False), (3, 0, 13, 8000, False)]
    segments = [(10, 5000, 0.0, 1.0, "s", ["x"]), (11, 3000, 0.0, -1.0, "s", ["x", "y"]), (12, 5000, 1.0, 0.0, "t", ["z"]), (13, 8000, 0.0, 1.0, "s", []), (14, 100, 0.0, 1.0, "s", ["q"]), (15, 100, 0.0, 1.0, "u", ["q"])]
    df = curbs.curb_tiles(
        found, spark.createDataFrame(members, "chain int, place int, segment int, seg_length int, backwards boolean"), spark.createDataFrame(segments, "segment int, seg_length int, dx double, dy double, street string, crossing array<string>"),
        spark.createDataFrame([("s", "W", ["q"]), ("u", "W", ["q", "r"])], "street string, side string, names array<string>"),
    )
    tiles = [r.asDict() for r in df.collect()]
    way = {s[0]: (s[2], s[3]) for s in segments}
    for chain, side, rule, a, b in rows:
        ahead = 0
        for c, _, seg, n, back in members:
            if c != chain:
                continue
            low, high = max(a - ahead, 0), min(b - ahead, n)
            ahead += n
            if high > low:
                dx, dy = way[seg]
                curb = "L" if (-dy if side == "E" else dy) >= 0 else "R"
                low, high = (n - high, n - low) if back else (low, high)
                for foot in range(low, high):
                    spans_of.setdefault((seg, curb), {}).setdefault(foot, set()).add(rule)
    for key in {(t["segment"], t["curb"]) for t in tiles}:
        own = sorted((t["span_start"], t["span_end"], t["rules"]) for t in tiles if (t["segment"], t["curb"]) == key)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
        feet = {f: set(rules.split("|")) for a, b, rules in own if rules for f in range(a, b)}
        assert feet == spans_of.get(key, {})
    assert len({(t["segment"], t["curb"]) for t in tiles}) == 12
    gaps = {(t["segment"], t["curb"]): t["gap"] for t in tiles if t["segment"] > 13}
    assert gaps == {(14, "L"): "unmatched", (14, "R"): "unposted", (15, "L"): "unposted", (15, "R"): "unposted"}


def test_shared_length_of_random_lines(spark):
    rng = random.Random(2)
    level = lambda: (rng.randint(0, 3) * 1.0, rng.randint(0, 300) * 1.0, rng.randint(1, 120) * 1.0)
    a, b = [(k, level()) for k in range(80)], [(k, level()) for k in range(80)]
    line = lambda y, x, n, back: [(x + n, y), (x, y)] if back else [(x, y), (x + n / 3, y), (x + n, y)]
    df = lambda rows, name, back: spark.createDataFrame([(k, line(*v, back)) for k, v in rows], f"{name} int, line {LINE}")
    got = {(r.a, r.b): r.shared for r in curbs.shared_length(df(a, "a", False), df(b, "b", True), "a", "b", "line", 25.0).collect()}
    want = {(i, j): o for i, (y, x, n) in a for j, (z, v, m) in b if y == z and (o := min(x + n, v + m) - max(x, v)) > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
