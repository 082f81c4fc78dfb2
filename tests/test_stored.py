"""Upserts by arrival, tables that scans prune, parts of networks, suggestions' driver words, meter misses."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from wayside.operators import intervals, meters, names, network, records, suggest
from wayside.plans import stored
from wayside.sources import snapshots


@pytest.mark.parametrize("keep", ["last", "first"])
def test_upserts_one_by_one(spark, keep):
    rng = random.Random(3)
    make = lambda n, b: [(rng.choice([None, *range(20)]), f"{b}-{i}", i) for i in rng.sample(range(100), n)]
    old = [(k, "old", 0) for k in range(0, 20, 3)]
    batches = [make(30, "a"), make(1, "b"), [], make(60, "c")]
    want = {k: v for k, v, _ in old}
    for batch in batches:
        for k, v, _ in sorted(batch, key=lambda r: r[2]):
            if keep == "last" or k not in want:
                want[k] = v
    df = lambda rows: spark.createDataFrame(rows, "k int, v string, seq int")
    got = snapshots.upsert(df(old).drop("seq"), [df(b) for b in batches], ["k"], "seq", keep)
    assert got.columns == ["k", "v"] and {r.k: r.v for r in got.collect()} == want and got.count() == len(want)


def test_scan_reads_one_folder_and_few_files(spark, sf):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more rows than one file's worth
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    path = stored.stored_signs(spark, sf)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    table = spark.read.parquet(path)
    near = table.where("NOT matched AND x BETWEEN 100 AND 180")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(matched" in plan and "PushedFilters: [IsNotNull(x), GreaterThanOrEqual(x,100)" in plan
    inside = near.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("matched=false" in r.f for r in inside) and 0 < len(inside) < len([f for f in table.inputFiles() if "matched=false" in f])


def test_parts_of_a_network(spark):
    rng = random.Random(8)
    edges = [(a, b) for c in range(6) for a, b in ((c * 100 + rng.randint(0, 30), c * 100 + rng.randint(0, 30)) for _ in range(rng.choice([3, 25, 60])))]
    edges += [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000), (None, 3), (6000, 6001)]
    root = {n: n for e in edges if None not in e for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in (e for e in edges if None not in e):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a int, b int")
    assert {r.node: r.root for r in network.components(df, "a", "b").collect()} == {n: find(n) for n in root}
    rows = {r.root: r for r in network.reachability(df, "a", "b").collect()}
    assert rows[1000].nodes == 201 and rows[1000].ends == 2 and not rows[1000].isolated and sum(not r.isolated for r in rows.values()) == 1 and rows[5000].nodes == 1
    assert network.components(df.limit(0), "a", "b").count() == 0


def test_driver_words(spark):
    """The word with the fewest rows drives, bounded ranges and stops as stated."""
    rng = random.Random(6)
    vocabulary = ["aa" + c for c in "bcdefgh"] + ["ab", "zeta", "zone"]
    spelled = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    index = sorted({(w, i, s, s) for s in spelled for i, w in enumerate(s.split())})
    texts = ["aa", "a", "aab zo", "zeta aa", "zo ab aa", "aac aad aae aaf", "q", "z q"]

    def reached(word, most=15):
        rows = [(w, i, spelling) for w, i, _, spelling in index if w.startswith(word)]
        return {(spelling, spelling) for _, _, spelling in sorted(rows)[:most]}

    def by_hand(words, enough=4):
        tried = [reached(w) for w in sorted(words, key=lambda w: -len(w))[:3]]
        return functools.reduce(lambda a, b: a if len(a) <= enough or len(b) >= len(a) else b, tried)

    df = spark.createDataFrame([(t, t.split()) for t in texts], "q string, t array<string>")
    idx = names.token_index(spark.createDataFrame([(s, s) for s in spelled], "k string, s string"), "k", "s")
    got = {}
    for r in suggest.driver_rows(df, "q", "t", idx, "k", "s", most=15, enough=4).collect():
        got.setdefault(r.q, set()).add((r.k, r.s))
    assert got == {t: d for t in texts if (d := by_hand(t.split()))}


def test_face_rates(spark):
    faces = [(1, "n", "$1.50 per Hour", "1 Hour, 2 Hours", "Z", 0.0, 0.0), (2, "East", "N/A", None, "N/A", 500.0, 0.0), (3, "?", "$1.00 per Hour", None, None, None, None), (4, "S", "free", "30 Minutes", "", None, None), (5, "W", None, None, None, None, None)]
    found = [(1, 10, None, 1.0, 0.0, 0.0), (2, 10, None, 0.9, 0.0, 0.0), (3, 10, None, 1.0, 0.0, 0.0), (4, 11, None, 0.95, 0.0, 0.0), (5, None, "no street", None, None, None)]
    placed, misses = meters.face_rates(spark.createDataFrame(faces, "face int, side string, rates_text string, limit_text string, label string, x double, y double"), spark.createDataFrame(found, "face int, chain int, reason string, quality double, cx double, cy double"))
    got = {r.face: (r.chain, r.side, [str(v) for v in r.rates], r.unreadable, r.limit_min, r.label, r.confidence) for r in placed.collect()}
    assert got == {1: (10, "N", ["1.50"], False, 60, "Z", 1.0), 2: (10, "E", [], False, None, None, 0.45), 4: (11, "S", [], True, 30, None, 0.95)}
    assert {r.reason: r.n for r in misses.collect()} == {"side": 1, "no street": 1}


def test_same_effect_by_hand(spark):
    base = dict(action="park", permitted=False, vehicle="all", exclusive=False, days=127, from_min=480, to_min=1080, season_from=None, season_to=None, metered=False, limit_min=None, except_sunday=False)
    rules = [("a", {}), ("b", {"to_min": 720}), ("b", {"from_min": 720}), ("c", {"action": "stand"}), ("d", {"days": 63}), ("e", {"except_sunday": True}), ("f", {"vehicle": "truck"}), ("g", {"vehicle": "truck", "permitted": True, "exclusive": True}), ("h", {"season_from": 101, "season_to": 1231})]
    names_ = ["stack", *base]
    df = spark.createDataFrame([tuple((base | r | {"stack": s})[n] for n in names_) for s, r in rules], "stack string, action string, permitted boolean, vehicle string, exclusive boolean, days int, from_min int, to_min int, season_from int, season_to int, metered boolean, limit_min int, except_sunday boolean")
    key = {r.stack: r.effect for r in intervals.effect_keys(df, "stack").collect()}
    assert key["a"] == key["b"] == key["g"] == key["h"] and key["d"] == key["e"] and len({key[k] for k in "acdf"}) == 4


def test_raw_segments_by_hand(spark):
    line = [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 10.0)]
    rows = [(" 7 ", "Main Street", "x", " 1 ", 0.0, line), ("8", "", "2nd Avenue ", None, 12.0, line[:2]), ("", "a", "a", "1", 1.0, line), ("9", " ", None, "1", 1.0, line), ("10", "a", "a", "1", 1.0, line[:1]), ("11", "a", "a", "1", 1.0, None), (None, "a", "a", "1", 1.0, line)]
    df = spark.createDataFrame(rows, "id string, full_name string, label string, kind string, width double, line array<struct<x: double, y: double>>")
    kept, skipped = records.raw_segments(df)
    got = {r.segment: (r.name, r.street, r.kind, r.length, r.width, r.assumed, r.from_node == r.to_node) for r in kept.collect()}
    assert got == {"7": ("Main Street", "MAIN ST", "1", 11.0, 34.0, True, False), "8": ("2nd Avenue", "2ND AVE", "", 5.0, 12.0, False, False)} and skipped.first().skipped == 5


def test_clocks_and_days_as_text(spark):
    texts = {"00:00": (True, False), "23:59": (True, False), "24:00": (False, False), "7:00": (False, False), "02-31": (False, True), "13-01": (False, False), "01-00": (False, False), "aa:bb": (False, False), "": (False, False), None: (False, False)}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", records.is_clock(F.col("t")).alias("c"), records.is_month_day(F.col("t")).alias("d"))
    assert {r.t: (r.c, r.d) for r in df.collect()} == texts
