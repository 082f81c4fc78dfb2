"""How many links of the threshold similarity the count of coordinates may lose."""

import math
import random

import pytest

from wayside.llm import near_dedup


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_two_links_in_a_million_at_most(percent):
    m, p, n = near_dedup.matches_for(percent), percent / 100, near_dedup.COORDINATES
    lost = lambda k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))
    assert lost(m) <= 2e-6 < lost(m + 1)


def test_a_list_with_few_strangers_costs_a_row_a_member(spark):
    """20,000 near copies and one stranger under one value."""
    n = 20_000
    reps = spark.range(n + 1).withColumnRenamed("id", "rep")
    classes = reps.selectExpr("rep", "array_repeat(cast(7 AS int), 48) AS sig", "200L AS n_shingles")
    posted = reps.selectExpr("cast(shiftleft(3L, 32) | 7L AS long) AS key", "rep", "rep AS common")
    roots = reps.where(f"rep > 0 AND rep < {n - 1}").selectExpr("rep AS node", "0L AS root")
    rows = near_dedup.block_rows(posted, classes, roots, 1024).cache()
    assert n <= rows.count() <= n + n // 512 and rows.where("stranger").select("rep").distinct().count() == 1
    assert max(r["count"] for r in rows.groupBy("key", "i", "j").count().collect()) < 3 * 1024


def test_a_list_of_strangers_costs_a_few_rows_a_member(spark):
    """16,000 classes under one value, each a component of its own, two and two under another value."""
    n = 16_000
    reps = spark.range(n).withColumnRenamed("id", "rep")
    classes = reps.selectExpr("rep", "array_repeat(cast(7 AS int), 48) AS sig", "200L AS n_shingles")
    common = reps.selectExpr("cast(shiftleft(3L, 32) | 7L AS long) AS key", "rep", "rep AS common")
    posted = common.unionByName(reps.selectExpr("cast(shiftleft(5L, 32) | (rep div 2) AS long) AS key", "rep", "rep AS common"))
    rows = near_dedup.block_rows(posted, classes, spark.createDataFrame([], "node long, root long"), 1024).cache()
    assert rows.count() <= 2 * n and max(r["count"] for r in rows.groupBy("key", "second", "i", "j").count().collect()) == 2
    pairs = {tuple(sorted(r.reps)) for r in rows.groupBy("key", "second", "i", "j").agg({"rep": "collect_list"}).toDF("key", "second", "i", "j", "reps").collect()}
    assert pairs == {(a, a + 1) for a in range(0, n - 2, 2)}  # the last two hold the list's leader, compared before


def test_any_block_size_finds_the_same_links(spark, monkeypatch):
    """Texts that share most of a long preamble, so lists are full of strangers, some of them alike."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    preamble, rows = rng.sample(words, 90), []
    for _ in range(40):
        own = rng.sample(words, rng.choice([30, 60]))
        for _ in range(rng.choice([1, 1, 2, 3])):
            t = preamble + own
            for _ in range(rng.randrange(0, 4)):
                t = [*t]
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for block in (1, 4, 1024):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {i: find(i) for i in sets}
