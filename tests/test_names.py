"""Names asked by short words and in any order."""

import random
from difflib import SequenceMatcher

from wayside.operators import names


def test_one_letter_queries_and_leading_by_any_token(spark):
    known = spark.createDataFrame([(1, "red steel bolt"), (2, "blue ring 5"), (3, "green r plate")], "k int, name string")
    asked = spark.createDataFrame([("r",), ("b 5",), ("bolt re",), ("5 bl",), ("",)], "q string")
    got = {(r.q, r.k): r["rank"] for r in names.best_matches(asked, known, "q", "k", "name", 8).collect()}
    assert got == {("r", 1): 3, ("r", 2): 1, ("r", 3): 1, ("b 5", 2): 2, ("bolt re", 1): 2, ("5 bl", 2): 2}


def test_closest_is_the_best_of_all_pairs(spark, sf):
    rng = random.Random(4)
    known = sorted({r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()} | {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 30))) for _ in range(150)})

    def typed(t):
        t = list(t)
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice(["", "x", "a", t[k]])
        return "".join(t)

    asked = sorted({typed(rng.choice(known)) for _ in range(200)} - {""})
    got = {r.q: (r.t, round(r.ratio, 9)) for r in names.closest(spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(k,) for k in known], "t string"), "q", "t").collect()}
    want = {}
    for q in asked:
        ratio, t = max(((SequenceMatcher(None, k, q).ratio(), k) for k in known), key=lambda v: (v[0], [-ord(c) for c in v[1]]))
        if ratio >= 0.92:
            want[q] = (t, round(ratio, 9))
    assert {q: r for q, (_, r) in got.items()} == {q: r for q, (_, r) in want.items()} and sum(got[q] == want[q] for q in want) >= len(want) - 2
