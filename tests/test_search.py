"""The ranked list of a search on a few rows."""

import random

from wayside.plans.search import rank_results


def scored(spark, rows):
    schema = "k int, verdict string, why string, basis string, price decimal(12,2), risk decimal(12,2), walk double, score double"
    return spark.createDataFrame([(k, v, b or v, b, None, None, float(k), s) for k, v, b, s in rows], schema)


def test_posted_comes_before_absence_and_the_cap_is_last(spark):
    rows = [(k, "legal", "absence", 1 + k / 100) for k in range(10)] + [(20, "legal", "posted", 1.45), (21, "legal", "posted", 1.4), (22, "legal", "posted", 1.6)]
    rows += [(30, "illegal", None, 0.1), (31, "ambiguous", None, 9.0), (32, "no_data", None, 0.0)]
    got = sorted((r for r in rank_results(scored(spark, rows), "k", 3, 2).collect()), key=lambda r: (r.part, r.place))
    assert [(r.part, r.place, r.band, r.k) for r in got] == [("legal", 1, 0, 21), ("legal", 2, 0, 20), ("legal", 3, 0, 0), ("other", 1, None, 31), ("other", 2, None, 30)]
    assert {(r.n_legal, r.n_illegal, r.n_ambiguous, r.n_no_data, r.n_total) for r in got} == {(13, 1, 1, 1, 16)}


def test_bands_up_to_the_cap_are_those_of_all_rows(spark):
    rng = random.Random(4)
    rows = [(k, "legal", rng.choice(["posted", "absence"]), round(rng.random() * 6, 1)) for k in range(300)]
    band, anchor, want = -1, None, []
    for k, _, basis, s in sorted(rows, key=lambda r: (r[3], r[0])):
        if anchor is None or s - anchor > 0.5:
            band, anchor = band + 1, s
        want.append((band, basis != "posted", s, k))
    got = sorted(rank_results(scored(spark, rows), "k", 70, 5).collect(), key=lambda r: r.place)
    assert [(r.band, r.k) for r in got] == [(w[0], w[3]) for w in sorted(want)[:70]]
