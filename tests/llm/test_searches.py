"""Phrase collocations, hard negatives and top-k search: brute force, both ways of joining, edge cases."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.llm import collocations, hard_negatives, topk_search, vectors


def phrases_by_hand(docs, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
    rows = []
    for (lang, p), a in found.items():
        if any(g == lang and len(o) > len(p) and b >= a and inside(p, o) for (g, o), b in found.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in n:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["The", "cat", "sat", "on", "Mat", "état", "ÉTAT", "a b", "x"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "!?"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    same = ("the cat sat on the mat", "en")
    return docs + [(None, None), ("", "en"), (" \t ", "fr"), (".,;", None), ("red red red red red red", "de")] + [same] * 60 + [("w " * 30_000 + "end", "long")]


COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("least", "sent", "top"), [(5, 1_000_000, 2000), (5, 0, 2000), (2, 0, 7), (40, 3, 3)])
def test_collocations(spark, texts, least, sent, top):
    df = spark.createDataFrame([(t, g, "x", 1, 2) for t, g in texts], "text string, lang string, words string, chunk long, id long").repartition(5)
    rows = collocations.collocations(df, least, top=top, sent_ids=sent)
    assert rows.columns == COLS and sorted(map(tuple, rows.collect())) == phrases_by_hand(texts, least, top=top)


def test_collocations_of_little(spark):
    df = spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")
    assert collocations.collocations(df).collect() == [] and collocations.collocations(df.limit(0)).collect() == []
    assert [tuple(r) for r in collocations.collocations(df, 1, 2).collect()] == [("en", 1, "one two", 1, 1, 1, 2, 2000)]


def test_products_beyond_64_bits(spark):
    """2 ** 63 < 1000 * a * n: the score's two products are decimals."""
    f = "cast({} AS decimal(18, 0))"
    row = spark.sql(f"SELECT ({f.format('1000 * 900000000000L')} * {f.format('70000000000000000L')}) div ({f.format('900000000001L')} * {f.format('900000000007L')}) AS s").first()
    assert row.s == 1000 * 900000000000 * 70000000000000000 // (900000000001 * 900000000007)


DIM = 6
ODD = [
    (None, [0.5] * DIM, 1), (700, None, 1), (750, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (800, [float("nan")] + [0.1] * (DIM - 1), 2), (850, [float("inf")] + [0.1] * (DIM - 1), 2),
    (900, [0.3] * DIM, None), (950, [0.25], 1), (951, [], 2), (1000, [0.5] * DIM, 1), (1000, [0.5] * DIM, 1), (1000, [0.5] * DIM, 2), (1050, [0.0] * DIM, 1), (1100, [-0.4] * DIM, 2), (None, None, None),
]


@pytest.fixture(scope="module", params=["spread", "tied", "clustered"])
def rows(request):
    rng = np.random.default_rng(3)
    n = 700
    if request.param == "spread":
        v = rng.normal(0, 0.3, (n, DIM))
    elif request.param == "tied":  # few different vectors, a third of all one and the same
        v = rng.integers(-1, 2, (n, DIM)) / 4
        v[: n // 3] = 0.25
    else:
        v = rng.normal(0, 1, (7, DIM))[rng.integers(0, 7, n)] + rng.normal(0, 0.02, (n, DIM))
    out = [(i, [float(np.float32(x)) for x in v[i]], int(rng.integers(0, 4)) if i % 3 else 1) for i in range(n)] + ODD
    return out + out[40:60] + [out[50]] * 9


def usable(rows):
    sound = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] + [0] * (DIM - len(v)), g) for i, v, g in sound]
    return out


def order(found, k):
    return sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))[:k]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.fixture(params=["one block", "many"])
def sizes(request, monkeypatch):
    if request.param == "many":
        monkeypatch.setattr(vectors, "LEAST_ROWS", 50)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 90)
        monkeypatch.setattr(vectors, "GROUP_ROWS", 7)
        monkeypatch.setattr(topk_search, "PART", 16)
        monkeypatch.setattr(hard_negatives, "LEAF", 4)
        monkeypatch.setattr(hard_negatives, "HELD", 50)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, 2, 3.0) for i, v, g in rows], "vec_id long, embedding array<float>, label int, row int, copies int, score double").repartition(3)


def nones_first(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_top_k(spark, rows, sizes):
    have = usable(rows)
    want = []
    for p, (i, v, _) in enumerate(have):
        if i is not None and i % 50 == 0:
            best = order([(j, dot(v, u)) for o, (j, u, _) in enumerate(have) if o != p], 5)
            want += [(i, r + 1, j, s) for r, (j, s) in enumerate(best)]
    got = topk_search.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert nones_first(map(tuple, got.collect())) == nones_first(want)


def test_hard_negatives(spark, rows, sizes):
    have = [r for r in usable(rows) if r[2] is not None]
    want = []
    for p, (i, v, g) in enumerate(have):
        if i is None or i % 50:
            continue
        for j, s in order([(j, dot(v, u)) for o, (j, u, h) in enumerate(have) if o != p and h == g], 5):
            inside = [(m, t) for m, u, h in have if h != g and 50 * s <= 100 * (t := dot(v, u)) <= 95 * s]
            want += [(i, j, r + 1, m, s, t) for r, (m, t) in enumerate(order(inside, 3))]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"))
    assert want and nones_first(map(tuple, got.collect())) == nones_first(want)


def test_searches_of_little(spark):
    few = frame(spark, [(0, [0.5, 0.5], 1), (1, [0.25, 0.5], 1), (2, [0.25, 0.25], 2), (3, None, None)])
    is_query = F.col("vec_id") % 50 == 0
    assert [tuple(r) for r in topk_search.top_k(few, is_query).orderBy("rank").collect()] == [(0, 1, 1, 24576), (0, 2, 2, 16384)]
    assert [tuple(r) for r in hard_negatives.hard_negatives(few, is_query, F.col("label")).collect()] == [(0, 1, 1, 2, 24576, 16384)]
    for none in (few.limit(0), few.where("vec_id > 2"), few.where("vec_id = 0")):
        assert topk_search.top_k(none, is_query).collect() == [] and hard_negatives.hard_negatives(none, is_query, F.col("label")).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_large_components(scale):
    """Bounds with slack, and final scores in whole numbers, where products pass 53 bits."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 256 * scale, (300, DIM))).astype(np.int64)
    q = x[:5]
    import pyarrow as pa

    table = lambda v: pa.table({"row": pa.array(range(len(v))), "vec_id": pa.array(range(len(v))), "copies": pa.array([1] * len(v)), "vector": pa.array(v.tolist()), "label": pa.array([i % 2 for i in range(len(v))])})
    out = topk_search.search_block(table(x), table(q))
    want = {(i, j): int(sum(int(a) * int(b) for a, b in zip(x[i], x[j], strict=True))) for i, j in product(range(5), range(300)) if i != j}
    for i in range(5):
        got = sorted((-s, j) for p, j, s in zip(out["q_row"], out["vec_id"].to_pylist(), out["score"], strict=True) if p == i)[:5]
        assert got == sorted((-s, j) for (p, j), s in want.items() if p == i)[:5]
    near = hard_negatives.search_block(table(x), table(q), True, 5)
    for i in range(5):
        got = sorted((-s, j) for p, j, s in zip(near["q_row"], near["vec_id"].to_pylist(), near["score"], strict=True) if p == i)[:5]
        assert got == sorted((-s, j) for (p, j), s in want.items() if p == i and j % 2 == i % 2)[:5]


def test_reading_stops_early():
    """In clustered data lists are not read to their end, and few rows are resolved."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(0, 1, (8, 16))[rng.integers(0, 8, 4096)] + rng.normal(0, 0.05, (4096, 16)))).astype(np.int64)
    lists, depths, read = topk_search.Lists(x), [], topk_search.Lists.read
    lists.read = lambda depth, *a: depths.append(depth) or read(lists, depth, *a)
    best = np.sort(x @ x[:32].T, axis=0)[-5].astype(float)
    query, row = lists.candidates(x[:32], best, 5, (np.zeros(0, int), np.zeros(0, int)))
    assert max(depths) < 4096 and len(query) < 0.25 * 32 * 4096
    assert {(i, j) for i, j in zip(*np.nonzero((x[:32] @ x.T) >= best[:, None]), strict=True)} <= set(zip(query.tolist(), row.tolist(), strict=True))


def test_tree_leaves_nodes_out():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(0, 1, (8, 16))[rng.integers(0, 8, 4096)] + rng.normal(0, 0.05, (4096, 16)))).astype(np.int64)
    search = hard_negatives.Search(x, np.arange(4096), np.ones(4096, np.int64), np.full(16, -1), x[:16], np.full((16, 1), -np.inf), np.full((16, 1), np.inf), 3)
    seen, walk = [], hard_negatives.Search.walk
    search.walk = lambda node, active: seen.append(len(active) * (not node.parts)) or walk(search, node, active)
    search.walk(hard_negatives.ball_tree(search.fx, np.arange(4096)), np.arange(16))
    query, _, row, _ = search.settle()
    for i in range(16):
        assert set(row[query == i]) == set(np.lexsort((np.arange(4096), -(x @ x[i])))[:3])
    assert sum(seen) < 16 * 4096 / hard_negatives.LEAF
