"""Blocks between cross streets against a plain walk over a small random network; merged lines; spellings."""

import itertools
import math
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from wayside.operators import blocks, names

DEAD = blocks.DEAD_END
AT = {f"n{i}": (float(i * 37 % 50), float(i * 23 % 40)) for i in range(12)}


def network(seed):
    rng = random.Random(seed)
    found = []
    for i in range(26):
        a, b = rng.choice(sorted(AT)), rng.choice(sorted(AT))
        b = a if i == 3 else b  # one loop at least
        found.append((f"s{i:02d}", rng.choice(["A ST", "B ST", "C AVE", "D AVE"]), a, b, float(rng.randint(5, 9)), float(rng.randint(20, 40)), i % 5 == 0, [AT[a], AT[b]]))
    return found


def off(point, line):
    (px, py), ((ax, ay), (bx, by)) = point, line
    n = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n)) if n else 0.0
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


class Plain:
    def __init__(self, segments):
        self.by_id = {s[0]: s for s in segments}
        self.streets = {s[1] for s in segments}
        self.named = {n: {s[1] for s in segments if n in s[2:4]} for n in AT}

    def ways(self, street, node):
        for s in self.by_id.values():
            if s[1] == street and node in s[2:4]:
                yield (node, s[0], s[3] if node == s[2] else s[2])

    def corners(self, on, cross):
        return sorted(n for n in AT if {on, cross} <= self.named[n])

    def chains(self, on, starts, targets):
        """All shortest walks of links, by trying all walks of one length after the other."""
        far, level = dict.fromkeys(starts, 0), [[(None, None, n)] for n in starts]
        for depth in range(1, 31):
            level = [[*w, k] for w in level for k in self.ways(on, w[-1][2]) if far.setdefault(k[2], depth) == depth]
            hits = [w[1:] for w in level if w[-1][2] in targets]
            if hits:
                return sorted(hits, key=lambda w: (w[-1][2], w[::-1]))
        return []

    def runs(self, on, starts):
        for n in starts:
            for k in self.ways(on, n):
                walk, ok = [k], True
                while ok and len(walk) < 30:
                    onward = [j for j in self.ways(on, walk[-1][2]) if j[1] not in [w[1] for w in walk]]
                    if not onward:
                        ends = sum(walk[-1][2] in s[2:4] for s in self.by_id.values())
                        yield (ends > 1, sum(self.by_id[w[1]][4] for w in walk), [w[1] for w in walk], n, walk)
                        break
                    ok = len(onward) == 1 and onward[0][2] not in {v for w in walk for v in (w[0], w[2])}
                    walk = [*walk, onward[0]]

    def block(self, on, f, t, point):
        turn = lambda w: [(v, s, u) for u, s, v in reversed(w)]
        if on not in self.streets:
            return "on_street_not_in_centerline", None, []
        if f == t == DEAD:
            return "cross_street_is_dead_end", None, []
        if DEAD in (f, t):
            cross = t if f == DEAD else f
            if cross not in self.streets:
                return "cross_street_not_in_centerline", None, []
            if not self.corners(on, cross):
                return "cross_street_does_not_meet_on_street", None, []
            found = sorted(self.runs(on, self.corners(on, cross)))
            return ("matched", "dead end", [turn(found[0][-1]) if f == DEAD else found[0][-1]]) if found else ("cross_street_is_dead_end", None, [])
        if f not in self.streets or t not in self.streets:
            if (f in self.streets) != (t in self.streets):
                known, missing = (f, t) if f in self.streets else (t, f)
                links = [k for n in self.corners(on, known) for k in sorted(self.ways(on, n))]
                if point:
                    links = sorted(links, key=lambda k: (off(point, self.by_id[k[1]][7]), k))[:1]
                else:
                    links = [k for k in links if missing and any(SequenceMatcher(None, missing, n).ratio() >= 0.8 for n in self.named[k[2]])]
                if len(links) == 1:
                    return "matched", "inferred", [links if known == f else turn(links)]
            return "cross_street_not_in_centerline", None, []
        if not self.corners(on, f) or not self.corners(on, t):
            return "cross_street_does_not_meet_on_street", None, []
        found = self.chains(on, self.corners(on, f), self.corners(on, t))
        return ("matched", "chain", found) if found else ("no_chain_between_nodes", None, [])

    def built(self, walk):
        rows = [self.by_id[s] for _, s, _ in walk]
        line = []
        for (u, _, _), s in zip(walk, rows, strict=True):
            part = s[7] if s[2] == u else s[7][::-1]
            line += part[1:] if line else part
        length = sum(s[4] for s in rows)
        return walk[0][0], walk[-1][2], "+".join(s[0] for s in rows), length, round(sum(s[4] * s[5] for s in rows) / length, 6), any(s[6] for s in rows), tuple(line)


def test_blocks_match_a_plain_walk(spark):
    segments = network(5)
    pool = ["A ST", "B ST", "C AVE", "D AVE", "B STT", DEAD, None]
    asks = [(on, f, t) for on in ["A ST", "B ST", "C AVE", "X"] for f, t in itertools.product(pool, pool)]
    points = [None, (11.0, 13.0)]
    requests = [(i, *ask, *(p or (None, None))) for i, (ask, p) in enumerate(itertools.product(asks, points))]
    schema = "segment string, street string, from_node string, to_node string, length double, width double, assumed boolean, line array<struct<x:double,y:double>>"
    got = blocks.find_blocks(spark.createDataFrame(requests, "k int, on string, from_name string, to_name string, x double, y double"), "k", spark.createDataFrame(segments, schema))
    rows = {(r.k, r.chain, r.reason, r.how, r.n_chains, r.start_node, r.end_node, r.chain_ids, r.length, r.width and round(r.width, 6), r.assumed, r.line and tuple((p.x, p.y) for p in r.line)) for r in got.collect()}
    plain, want = Plain(segments), set()
    for i, on, f, t, x, y in requests:
        reason, how, walks = plain.block(on, f, t, (x, y) if x is not None else None)
        if not walks:
            want.add((i, None, reason, *[None] * 9))
        for c, w in enumerate(walks, 1):
            want.add((i, c, reason, how, len(walks), *plain.built(w)))
    assert {r[3] for r in want} == {None, "chain", "dead end", "inferred"} and max(r[1] or 0 for r in want) > 1
    assert rows == want


def test_no_requests_and_no_segments(spark):
    asks = "k int, on string, from_name string, to_name string, x double, y double"
    segs = "segment string, street string, from_node string, to_node string, length double, width double, assumed boolean, line array<struct<x:double,y:double>>"
    assert blocks.find_blocks(spark.createDataFrame([], asks), "k", spark.createDataFrame(network(1), segs)).count() == 0
    none = blocks.find_blocks(spark.createDataFrame([(1, "A ST", "B ST", None, None, None)], asks), "k", spark.createDataFrame([], segs)).collect()
    assert [r.reason for r in none] == ["on_street_not_in_centerline"]


def test_lines_of_parts(spark):
    cases = {
        1: [[(0, 0), (1, 0)]],
        2: [[(1, 0), (2, 0)], [(0, 0), (1, 0)]],
        3: [[(0, 0), (1, 0)], [(5, 0), (9, 0)]],
        4: [[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 0)]],  # a ring
        5: [],
    }
    rows = [(k, [[(float(x), float(y)) for x, y in p] for p in v]) for k, v in cases.items()]
    df = spark.createDataFrame(rows, "k int, parts array<array<struct<x:double,y:double>>>").select("k", blocks.merge_parts(F.col("parts")).alias("line"))
    got = {r.k: r.line and [(p.x, p.y) for p in r.line] for r in df.collect()}
    assert got[1] == [(0, 0), (1, 0)] and sorted(got[2]) == [(0, 0), (1, 0), (2, 0)] and got[3] == [(5, 0), (9, 0)] and got[5] is None
    assert len(got[4]) == 4 and got[4][0] == got[4][-1]


def test_spellings_of_places(spark):
    asked = {"The High School of Art & High School": ["HIGH SCHOOL ART HIGH SCHOOL", "HS ART HIGH SCHOOL", "HIGH SCHOOL ART HS"], "of the": [], "": [], "Grand Central Terminal": ["GRAND CENTRAL TERMINAL", "GRAND CENTRAL"], "Five Bryant": ["5 BRYANT"]}
    df = spark.createDataFrame([(a,) for a in asked], "a string").select("a", names.place_spellings(F.col("a")).alias("s"))
    assert {r.a: r.s for r in df.collect()} == asked
