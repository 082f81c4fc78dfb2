"""From signs to curbs over stand-in tables: parts are segments, three in a row a chain; line items are signs on
them, with the texts of `texts.SIGNS`; one in eleven has lost its chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curbs, signs
from .tables import query, read
from .texts import GOLDEN, SIGNS

_RANK = {"park": 1, "stand": 2, "stop": 3}


def _reading(k: int) -> tuple[str | None, str]:
    """(what the sign's rules do, arity) by its golden rules; sign 13 only qualifies others."""
    rules = [r for r in GOLDEN if r[0] == k and r[2] and k != 13]
    bans = [r[2] for r in rules if not r[3] or r[5]]
    arity = {"both": "double", "one": "single", "none": "none"}[next(r[13] for r in GOLDEN if r[0] == k)]
    return (f"no-{max(bans, key=_RANK.get)}" if bans else "park" if rules else None), arity


_BEGINS = [("HMP" if t.split()[0].isdigit() else " ".join(t.split()[:2])) for t in SIGNS]
_TEXTS = ", ".join(f"({k}, 'r{k:02d}', '{_reading(k)[0] or _BEGINS[k]}', '{_reading(k)[1]}')" for k in range(len(SIGNS)))
_SIGNS_SQL = f"""texts(k, rule, does, arity) AS (VALUES {_TEXTS}),
    seg AS (SELECT p_partkey AS segment, p_partkey // 3 AS chain, p_partkey % 3 AS place, 10000 + p_size * 900 AS len, p_partkey % 5 = 0 AS back, p_brand AS street, p_size % 7 AS one, (p_size + 1) % 7 AS two,
            CASE p_partkey // 3 % 4 WHEN 0 THEN 0.6 WHEN 1 THEN -0.6 WHEN 2 THEN 0.8 ELSE -0.8 END AS cx, CASE WHEN p_partkey // 3 % 4 < 2 THEN 0.8 ELSE -0.6 END AS cy FROM part),
    own AS (SELECT *, CASE WHEN back THEN -cx ELSE cx END AS dx, CASE WHEN back THEN -cy ELSE cy END AS dy, coalesce(sum(len) OVER (PARTITION BY chain ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM seg),
    ch AS (SELECT chain, sum(len) AS len, any_value(cx) AS dx, any_value(cy) AS dy FROM seg GROUP BY chain),
    sg AS (SELECT l_orderkey * 10 + l_linenumber AS sign, l_partkey // 3 AS chain, CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'W' ELSE 'N' END AS side, CAST(l_quantity AS INT) * 1000 + l_suppkey % 900 AS far,
           l_orderkey % 2 = 0 AS along, l_suppkey % {len(SIGNS)} AS k, CASE WHEN l_linenumber % 2 = 1 THEN 'P' ELSE 'R' END AS code, CASE WHEN l_tax <> 0 THEN CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END END AS up, l_discount = 0.1 AS lost, l_partkey, l_orderkey FROM lineitem),
    posts AS (SELECT sign, chain, side, greatest(0, least(len, CASE WHEN along THEN far ELSE len - far END)) AS "at", len, code || '|' || does AS family, arity, CASE WHEN arity = 'single' AND up IS NOT NULL THEN dy * up >= 0 END AS forward, rule
              FROM sg JOIN ch USING (chain) JOIN texts USING (k) WHERE NOT lost),
    near AS (SELECT *, max("at") OVER (PARTITION BY chain, side, family ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb, min("at") OVER (PARTITION BY chain, side, family ORDER BY "at" RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sa,
             max("at") OVER (PARTITION BY chain, side ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ab, min("at") OVER (PARTITION BY chain, side ORDER BY "at" RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aa FROM posts),
    way AS (SELECT *, CASE WHEN forward IS NOT NULL THEN CASE WHEN forward THEN "at" ELSE coalesce(sb, 0) END WHEN arity = 'double' THEN coalesce(sb, ab, 0) ELSE 0 END AS s,
            CASE WHEN forward IS NOT NULL THEN CASE WHEN forward THEN coalesce(sa, len) ELSE "at" END WHEN arity = 'double' THEN coalesce(sa, aa, len) ELSE len END AS e FROM near),
    reach AS (SELECT sign, chain, side, rule, CAST(CASE WHEN e - s < 100 THEN 0 ELSE s END AS BIGINT) AS a, CAST(CASE WHEN e - s < 100 THEN len ELSE e END AS BIGINT) AS b FROM way)"""


def _segments(spark, d):
    key = F.col("p_partkey")
    turn = F.floor(key / 3) % 4
    cx = F.when(turn == 0, 0.6).when(turn == 1, -0.6).when(turn == 2, 0.8).otherwise(-0.8)
    cy = F.when(turn < 2, 0.8).otherwise(-0.6)
    back = F.when(key % 5 == 0, -1.0).otherwise(1.0)
    crossing = F.array(*[F.concat(F.lit("X"), ((F.col("p_size") + i) % 7).cast("string")) for i in (0, 1)])
    return read(spark, d, "part").select(
        key.alias("segment"), F.floor(key / 3).alias("chain"), (key % 3).alias("place"), (10000 + F.col("p_size") * 900).cast("long").alias("seg_length"), (key % 5 == 0).alias("backwards"),
        cx.alias("cx"), cy.alias("cy"), (cx * back).alias("dx"), (cy * back).alias("dy"), F.col("p_brand").alias("street"), crossing.alias("crossing"),
    )


def _posts(spark, d):
    texts = spark.createDataFrame([(k, t, f"r{k:02d}") for k, t in enumerate(SIGNS)], "k long, text string, rule string")
    readings = signs.sign_readings(texts, "text").join(texts, "text")
    side = F.when(F.col("l_returnflag") == "A", "E").when(F.col("l_returnflag") == "N", "W").otherwise("N")
    rows = read(spark, d, "lineitem").where("l_discount <> 0.1").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sign"), F.floor(F.col("l_partkey") / 3).alias("chain"), side.alias("side"),
        (F.col("l_quantity").cast("long") * 1000 + F.col("l_suppkey") % 900).alias("distance"), (F.col("l_orderkey") % 2 == 0).alias("along"), (F.col("l_suppkey") % len(SIGNS)).alias("k"),
        F.when(F.col("l_linenumber") % 2 == 1, "P-1").otherwise("R-2").alias("code"), F.when(F.col("l_tax") != 0, F.when(F.col("l_linestatus") == "O", " north").otherwise("S")).alias("direction"),
    )
    placed = rows.join(F.broadcast(texts.select("k", "text")), "k")  # a row per literal
    chains = _segments(spark, d).groupBy("chain").agg(F.sum("seg_length").alias("length"), F.first("cx").alias("dx"), F.first("cy").alias("dy"))
    return curbs.posts(placed, chains, F.broadcast(readings))


@query(f"WITH {_SIGNS_SQL} SELECT sign, chain, side, rule, a AS span_start, b AS span_end FROM reach")
def sign_reaches(spark, d):
    """How far every sign reaches along its chain, by its own arrow and the posts around it."""
    return curbs.reaches(_posts(spark, d)).select("sign", "chain", "side", "rule", "span_start", "span_end")


@query(f"""WITH {_SIGNS_SQL},
    stated AS (SELECT chain, side, a, b, array_to_string(list_sort(list_distinct(list(rule))), '|') AS rules FROM reach GROUP BY chain, side, a, b),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY chain, side, rules ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM stated),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY chain, side, rules ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT chain, side, rules, min(a) AS a, max(b) AS b FROM g GROUP BY chain, side, rules, island),
    lc AS (SELECT segment, CASE WHEN CASE side WHEN 'E' THEN -dy WHEN 'W' THEN dy ELSE dx END >= 0 THEN 'L' ELSE 'R' END AS curb, side, rules, len, back, greatest(a - lo, 0) AS low, least(b - lo, len) AS high FROM u JOIN own USING (chain) WHERE least(b - lo, len) > greatest(a - lo, 0)),
    pr AS (SELECT segment, curb, side, rules, CASE WHEN back THEN len - high ELSE low END AS a, CASE WHEN back THEN len - low ELSE high END AS b FROM lc),
    letters AS (SELECT segment, curb, arg_min(side, (-w, side)) AS side FROM (SELECT segment, curb, side, sum(b - a) AS w FROM pr GROUP BY ALL) GROUP BY segment, curb),
    edges AS (SELECT segment, curb, a AS t FROM pr UNION SELECT segment, curb, b FROM pr),
    atoms AS (SELECT *, lead(t) OVER (PARTITION BY segment, curb ORDER BY t) AS z FROM edges QUALIFY z IS NOT NULL),
    sets AS (SELECT segment, curb, t, z, list_sort(list_distinct(list(rules))) AS members FROM atoms JOIN pr USING (segment, curb) WHERE a <= t AND b >= z GROUP BY ALL),
    runs AS (SELECT *, CASE WHEN lag(z) OVER w = t AND lag(members) OVER w = members THEN 0 ELSE 1 END AS fresh FROM sets WINDOW w AS (PARTITION BY segment, curb ORDER BY t)),
    flat AS (SELECT segment, curb, min(t) AS a, max(z) AS b, any_value(members) AS members FROM (SELECT *, sum(fresh) OVER (PARTITION BY segment, curb ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM runs) GROUP BY segment, curb, run),
    sides AS (SELECT *, unnest(['L', 'R']) AS curb FROM own),
    bare AS (SELECT segment, curb, len, street, one, two, CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN (dx > 0) = (curb = 'L') THEN 'N' ELSE 'S' END ELSE CASE WHEN (dy > 0) = (curb = 'L') THEN 'W' ELSE 'E' END END AS side
             FROM sides WHERE (segment, curb) NOT IN (SELECT segment, curb FROM letters)),
    lost AS (SELECT DISTINCT p_brand AS street, side, sg.l_orderkey % 7 AS name FROM sg JOIN part ON p_partkey = l_partkey WHERE lost)
    SELECT segment, curb, side, CAST(a AS BIGINT) AS span_start, CAST(b AS BIGINT) AS span_end, array_to_string(list_sort(list_distinct(flatten(list_transform(members, lambda m: string_split(m, '|'))))), '|') AS rules, CAST((b - a) // 2200 AS INT) AS cars, NULL AS gap
    FROM flat JOIN letters USING (segment, curb)
    UNION ALL SELECT segment, curb, bare.side, 0, len, NULL, NULL, CASE WHEN bool_or(coalesce(name IN (one, two), false)) THEN 'unmatched' ELSE 'unposted' END FROM bare LEFT JOIN lost ON lost.street = bare.street AND lost.side = bare.side GROUP BY segment, curb, bare.side, len""")
def curb_rules(spark, d):
    """Every curb of every segment: its pieces with the rules that govern them, or why it has none."""
    segments = _segments(spark, d)
    side = F.when(F.col("l_returnflag") == "A", "E").when(F.col("l_returnflag") == "N", "W").otherwise("N")
    strays = read(spark, d, "lineitem").where("l_discount = 0.1").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lost = strays.select(F.col("p_brand").alias("street"), side.alias("side"), F.array(F.concat(F.lit("X"), (F.col("l_orderkey") % 7).cast("string"))).alias("names"))
    found = curbs.rule_spans(curbs.reaches(_posts(spark, d)))
    members = segments.select("chain", "place", "segment", "seg_length", "backwards")
    return curbs.curb_tiles(found, members, segments.select("segment", "seg_length", "dx", "dy", "street", "crossing"), lost)


@query("""WITH c AS (SELECT l_orderkey AS request, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS chain, (l_partkey % 1000)::DOUBLE AS x, (l_suppkey % 1000)::DOUBLE AS y, l_quantity - 25 AS dx, round(l_tax * 100) - 4 AS dy, ['N', 'E', 'S', 'W'][l_orderkey % 4 + 1] AS side,
      CASE WHEN l_orderkey % 3 > 0 THEN (l_orderkey % 1000)::DOUBLE END AS px, CASE WHEN l_orderkey % 3 > 0 THEN (l_orderkey % 900)::DOUBLE END AS py FROM lineitem),
    s AS (SELECT a.request, a.chain, arg_min((b.x, b.y), ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.chain)) AS o FROM c a JOIN c b ON a.request = b.request AND a.chain <> b.chain GROUP BY ALL),
    f AS (SELECT c.request, c.chain, coalesce(sqrt((c.x - px) * (c.x - px) + (c.y - py) * (c.y - py)), 0) AS off, coalesce(round(CASE WHEN sqrt(dx * dx + dy * dy) > 0 AND sqrt((o[1] - x) * (o[1] - x) + (o[2] - y) * (o[2] - y)) > 0
        THEN (-dy * (o[1] - x) + dx * (o[2] - y)) * CASE WHEN CASE side WHEN 'N' THEN dx WHEN 'S' THEN -dx WHEN 'E' THEN -dy ELSE dy END >= 0 THEN 1 ELSE -1 END / (sqrt(dx * dx + dy * dy) * sqrt((o[1] - x) * (o[1] - x) + (o[2] - y) * (o[2] - y))) ELSE 0 END, 6), 0) AS facing
        FROM c LEFT JOIN s ON s.request = c.request AND s.chain = c.chain)
    SELECT request, arg_min(chain, (facing, off, chain)) AS chain, count(*) AS n_tied, CASE WHEN count(*) = 1 THEN 'only' WHEN min(facing) < max(facing) THEN 'side' ELSE 'place' END AS note FROM f GROUP BY request""")
def chain_choice(spark, d):
    """Orders are requests, their line items equally short chains."""
    k = F.col("l_orderkey")
    said = lambda n: F.when(k % 3 > 0, (k % n).cast("double"))
    side = F.get(F.array(*map(F.lit, "NESW")), (k % 4).cast("int"))
    rows = read(spark, d, "lineitem").select(
        k.alias("request"), (F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("chain"), (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 1000).cast("double").alias("y"),
        (F.col("l_quantity") - 25).alias("dx"), (F.round(F.col("l_tax") * 100) - 4).alias("dy"), side.alias("side"), said(1000).alias("px"), said(900).alias("py"),
    )
    return curbs.choose_chain(rows, "request", "chain")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS a, l_quantity * 10 + greatest(round(l_discount * 1000), 1) AS b, (round(l_tax * 100) + 1) * CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END AS off FROM lineitem),
    p AS (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN [(a * 0.6 - off * 0.8, a * 0.8 + off * 0.6), (b * 0.6 - off * 0.8, b * 0.8 + off * 0.6)] WHEN b <= 300 THEN [(a, off), (b, off)]
      WHEN a >= 300 THEN [(300 - off, a - 300), (300 - off, b - 300)] ELSE [(a, off), (300 - off, off), (300 - off, b - 300)] END AS pts FROM l)
    SELECT l_orderkey, l_linenumber, CAST(len(pts) AS INT) AS n, round(pts[1][1], 6) AS x1, round(pts[1][2], 6) AS y1, round(pts[2][1], 6) AS x2, round(pts[2][2], 6) AS y2, round(pts[-1][1], 6) AS x3, round(pts[-1][2], 6) AS y3, false AS fell_back FROM p""")
def curb_lines(spark, d):
    """The curb of a stretch of a straight line, or of one with a bend; a stretch without length is a foot long."""
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    line = F.when(F.col("l_linenumber") % 2 == 1, F.array(point(0, 0), point(420, 560))).otherwise(F.array(point(0, 0), point(300, 0), point(300, 400)))
    start, aside = F.col("l_quantity") * 10, (F.round(F.col("l_tax") * 100) + 1) * F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
    drawn = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", curbs.curb_line(line, start, start + F.round(F.col("l_discount") * 1000), aside).alias("c"))
    at = lambda i, c: F.round(F.element_at("c.points", i)[c], 6)
    return drawn.select("l_orderkey", "l_linenumber", F.size("c.points").alias("n"), *[at(i, c).alias(f"{c}{n}") for i, n in ((1, 1), (2, 2), (-1, 3)) for c in "xy"], "c.fell_back")


@query("""WITH a AS (SELECT p_partkey, p_partkey % 50 AS y, p_size * 10 AS lo, p_size * 10 + 100 AS hi FROM part), b AS (SELECT s_suppkey, s_suppkey % 50 AS y, s_suppkey * 7 % 400 AS lo, s_suppkey * 7 % 400 + 60 AS hi FROM supplier)
    SELECT p_partkey, s_suppkey, CAST(least(a.hi, b.hi) - greatest(a.lo, b.lo) AS DOUBLE) AS shared FROM a JOIN b ON a.y = b.y AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 3""")
def line_overlaps(spark, d):
    """Parts are level lines, suppliers lines that run level backwards and then turn off; by more than 3 over each other."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b = F.col("p_size") * 10, F.col("s_suppkey") * 7 % 400
    y, v = F.col("p_partkey") % 50, F.col("s_suppkey") % 50
    lines = read(spark, d, "part").select("p_partkey", F.array(point(a, y), point(a + 40, y), point(a + 100, y)).alias("line"))
    others = read(spark, d, "supplier").select("s_suppkey", F.array(point(b + 60, v), point(b, v), point(b + 5, v + 0.5)).alias("line"))
    return curbs.shared_length(lines, others, "p_partkey", "s_suppkey", "line", 100.0).where("shared > 3")
