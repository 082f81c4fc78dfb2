"""Name, network and geometry queries over part names, lineitem edges and embeddings as plane points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import common as fn
from ..operators import names, network
from .tables import query, read

_FORMS = {"RED": "R", "BLUE": "B", "STEEL": "ST", "COPPER": "CU", "SMALL": "SM", "LARGE": "LG", "GREEN": "G", "RING": "RG", "BOLT": "BT"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FORMS.items())


@query(f"""SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(upper(p_name), '[.,]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: CASE w {_CASES} ELSE w END), ' ') AS norm FROM part""")
def name_normalize(spark, d):
    return read(spark, d, "part").select("p_partkey", names.normalize(F.col("p_name"), forms=_FORMS).alias("norm"))


@query("""SELECT DISTINCT p_name, v AS variant FROM (SELECT p_name, w, unnest([p_name, array_to_string(w[1:len(w) - 1], ' '), array_to_string(w[2:], ' ')]) AS v FROM (SELECT DISTINCT upper(p_name) || ' ST' AS p_name, string_split('W ' || upper(p_name) || ' ST', ' ') AS w FROM part)) WHERE v = p_name
    UNION SELECT n, unnest(['W ' || n || ' ST', 'W ' || n, n || ' ST', n]) FROM (SELECT DISTINCT upper(p_name) AS n FROM part)""")
def name_variants(spark, d):
    n = read(spark, d, "part").select(F.upper("p_name").alias("n")).distinct()
    with_side = n.select(F.col("n").alias("p_name"), F.explode(names.variants(F.concat(F.lit("W "), "n", F.lit(" ST")))).alias("variant"))
    return with_side.union(n.select(F.concat("n", F.lit(" ST")), F.concat("n", F.lit(" ST")))).distinct()


_INDEX = """n AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name),
    idx AS (SELECT unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1)::INT - 1 AS position, p_partkey, p_name FROM n)"""


def _names(spark, d):
    return read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query(f"WITH {_INDEX} SELECT DISTINCT token, position, p_partkey, p_name FROM idx")
def token_index(spark, d):
    return names.token_index(_names(spark, d), "p_partkey", "p_name")


@query(f"WITH {_INDEX} SELECT DISTINCT token, position, p_partkey, p_name FROM idx WHERE token >= 'b' AND token < 'c'")
def prefix_range(spark, d):
    return names.with_prefix(names.token_index(_names(spark, d), "p_partkey", "p_name"), "b")


_ASKED = ["re", "bo", "red bolt", "bolt red", "st ri", "blue", "bl wh", "gr", "zz", "ring"]
_ASK_SQL = ", ".join(f"('{a}')" for a in _ASKED)


@query(f"""WITH n AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name), q(q) AS (VALUES {_ASK_SQL}),
    m AS (SELECT q, p_partkey, p_name, string_split(q, ' ') AS t, string_split(p_name, ' ') AS w FROM q, n
          WHERE list_bool_and(list_transform(string_split(q, ' '), lambda t: list_bool_or(list_transform(string_split(p_name, ' '), lambda w: starts_with(w, t)))))),
    r AS (SELECT q, p_partkey, p_name, CASE WHEN t = w THEN 4 WHEN len(t) <= len(w) AND list_bool_and(list_transform(range(1, len(t) + 1), lambda i: starts_with(w[i], t[i]))) THEN 3 WHEN starts_with(w[1], t[1]) THEN 2 ELSE 1 END AS rank FROM m)
    SELECT q, p_partkey, p_name, rank, CAST(row_number() OVER o AS INT) AS place FROM r WINDOW o AS (PARTITION BY q ORDER BY rank DESC, length(p_name), p_name, p_partkey) QUALIFY row_number() OVER o <= 8""")
def name_match_rank(spark, d):
    asked = spark.createDataFrame([(a,) for a in _ASKED], "q string")
    return names.best_matches(asked, _names(spark, d), "q", "p_partkey", "p_name", 8, any_leads=False)  # as its SQL


_ASKED_ALL = [*_ASKED, "r", "b 5", "b", "bolt re", "r b", "p st"]


@query(f"""WITH n AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name), q(q) AS (VALUES {", ".join(f"('{a}')" for a in _ASKED_ALL)}),
    m AS (SELECT q, p_partkey, p_name, string_split(q, ' ') AS t, string_split(p_name, ' ') AS w FROM q, n
          WHERE list_bool_and(list_transform(string_split(q, ' '), lambda t: list_bool_or(list_transform(string_split(p_name, ' '), lambda w: starts_with(w, t)))))),
    r AS (SELECT q, p_partkey, p_name, CASE WHEN t = w THEN 4 WHEN len(t) <= len(w) AND list_bool_and(list_transform(range(1, len(t) + 1), lambda i: starts_with(w[i], t[i]))) THEN 3 WHEN list_bool_or(list_transform(t, lambda x: starts_with(w[1], x))) THEN 2 ELSE 1 END AS rank FROM m)
    SELECT q, p_partkey, p_name, rank, CAST(row_number() OVER o AS INT) AS place FROM r WINDOW o AS (PARTITION BY q ORDER BY rank DESC, length(p_name), p_name, p_partkey) QUALIFY row_number() OVER o <= 8""")
def name_match_whole(spark, d):
    asked = spark.createDataFrame([(a,) for a in _ASKED_ALL], "q string")
    return names.best_matches(asked, _names(spark, d), "q", "p_partkey", "p_name", 8)


_MISSPELT = ["bolx", "rig", "blu", "bluee", "stel", "steell", "greem", "whitte", "screew", "platt"]
_MISS_SQL = ", ".join(f"('{a}')" for a in _MISSPELT)
_TOKENS = "tok AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part)"


def _tokens(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()


@query(f"WITH q(word) AS (VALUES {_MISS_SQL}), {_TOKENS} SELECT word, token FROM q, tok WHERE length(word) >= 4 AND length(token) >= 3 AND levenshtein(word, token) <= 1")
def one_edit_match(spark, d):
    return names.one_edit(spark.createDataFrame([(a,) for a in _MISSPELT], "word string"), _tokens(spark, d), "word", "token")


_LOOK = ["bolt", "crimson", "bo", "greem", "nothing", "red", "ri"]
_ALIAS = {"crimson": "red", "azure": "blue"}


@query(f"""WITH q(q) AS (VALUES {', '.join(f"('{a}')" for a in _LOOK)}), {_TOKENS}, a(q, t) AS (VALUES ('crimson', 'red'), ('azure', 'blue')),
    r AS (SELECT q, token, 'exact' AS how, 1 AS r FROM q JOIN tok ON token = q UNION ALL SELECT q, token, 'alias', 2 FROM q JOIN a USING (q) JOIN tok ON token = t
          UNION ALL SELECT q, token, 'prefix', 3 FROM (SELECT q, token, row_number() OVER (PARTITION BY q ORDER BY token) AS n FROM q JOIN tok ON starts_with(token, q)) WHERE n <= 40
          UNION ALL SELECT q, token, 'one edit', 4 FROM q JOIN tok ON length(q) >= 4 AND length(token) >= 3 AND levenshtein(q, token) <= 1)
    SELECT q, token, how FROM r QUALIFY r = min(r) OVER (PARTITION BY q)""")
def resolve_cascade(spark, d):
    return names.cascade(spark.createDataFrame([(a,) for a in _LOOK], "q string"), _tokens(spark, d), "q", "token", _ALIAS)


@query()
def fuzzy_ratio(spark, d):
    asked = read(spark, d, "part").select(F.concat("p_name", F.lit("s")).alias("q")).distinct()
    return names.closest(asked, read(spark, d, "part").select("p_name").distinct(), "q", "p_name", 0.92)


_EDGES = "e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem)"


def _edges(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")).distinct()


@query(f"WITH {_EDGES}, u AS (SELECT a AS n FROM e UNION ALL SELECT b FROM e), g AS (SELECT count(*) AS degree FROM u GROUP BY n) SELECT degree, count(*) AS n_nodes FROM g GROUP BY degree")
def nodes_degree(spark, d):
    return network.degrees(_edges(spark, d), "a", "b").groupBy("degree").agg(F.count("*").alias("n_nodes"))


def _levels(most: int) -> str:
    """Breadth first in SQL, a table for each level: how many shortest chains reach its nodes."""
    seen = lambda k: " UNION ALL ".join(f"SELECT u FROM l{i}" for i in range(max(0, k - 2), k))
    steps = [f"l{k} AS MATERIALIZED (SELECT v AS u, CAST(sum(n) AS BIGINT) AS n FROM l{k - 1} JOIN s USING (u) WHERE v NOT IN ({seen(k)}) GROUP BY v)" for k in range(1, most + 1)]
    return ", ".join(["l0 AS (SELECT min(a) AS u, 1::BIGINT AS n FROM e)", *steps])


_HOPS = 30


@query(f"""WITH {_EDGES}, s AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), {_levels(_HOPS)}
    SELECT u AS node, depth, n AS n_chains FROM ({" UNION ALL ".join(f"SELECT u, {k} AS depth, n FROM l{k}" for k in range(_HOPS + 1))}) WHERE u = (SELECT max(a) FROM e)""")
def shortest_chain(spark, d):
    """From the first part to the last over all lines, parts and suppliers being the nodes."""
    edges = _edges(spark, d)
    return network.shortest_chains(edges, "a", "b", edges.agg(F.min("a")), edges.agg(F.max("a")), _HOPS)


_TREE = "t AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer)"


@query(f"""WITH RECURSIVE {_TREE}, s AS (SELECT a AS u, b AS v FROM t WHERE a <> b UNION SELECT b, a FROM t WHERE a <> b), g AS (SELECT u, count(*) AS degree, min(v) AS low, max(v) AS high FROM s GROUP BY u),
    w AS (SELECT u AS start, u AS last, low AS node, 1 AS depth FROM g WHERE degree = 1
          UNION ALL SELECT w.start, w.node, CASE WHEN g.low = w.last THEN g.high ELSE g.low END, w.depth + 1 FROM w JOIN g ON g.u = w.node WHERE g.degree = 2 AND w.depth < 31)
    SELECT start, arg_max(node, w.depth) AS node, max(w.depth) AS depth, CASE WHEN arg_max(g.degree, w.depth) = 1 THEN 'dangling' ELSE 'fork' END AS how FROM w JOIN g ON g.u = w.node GROUP BY start""")
def dead_end_walk(spark, d):
    tree = read(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 2).alias("b"))
    return network.dead_ends(tree, "a", "b", network.both_ways(tree, "a", "b").select("u").distinct())


_PTS = "p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings)"


def _points(spark, d):
    e = lambda i: F.get("embedding", i).cast("double")
    return read(spark, d, "embeddings").select("vec_id", e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("w"))


@query(f"WITH {_PTS} SELECT vec_id, round(sqrt((x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02)), 6) AS distance FROM p WHERE sqrt((x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02)) <= 0.1")
def radius_bbox(spark, d):
    return network.within_radius(_points(spark, d), "x", "y", 0.05, 0.02, 0.1).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_PTS} SELECT (SELECT count(*) > 0 FROM p WHERE sqrt(x * x + y * y) <= 0.1) AS covered, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(abs(x - z)) AS widest FROM p""")
def coverage_exists(spark, d):
    p = _points(spark, d)
    near = network.within_radius(p, "x", "y", 0.0, 0.0, 0.1).limit(1).agg((F.count("*") > 0).alias("covered"))  # one is enough
    extent = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max(F.abs(F.col("x") - F.col("z"))).alias("widest"))
    return extent.crossJoin(near)


@query(f"""WITH {_PTS}, q AS (SELECT k::INT AS probe, k / 10.0 - 0.5 AS px, 0.3 - k / 20.0 AS py FROM range(8) r(k)),
    m AS (SELECT probe, vec_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS dist FROM p, q) SELECT probe, arg_min(vec_id, (dist, vec_id)) AS vec_id, round(min(dist), 6) AS distance FROM m GROUP BY probe""")
def nearest_one(spark, d):
    probes = spark.createDataFrame([(k, k / 10.0 - 0.5, 0.3 - k / 20.0) for k in range(8)], "probe int, px double, py double")
    return network.nearest(_points(spark, d), "vec_id", "x", "y", probes, "probe", "px", "py").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_PTS}, g AS (SELECT vec_id, -74 + x / 10 AS lon, 40.7 + y / 10 AS lat FROM p)
    SELECT vec_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(40.78 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.78)) * pow(sin(radians(-73.96 - lon) / 2), 2)))), 3) AS metres FROM g""")
def haversine(spark, d):
    p = _points(spark, d).select("vec_id", (F.col("x") / 10 - 74).alias("lon"), (F.col("y") / 10 + 40.7).alias("lat"))
    return p.select("vec_id", F.round(fn.haversine(F.col("lon"), F.col("lat"), F.lit(-73.96), F.lit(40.78)), 3).alias("metres"))


def _leg(ax, ay, bx, by):
    t = f"greatest(0.0, least(1.0, ((x - ({ax})) * (({bx}) - ({ax})) + (y - ({ay})) * (({by}) - ({ay}))) / ((({bx}) - ({ax})) * (({bx}) - ({ax})) + (({by}) - ({ay})) * (({by}) - ({ay})))))"
    ex, ey = f"(x - (({ax}) + {t} * (({bx}) - ({ax}))))", f"(y - (({ay}) + {t} * (({by}) - ({ay}))))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


@query(f"WITH {_PTS} SELECT vec_id, round(least({_leg('z', 'w', 'z + 0.2', 'w + 0.1')}, {_leg('z + 0.2', 'w + 0.1', 'z + 0.1', 'w + 0.3')}), 6) AS distance FROM p")
def polyline_distance(spark, d):
    at = lambda dx, dy: F.struct((F.col("z") + dx).alias("x"), (F.col("w") + dy).alias("y"))
    line = F.array(at(0.0, 0.0), at(0.2, 0.1), at(0.1, 0.3))
    rows = _points(spark, d).withColumn("line", line)
    return rows.select("vec_id", F.round(network.polyline_distance(F.col("x"), F.col("y"), F.col("line")), 6).alias("distance"))


_RINGS = {"all": [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)], "east": [(0, -1), (1, -1), (1, 1), (0, 1), (0, -1)], "notch": [(-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (0, 0), (-0.2, 0.2), (-0.2, -0.2)]}
_AREAS = {"all": 4.0, "east": 2.0, "notch": 0.12}


def _inside(ring):
    return " + ".join(f"CASE WHEN ({y0} > y) <> ({y1} > y) AND x < ({x1} - {x0}) * (y - {y0}) / ({y1} - {y0})::DOUBLE + {x0} THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True) if y0 != y1).replace("- -", "+ ")


@query(f"WITH {_PTS} SELECT vec_id, CASE " + " ".join(f"WHEN ({_inside(_RINGS[k])}) % 2 = 1 THEN '{k}'" for k in ("notch", "east", "all")) + " END AS zone FROM p")
def point_in_polygon(spark, d):
    zones = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r], _AREAS[k]) for k, r in _RINGS.items()], "zone string, ring array<struct<x:double,y:double>>, area double")
    return network.smallest_polygon(_points(spark, d), zones, "x", "y", "vec_id", "zone", "ring", "area")


_REVERSE = """p AS (SELECT s_suppkey AS k, s_suppkey * 37 % 1000 AS x, s_suppkey * 61 % 1000 AS y FROM supplier), doors AS (SELECT c_custkey AS n, c_custkey * 17 % 1000 AS x, c_custkey * 29 % 1000 AS y FROM customer),
    corners AS (SELECT p_partkey AS n, p_partkey * 41 % 1000 AS x, p_partkey * 7 % 1000 AS y FROM part),
    found AS (SELECT k, 'door' AS kind, n, 1 AS rung, sqrt((d.x - p.x) ** 2 + (d.y - p.y) ** 2) AS distance FROM p, doors d WHERE sqrt((d.x - p.x) ** 2 + (d.y - p.y) ** 2) <= 60
        UNION ALL SELECT k, 'corner', n, 2, sqrt((d.x - p.x) ** 2 + (d.y - p.y) ** 2) FROM p, corners d WHERE sqrt((d.x - p.x) ** 2 + (d.y - p.y) ** 2) <= 250)"""


@query(f"WITH {_REVERSE} SELECT k, arg_min(kind, (rung, distance, n)) AS kind, CAST(arg_min(n, (rung, distance, n)) AS VARCHAR) AS name, arg_min(distance, (rung, distance, n)) AS distance FROM found GROUP BY k")
def reverse_places(spark, d):
    """The nearest door within 60 in widening boxes, else the nearest corner within 250."""
    xy = lambda df, c, n, a, b: df.select(F.col(c).alias(n), (F.col(c) * a % 1000).alias("x"), (F.col(c) * b % 1000).alias("y"))
    doors = xy(read(spark, d, "customer"), "c_custkey", "n", 17, 29)
    corners = xy(read(spark, d, "part"), "p_partkey", "n", 41, 7)
    return network.reverse_ladder(xy(read(spark, d, "supplier"), "s_suppkey", "k", 37, 61), "k", [("door", doors, "n", [15.0, 60.0]), ("corner", corners, "n", [60.0, 250.0])])


@query("""WITH p AS (SELECT s_suppkey AS k, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS px, CAST(s_suppkey * 61 % 1000 AS DOUBLE) AS py FROM supplier),
    l AS (SELECT p_partkey AS n, CAST(p_partkey * 41 % 1000 AS DOUBLE) AS ax, CAST(p_partkey * 7 % 1000 AS DOUBLE) AS ay, 10.0 + p_size AS dx, 20.0 * (p_size % 3) AS dy FROM part),
    t AS (SELECT *, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))::DOUBLE AS t FROM p, l),
    d AS (SELECT k, n, ax + t * dx AS x, ay + t * dy AS y, sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) AS distance FROM t)
    SELECT k, n, round(distance, 6) AS distance, round(x, 6) AS x, round(y, 6) AS y FROM d WHERE distance <= 120 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(distance, 9), n) = 1""")
def reverse_streets(spark, d):
    """The nearest street within 120 and the place on it."""
    at = lambda df, c, n, a, b: df.withColumns({n: F.col(c), "x": (F.col(c) * a % 1000).cast("double"), "y": (F.col(c) * b % 1000).cast("double")})
    probes = at(read(spark, d, "supplier"), "s_suppkey", "k", 37, 61).select("k", "x", "y")
    parts = at(read(spark, d, "part"), "p_partkey", "n", 41, 7)
    end = F.struct((F.col("x") + 10 + F.col("p_size")).alias("x"), (F.col("y") + F.col("p_size") % 3 * 20).alias("y"))
    found = network.nearest_line(parts.select("n", F.array(F.struct("x", "y"), end).alias("line")), "n", "line", probes, "k", 120.0)
    return found.select("k", "n", *[F.round(c, 6).alias(c) for c in ("distance", "x", "y")])


@query("""WITH p AS (SELECT s_suppkey AS k, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS px, CAST(s_suppkey * 61 % 1000 AS DOUBLE) AS py FROM supplier),
    pt AS (SELECT c_custkey AS n, 'door' AS kind, 1 AS rung, 15 AS r, c_custkey * 17 % 1000 AS x, c_custkey * 29 % 1000 AS y FROM customer UNION ALL SELECT p_partkey, 'corner', 2, 25, p_partkey * 41 % 1000, p_partkey * 7 % 1000 FROM part WHERE p_size % 2 = 0),
    near AS (SELECT k, kind, rung, n, sqrt((x - px) ** 2 + (y - py) ** 2) AS distance FROM p, pt WHERE sqrt((x - px) ** 2 + (y - py) ** 2) <= r QUALIFY row_number() OVER (PARTITION BY k ORDER BY rung, distance, n) = 1),
    l AS (SELECT p_partkey AS n, CAST(p_partkey * 41 % 1000 AS DOUBLE) AS ax, CAST(p_partkey * 7 % 1000 AS DOUBLE) AS ay, 10.0 + p_size AS dx, 20.0 * (p_size % 3) AS dy FROM part),
    t AS (SELECT *, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))::DOUBLE AS t FROM p, l WHERE k NOT IN (SELECT k FROM near)),
    d AS (SELECT k, n, ax + t * dx AS x, ay + t * dy AS y, sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) AS distance FROM t)
    SELECT k, kind, CAST(n AS VARCHAR) AS name, round(distance, 6) AS distance, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM near
    UNION ALL SELECT k, 'street', CAST(n AS VARCHAR), round(distance, 6), round(x, 6), round(y, 6) FROM d WHERE distance <= 120 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(distance, 9), n) = 1""")
def reverse_ladder(spark, d):
    """What a place is called, by all three rungs: a door, else a corner, else the place on the nearest street."""
    at = lambda df, c, n, a, b: df.withColumns({n: F.col(c), "x": (F.col(c) * a % 1000).cast("double"), "y": (F.col(c) * b % 1000).cast("double")})
    doors, parts = at(read(spark, d, "customer"), "c_custkey", "n", 17, 29).select("n", "x", "y"), at(read(spark, d, "part"), "p_partkey", "n", 41, 7)
    end = F.struct((F.col("x") + 10 + F.col("p_size")).alias("x"), (F.col("y") + F.col("p_size") % 3 * 20).alias("y"))
    streets = parts.select("n", F.array(F.struct("x", "y"), end).alias("line"))
    rungs = [("door", doors, "n", [5.0, 15.0]), ("corner", parts.where("p_size % 2 = 0").select("n", "x", "y"), "n", [25.0])]
    found = network.reverse_with_streets(at(read(spark, d, "supplier"), "s_suppkey", "k", 37, 61).select("k", "x", "y"), "k", rungs, streets, "n", "line", 120.0)
    return found.select("k", "kind", "name", *[F.round(c, 6).alias(c) for c in ("distance", "x", "y")])


@query("SELECT c_custkey, true AS exact FROM customer")
def lcc_roundtrip(spark, d):
    """Customers spread over a grid of degrees, to the plane and back."""
    k = F.col("c_custkey")
    grid = read(spark, d, "customer").select(k, (k % 200 * 0.001 - 74.05).alias("lon"), (F.floor(k / 200) % 200 * 0.001 + 40.68).alias("lat"))
    x, y = network.to_plane(F.col("lon"), F.col("lat"))
    lon, lat = network.to_degrees(F.col("x"), F.col("y"))
    back = grid.withColumns({"x": x, "y": y})
    return back.select("c_custkey", (F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))) < 1e-10).alias("exact"))


@query("""WITH RECURSIVE e AS (SELECT l_partkey % 5000 * 2 AS a, l_suppkey % 7 * 2000 + l_partkey % 40 * 2 + 1 AS b FROM lineitem WHERE l_quantity < 4), both_ways AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
    r AS (SELECT u AS node, u AS root FROM both_ways UNION SELECT b.v, r.root FROM r JOIN both_ways b ON b.u = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
    s AS (SELECT root, count(*) AS nodes FROM c GROUP BY root), l AS (SELECT root, count(*) AS edges FROM e JOIN c ON c.node = e.a GROUP BY root),
    d AS (SELECT root, count(*) AS ends FROM (SELECT u FROM both_ways GROUP BY u HAVING count(*) = 1) JOIN c ON c.node = u GROUP BY root)
    SELECT root, nodes, edges, coalesce(ends, 0) AS ends, root <> (SELECT arg_max(root, (nodes, -root)) FROM s) AS isolated FROM s JOIN l USING (root) LEFT JOIN d USING (root)""")
def network_parts(spark, d):
    """Connected parts of the network that small orders make of parts and suppliers, with their sizes and ends."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    edges = read(spark, d, "lineitem").where("l_quantity < 4").select((k % 5000 * 2).alias("a"), (s % 7 * 2000 + k % 40 * 2 + 1).alias("b"))
    return network.reachability(edges, "a", "b")
