"""Queries of blocks between cross streets, on a grid of streets laid over parts, and of staged addresses
and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, network, staging
from .tables import query, read

#: parts are the cells of a grid 50 wide: part k is a piece of street H(k // 50), crossing V(k % 50)
_W = 50
_NODE = "(p_partkey // 50 + {dr}) || ':' || (p_partkey % 50 + {dc})"
_GRID = f"""seg AS (
      SELECT 'h' || p_partkey AS segment, 'H' || (p_partkey // 50) AS street, {_NODE.format(dr=0, dc=0)} AS a, {_NODE.format(dr=0, dc=1)} AS b, p_partkey // 50 AS r, p_partkey % 50 AS c, 100 + p_size AS length, 30 + p_size % 5 AS width, p_size % 10 = 0 AS assumed FROM part WHERE p_size >= 3
      UNION ALL SELECT 'g' || p_partkey, 'H' || (p_partkey // 50), {_NODE.format(dr=0, dc=1)}, {_NODE.format(dr=0, dc=0)}, p_partkey // 50, p_partkey % 50, 120 + p_size, 20, false FROM part WHERE p_partkey % 7 = 0
      UNION ALL SELECT 'v' || p_partkey, 'V' || (p_partkey % 50), {_NODE.format(dr=0, dc=0)}, {_NODE.format(dr=1, dc=0)}, NULL, NULL, 200, 30, false FROM part),
    nodes AS (SELECT street, a AS node FROM seg UNION SELECT street, b FROM seg)"""


def _segments(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    r, c = F.floor(k / _W), k % _W
    node = lambda dr, dc: F.concat_ws(":", r + dr, c + dc)
    point = lambda dr, dc: F.struct(((c + dc) * 100.0).alias("x"), ((r + dr) * 100.0).alias("y"))
    part = read(spark, d, "part")

    def pieces(rows, letter, street, a, b, length, width, assumed):
        return rows.select(
            F.concat(F.lit(letter), k).alias("segment"), street.alias("street"), node(*a).alias("from_node"), node(*b).alias("to_node"),
            length.alias("length"), width.alias("width"), assumed.alias("assumed"), F.array(point(*a), point(*b)).alias("line"),
        )

    along, across, no = F.concat(F.lit("H"), r), F.concat(F.lit("V"), c), F.lit(False)
    rows = pieces(part.where("p_size >= 3"), "h", along, (0, 0), (0, 1), 100 + size, 30 + size % 5, size % 10 == 0)
    rows = rows.unionByName(pieces(part.where("p_partkey % 7 = 0"), "g", along, (0, 1), (0, 0), 120 + size, F.lit(20), no))
    return rows.unionByName(pieces(part, "v", across, (0, 0), (1, 0), F.lit(200), F.lit(30), no))


def _asked(spark, d):
    """Orders ask for blocks of all streets: with the number of streets."""
    rows = read(spark, d, "part").agg((F.floor(F.max("p_partkey") / _W) + 1).alias("n_rows"))
    return read(spark, d, "orders").crossJoin(F.broadcast(rows))  # one row


@query(f"""WITH {_GRID},
    req AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE 'H' || (o_orderkey % n_rows) END AS street, CASE WHEN o_orderkey % 23 = 0 THEN 'DEAD END' WHEN o_orderkey % 19 = 0 THEN 'Y' ELSE 'V' || (o_custkey % 50) END AS f,
      CASE WHEN o_orderkey % 23 = 0 THEN 'DEAD END' WHEN o_orderkey % 19 = 0 THEN 'Z' ELSE 'V' || ((o_custkey + 1 + o_orderkey % 3) % 50) END AS t,
      o_orderkey % n_rows AS r, o_custkey % 50 AS c1, (o_custkey + 1 + o_orderkey % 3) % 50 AS c2 FROM orders, (SELECT max(p_partkey) // 50 + 1 AS n_rows FROM part)),
    link AS (SELECT r, c, count(*) AS n, min(segment) AS segment, arg_min(length, segment) AS length, arg_min(width, segment) AS width, arg_min(assumed, segment) AS assumed FROM seg WHERE r IS NOT NULL GROUP BY ALL),
    meet AS (SELECT x.street, y.street AS other, node FROM nodes x JOIN nodes y USING (node)),
    q AS (SELECT req.*, f1.node AS n1, t1.node AS n2, f IN (SELECT street FROM nodes) AND t IN (SELECT street FROM nodes) AS crossed, req.street IN (SELECT street FROM nodes) AS known
          FROM req LEFT JOIN meet f1 ON f1.street = req.street AND f1.other = f LEFT JOIN meet t1 ON t1.street = req.street AND t1.other = t),
    w AS (SELECT o_orderkey, count(*) AS k, CAST(product(n) AS BIGINT) AS n_chains, string_agg(segment, '+' ORDER BY CASE WHEN c2 > c1 THEN c ELSE -c END) AS chain_ids, CAST(sum(length) AS DOUBLE) AS length, round(sum(length * width) / sum(length), 6) AS width, bool_or(assumed) AS assumed
          FROM q JOIN link ON link.r = q.r AND c >= least(c1, c2) AND c < greatest(c1, c2) WHERE known AND crossed AND n1 IS NOT NULL AND n2 IS NOT NULL GROUP BY o_orderkey, c1, c2 HAVING count(*) = abs(c2 - c1) AND count(*) <= 30)
    SELECT o_orderkey, CASE WHEN NOT known THEN 'on_street_not_in_centerline' WHEN f = 'DEAD END' THEN 'cross_street_is_dead_end' WHEN NOT crossed THEN 'cross_street_not_in_centerline' WHEN n1 IS NULL OR n2 IS NULL THEN 'cross_street_does_not_meet_on_street'
      WHEN k IS NULL THEN 'no_chain_between_nodes' ELSE 'matched' END AS reason, n_chains, CASE WHEN k IS NOT NULL THEN n1 END AS start_node, CASE WHEN k IS NOT NULL THEN n2 END AS end_node, chain_ids, length, width, assumed FROM q LEFT JOIN w USING (o_orderkey)""")
def block_lookup(spark, d):
    """The first of the shortest chains between two named corners, or why there is none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dead, lost = k % 23 == 0, k % 19 == 0
    name = lambda number, other: F.when(dead, blocks.DEAD_END).when(lost, other).otherwise(F.concat(F.lit("V"), number % _W))
    none = F.lit(None).cast("double")
    requests = _asked(spark, d).select(
        "o_orderkey", F.when(k % 17 == 0, "X").otherwise(F.concat(F.lit("H"), k % F.col("n_rows"))).alias("on"), name(c, "Y").alias("from_name"), name(c + 1 + k % 3, "Z").alias("to_name"), none.alias("x"), none.alias("y"),
    )
    found = blocks.find_blocks(requests, "o_orderkey", _segments(spark, d)).where("chain IS NULL OR chain = 1")
    return found.select("o_orderkey", "reason", "n_chains", "start_node", "end_node", "chain_ids", "length", F.round("width", 6).alias("width"), "assumed")


@query()
def block_ends(spark, d):
    """Blocks whose other end is a dead end, or a street that is nowhere: by the published place, or by a
    far corner with a name like it. Tests compare with brute force."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    corner = F.concat(F.lit("V"), c % _W)
    other = F.when(k % 3 == 0, blocks.DEAD_END).otherwise(F.concat(F.lit("V"), c % _W + 1, F.lit("0")))
    flip, placed = k % 2 == 0, k % 5 == 0
    requests = _asked(spark, d).select(
        "o_orderkey", F.concat(F.lit("H"), k % F.col("n_rows")).alias("on"), F.when(flip, other).otherwise(corner).alias("from_name"), F.when(flip, corner).otherwise(other).alias("to_name"),
        F.when(placed, (c % _W) * 100.0 + 30).alias("x"), F.when(placed, k % F.col("n_rows") * 100.0).alias("y"),
    )
    found = blocks.find_blocks(requests, "o_orderkey", _segments(spark, d))
    return found.select("o_orderkey", "reason", "how", "start_node", "end_node", "chain_ids", "length")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 3 END AS n_points, CASE c_custkey % 4 WHEN 0 THEN 10.0 WHEN 1 THEN c_custkey % 9 + 5.0 WHEN 2 THEN 15.0 ELSE 6.0 END::DOUBLE AS length FROM customer""")
def merged_lines(spark, d):
    """Lines of parts: end to end in any direction, apart, out of order, and three that share a point."""
    p = lambda *at: F.array(*[F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in at])
    far = F.col("c_custkey") % 9
    turned = F.array(p((3, 4), (0, 0)), p((3, 4), (3, 7), (3, 9)))
    apart = F.array(p((0, 0), (3, 0)), p((100, 0), (105 + far, 0)))
    mixed = F.array(p((0, 5), (0, 0)), p((3, 9), (3, 9.0), (6, 13)), p((3, 9), (0, 5)))
    fork = F.array(p((0, 0), (4, 0)), p((0, 0), (0, 5)), p((0, 0), (-3, 0), (-6, 0)))
    case = F.col("c_custkey") % 4
    rows = read(spark, d, "customer").select("c_custkey", blocks.merge_parts(F.when(case == 0, turned).when(case == 1, apart).when(case == 2, mixed).otherwise(fork)).alias("line"))
    length = F.aggregate(F.transform(F.slice("line", 1, F.size("line") - 1), lambda a, i: F.hypot(F.get("line", i + 1)["x"] - a["x"], F.get("line", i + 1)["y"] - a["y"])), F.lit(0.0), lambda s, v: s + v)
    return rows.select("c_custkey", F.size("line").alias("n_points"), F.round(length, 6).alias("length"))


_POINT = """'{"type":"Point","coordinates":[' || (k % 90) || '.5,' || (k % 45) || ']}'"""


@query("""WITH n AS (SELECT p_partkey AS k, upper(p_name) AS w, 'The ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' High School' WHEN 1 THEN ' Public School no. ' || (p_partkey % 7) WHEN 2 THEN '' ELSE ' & Museum' END AS name FROM part WHERE p_partkey % 11 <> 0),
    s AS (SELECT k, name, w || CASE k % 4 WHEN 0 THEN ' HIGH SCHOOL' WHEN 1 THEN ' PUBLIC SCHOOL NO ' || (k % 7) WHEN 2 THEN '' ELSE ' MUSEUM' END AS own,
      CASE WHEN k % 4 = 0 THEN w || ' HS' WHEN k % 4 = 1 THEN w || ' PS NO ' || (k % 7) WHEN k % 4 = 2 AND w = 'COLD WIDGET' THEN 'WIDGET HUT' END AS other FROM n),
    taken AS (SELECT DISTINCT upper(p_name) AS text FROM part WHERE p_name LIKE '%bolt' UNION SELECT upper(p_name) || ' HS' FROM part WHERE p_name LIKE 'small%'),
    f AS (SELECT *, own IN (SELECT text FROM taken) AS own_taken, list_sort(list_filter([CASE WHEN own NOT IN (SELECT text FROM taken) THEN own END, CASE WHEN other NOT IN (SELECT text FROM taken) THEN other END], lambda x: x IS NOT NULL)) AS free FROM s)
    SELECT k, name AS display, k % 90 + 0.5::DOUBLE AS lon, CAST(k % 45 AS DOUBLE) AS lat, array_to_string(free, '|') AS spellings, len(free) > 0 AND NOT own_taken AS kept FROM f""")
def staged_places(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, " High School").when(k % 4 == 1, F.concat(F.lit(" Public School no. "), k % 7)).when(k % 4 == 2, "").otherwise(" & Museum")
    places = read(spark, d, "part").select(k.alias("k"), F.concat(F.lit("The "), "p_name", tail).alias("name"))
    name = F.upper("p_name").alias("text")
    streets = read(spark, d, "part").where("p_name LIKE '%bolt'").select(name).union(read(spark, d, "part").where("p_name LIKE 'small%'").select(F.concat(F.upper("p_name"), F.lit(" HS"))))
    found = staging.stage_places(places, "k", "name", F.expr(f"CASE WHEN k % 11 <> 0 THEN {_POINT} END"), streets, aliases={"WIDGET HUT": "COLD WIDGET"})
    return found.withColumn("spellings", F.array_join("spellings", "|"))


def _doors(spark, d):
    k = F.col("k")
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    doors = rows.select(
        "k", F.when(k % 5 == 0, "REAR").when(k % 5 == 1, F.concat(k, F.lit("-12"))).otherwise(F.concat(F.lit(" "), k)).alias("house"), F.when(k % 3 == 0, "A").alias("suffix"),
        F.when(k % 13 != 0, F.concat(F.initcap("c_mktsegment"), F.lit(" Avenue "))).alias("street"), F.when(k % 2 == 0, F.format_string("1%04d", k % 10000)).otherwise("1x").alias("zip"),
    )
    displays = spark.createDataFrame([("BUILDING AVE", "Building Ave"), ("MACHINERY AVE", "=Machinery")], "street_norm string, spelling string")
    return staging.stage_doors(doors, displays, F.expr(f"CASE WHEN k % 7 <> 0 THEN {_POINT} END"))


_DOORS = "FROM (SELECT c_custkey AS k, c_mktsegment AS m, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 13 <> 0 AS whole FROM customer)"


@query(f"""SELECT m || ' AVE' AS street_norm, CAST(k AS INT) AS number, k || CASE WHEN k % 5 = 1 THEN '-12' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'A' ELSE '' END || ' ' || CASE m WHEN 'BUILDING' THEN 'Building Ave' WHEN 'MACHINERY' THEN '=Machinery' ELSE m[1] || lower(m[2:]) || ' Avenue' END AS display,
    CASE WHEN k % 2 = 0 THEN '1' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS zip, k % 90 + 0.5::DOUBLE AS lon, CAST(k % 45 AS DOUBLE) AS lat {_DOORS} WHERE whole""")
def staged_doors(spark, d):
    return _doors(spark, d)[0]


@query(f"SELECT count(*) AS n {_DOORS} WHERE NOT whole")
def dropped_doors(spark, d):
    return _doors(spark, d)[1]


@query("""WITH g AS (SELECT c_custkey, -74.05 + (c_custkey % 200) * 0.001 AS lon, 40.6 + (c_custkey % 371) * 0.001 AS lat FROM customer),
    c AS (SELECT 6378137.0 AS a, sqrt(2 / 298.257222101 - 1 / (298.257222101 * 298.257222101)) AS e, radians(40 + 1 / 6.0) AS p0, radians(40 + 2 / 3.0) AS p1, radians(41 + 1 / 30.0) AS p2),
    m AS (SELECT *, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2, tan(pi() / 4 - p0 / 2) * pow((1 + e * sin(p0)) / (1 - e * sin(p0)), e / 2) AS t0,
      tan(pi() / 4 - p1 / 2) * pow((1 + e * sin(p1)) / (1 - e * sin(p1)), e / 2) AS t1, tan(pi() / 4 - p2 / 2) * pow((1 + e * sin(p2)) / (1 - e * sin(p2)), e / 2) AS t2 FROM c),
    k AS (SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n FROM m),
    r AS (SELECT c_custkey, a * m1 / (n * pow(t1, n)) AS af, n, t0, tan(pi() / 4 - radians(lat) / 2) * pow((1 + e * sin(radians(lat))) / (1 - e * sin(radians(lat))), e / 2) AS t, n * radians(lon + 74.0) AS theta FROM g, k)
    SELECT c_custkey, round((300000.0 + af * pow(t, n) * sin(theta)) * 3937 / 1200, 3) AS east, round((af * pow(t0, n) - af * pow(t, n) * cos(theta)) * 3937 / 1200, 3) AS north FROM r""")
def plane_points(spark, d):
    """Places in feet on the plane of the state."""
    k = F.col("c_custkey")
    x, y = network.to_plane(-74.05 + (k % 200) * 0.001, 40.6 + (k % 371) * 0.001)
    return read(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("east"), F.round(y, 3).alias("north"))
