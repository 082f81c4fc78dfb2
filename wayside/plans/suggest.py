"""Suggestions over stand-in tables: part names with their types are streets, market segments of nations are places,
sizes are house numbers; the typed texts are made of the parts themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import suggest
from .search import query_kind
from .tables import query, read

_ranks = lambda trust: "CASE rank " + " ".join(f"WHEN {k} THEN {v}" for k, v in trust.items()) + " END"
_SQL = f"""pt AS (SELECT p_partkey AS k, upper(p_name || ' ' || p_type) AS s, p_size, string_split(p_name, ' ') AS w, p_name, p_type FROM part),
    streets AS (SELECT s, min(k) % 97 AS lon, min(k) % 31 AS lat FROM pt GROUP BY s),
    places AS (SELECT upper(c_mktsegment || ' NATION ' || c_nationkey) AS s, min(c_custkey) % 97 AS lon, min(c_custkey) % 31 AS lat FROM customer GROUP BY 1),
    doors AS (SELECT s, p_size AS number, p_size || ' ' || s AS label, min(k) % 97 AS lon, min(k) % 31 AS lat FROM pt GROUP BY s, p_size),
    pairs AS (SELECT x.s AS a, y.s AS b, x.k FROM pt x JOIN pt y ON y.k = x.k + 1 WHERE x.s <> y.s), both_ways AS (SELECT a, b, k FROM pairs UNION ALL SELECT b, a, k FROM pairs),
    corners AS (SELECT a, b, least(a, b) || ' & ' || greatest(a, b) AS label, min(k) % 97 AS lon, min(k) % 31 AS lat FROM both_ways GROUP BY a, b),
    typed AS (SELECT DISTINCT CASE x.k % 9 WHEN 0 THEN lower(x.s) WHEN 1 THEN x.p_name[:3] WHEN 2 THEN x.w[2] || ' ' || lower(x.p_type[:2]) WHEN 3 THEN x.p_size || ' ' || lower(x.s) WHEN 4 THEN lower(x.s) || ' & ' || coalesce(lower(y.s), 'nowhere')
        WHEN 5 THEN CAST(10000 + x.k % 30 AS VARCHAR) WHEN 6 THEN 'nation ' || x.k % 25 WHEN 7 THEN '99 ' || lower(x.s) ELSE x.p_name[:1] END AS q FROM pt x LEFT JOIN pt y ON y.k = x.k + CASE WHEN x.k % 2 = 0 THEN 1 ELSE 5 END),
    asked AS (SELECT q, upper(q) AS whole, CASE WHEN regexp_full_match(q, '\\d{{5}}') THEN 'zip' WHEN contains(q, ' & ') THEN 'corner' WHEN regexp_matches(q, '^\\d+ \\S') AND upper(q) NOT IN (SELECT s FROM streets) THEN 'address' ELSE 'street' END AS kind,
        list_filter(string_split(upper(replace(q, '&', ' ')), ' '), lambda t: t <> '') AS tokens FROM typed),
    parts AS (SELECT *, CASE kind WHEN 'corner' THEN string_split(whole, ' & ')[1] WHEN 'address' THEN substr(whole, strpos(whole, ' ') + 1) ELSE whole END AS a, CASE WHEN kind = 'corner' THEN string_split(whole, ' & ')[2] END AS b,
        CASE WHEN kind = 'address' THEN CAST(string_split(whole, ' ')[1] AS INT) END AS number FROM asked),
    met AS (SELECT q, 'corner' AS kind, label, 0.95 AS c, lon, lat FROM parts JOIN corners USING (a, b) WHERE kind = 'corner'),
    found_at AS (SELECT q, 'address' AS kind, label, 0.98 AS c, lon, lat FROM parts JOIN doors ON doors.s = a AND doors.number = parts.number WHERE kind = 'address'),
    rest AS (SELECT * FROM parts WHERE kind <> 'zip' AND q NOT IN (SELECT q FROM met UNION ALL SELECT q FROM found_at)),
    halves AS (SELECT q, s, lon, lat FROM rest JOIN streets ON s = a OR s = b WHERE kind IN ('corner', 'address')),
    named AS (SELECT 'street' AS of, * FROM streets UNION ALL SELECT 'place', * FROM places),
    idx AS (SELECT DISTINCT of, s, string_split(s, ' ')[i] AS token, i AS position FROM named, range(1, 12) r(i) WHERE i <= len(string_split(s, ' '))),
    turns AS (SELECT of, q, tokens, tokens[i] AS t, row_number() OVER (PARTITION BY of, q ORDER BY length(tokens[i]) DESC, i) AS turn FROM rest, (VALUES ('street'), ('place')) o(of), range(1, 20) r(i) WHERE i <= len(tokens) AND NOT (of = 'street' AND kind = 'address') QUALIFY turn <= 3),
    ranged AS (SELECT DISTINCT of, q, turn, s FROM (SELECT of, q, turn, s FROM turns JOIN idx USING (of) WHERE starts_with(token, t) QUALIFY row_number() OVER (PARTITION BY of, q, turn ORDER BY token, position, s) <= 200)),
    sizes AS (SELECT of, q, turn, count(s) AS n FROM turns LEFT JOIN ranged USING (of, q, turn) GROUP BY of, q, turn),
    wide AS (SELECT of, q, max(n) FILTER (turn = 1) AS n1, max(n) FILTER (turn = 2) AS n2, max(n) FILTER (turn = 3) AS n3 FROM sizes GROUP BY of, q),
    two AS (SELECT *, CASE WHEN n1 > 40 AND n2 < n1 THEN 2 ELSE 1 END AS t2, CASE WHEN n1 > 40 AND n2 < n1 THEN n2 ELSE n1 END AS m2 FROM wide),
    chosen AS (SELECT of, q, CASE WHEN m2 > 40 AND n3 < m2 THEN 3 ELSE t2 END AS turn FROM two),
    hits AS (SELECT r.of, r.q, r.s, t.tokens, string_split(r.s, ' ') AS w FROM ranged r JOIN chosen USING (of, q, turn) JOIN turns t ON t.of = r.of AND t.q = r.q AND t.turn = r.turn),
    ranked AS (SELECT of, q, s, CASE WHEN tokens = w THEN 4 WHEN len(tokens) <= len(w) AND list_bool_and(list_transform(range(1, len(tokens) + 1), lambda i: starts_with(w[i], tokens[i]))) THEN 3 WHEN list_bool_or(list_transform(tokens, lambda t: starts_with(w[1], t))) THEN 2 ELSE 1 END AS rank
        FROM hits WHERE list_bool_and(list_transform(tokens, lambda t: list_bool_or(list_transform(w, lambda x: starts_with(x, t)))))),
    by_words AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY of, q ORDER BY rank DESC, length(s), s) <= 8),
    everything AS (SELECT * FROM met UNION ALL SELECT * FROM found_at UNION ALL SELECT q, 'zip', whole, 0.25, n_nationkey, n_regionkey FROM parts JOIN nation ON a = CAST(10000 + n_nationkey AS VARCHAR) WHERE kind = 'zip'
        UNION ALL SELECT q, 'street', s, 0.30, lon, lat FROM halves UNION ALL SELECT q, 'street', s, 0.70, lon, lat FROM rest JOIN streets ON s = whole WHERE kind = 'street'
        UNION ALL SELECT q, of, s, CASE of WHEN 'street' THEN {_ranks(suggest.STREET_WORDS)} ELSE {_ranks(suggest.PLACE_WORDS)} END, lon, lat FROM by_words JOIN named USING (of, s)),
    best AS (SELECT q, kind, label, max(CAST(c AS DOUBLE)) AS confidence, arg_min((lon, lat), (-c, lon, lat)) AS spot FROM everything GROUP BY q, kind, label)"""


@query(f"WITH {_SQL} SELECT q AS typed, CAST(row_number() OVER (PARTITION BY q ORDER BY confidence DESC, length(label), label, spot[1], spot[2], kind) AS INT) AS place, kind, label, confidence, spot[1] AS lon, spot[2] AS lat FROM best QUALIFY place <= 8")
def suggest_typed(spark, d):
    """What to suggest for every text typed: whole and half streets, words in any order, addresses, corners, ZIP codes, single letters."""
    k = F.col("p_partkey")
    name = F.upper(F.concat_ws(" ", "p_name", "p_type"))
    parts = read(spark, d, "part").select(k.alias("k"), name.alias("s"), "p_size", "p_name", "p_type")
    spot = lambda of: [(F.min(of) % n).alias(c) for n, c in ((97, "lon"), (31, "lat"))]
    streets = parts.groupBy(F.col("s").alias("name")).agg(*spot("k")).withColumn("label", F.col("name"))
    place = F.upper(F.concat_ws(" ", "c_mktsegment", F.lit("NATION"), F.col("c_nationkey").cast("string")))
    places = read(spark, d, "customer").groupBy(place.alias("name")).agg(*spot("c_custkey")).withColumn("label", F.col("name"))
    doors = parts.groupBy(F.col("s").alias("street"), F.col("p_size").alias("number")).agg(*spot("k")).withColumn("label", F.concat_ws(" ", F.col("number").cast("string"), "street"))
    after = lambda n: parts.select((F.col("k") - n).alias("k"), F.col("s").alias(f"s{n}"))
    pairs = parts.join(after(1), "k").where("s <> s1").select("k", F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("s1").alias("b")), F.struct(F.col("s1").alias("a"), F.col("s").alias("b")))).alias("p"))
    corners = pairs.groupBy("p.a", "p.b").agg(*spot("k")).withColumn("label", F.concat_ws(" & ", F.least("a", "b"), F.greatest("a", "b")))
    code = F.concat(F.lit("100"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    zips = read(spark, d, "nation").select(code.alias("name"), code.alias("label"), F.col("n_nationkey").cast("long").alias("lon"), F.col("n_regionkey").cast("long").alias("lat"))
    near = parts.join(after(1), "k", "left").join(after(5), "k", "left")
    low, way, n = F.lower("s"), F.coalesce(F.lower(F.when(F.col("k") % 2 == 0, F.col("s1")).otherwise(F.col("s5"))), F.lit("nowhere")), F.col("k") % 9
    text = (
        F.when(n == 0, low).when(n == 1, F.substring("p_name", 1, 3)).when(n == 2, F.concat_ws(" ", F.get(F.split("p_name", " "), 1), F.lower(F.substring("p_type", 1, 2))))
        .when(n == 3, F.concat_ws(" ", F.col("p_size").cast("string"), low)).when(n == 4, F.concat_ws(" & ", low, way)).when(n == 5, (10000 + F.col("k") % 30).cast("string"))
        .when(n == 6, F.concat(F.lit("nation "), (F.col("k") % 25).cast("string"))).when(n == 7, F.concat(F.lit("99 "), low)).otherwise(F.substring("p_name", 1, 1))
    )
    return suggest.suggest_typed(near.select(text.alias("typed")), "typed", query_kind, streets, places, zips, doors, corners)
