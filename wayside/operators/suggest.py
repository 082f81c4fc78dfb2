"""Suggestions for many typed texts at once: what was typed decides which rungs run, and later rungs only run for texts
that the earlier ones found nothing for.

A text's words find names through one driver word: of its three longest, the one that matched the fewest rows of the
index; the search stops at the first with few enough. Each is one bounded range of the index, in its order of
(token, position), so a text of common letters costs no more than SCANS times MOST rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import names
from .lineage import written

#: fixed values: words tried, rows of each, rows that are few enough
SCANS, MOST, ENOUGH = 3, 200, 40
#: fixed values: trust in a suggestion by what it is; by rank of a word match (4 whole ... 1 inner)
TRUST = {"door": 0.98, "corner": 0.95, "street": 0.70, "half": 0.30, "zip": 0.25}
STREET_WORDS = {4: 0.70, 3: 0.69, 2: 0.68, 1: 0.67}
PLACE_WORDS = {4: 0.85, 3: 0.66, 2: 0.65, 1: 0.64}


def driver_rows(typed: DataFrame, q: str, tokens: str, index: DataFrame, key: str, spelling: str, scans: int = SCANS, most: int = MOST, enough: int = ENOUGH) -> DataFrame:
    """q, tokens, key, spelling: the rows of the index (token, position, key, spelling) under each text's driver word. Words
    and index meet by their first two letters, or by a word's only one; of each range only the first rows are kept."""
    longest = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    turns = typed.select(q, tokens, F.posexplode(F.slice(longest, 1, scans)).alias("turn", "_w")).withColumn("_t", F.col("_w.t")).withColumn("_p", F.substring("_t", 1, 2))
    held = index.withColumn("_p", F.explode(F.array_distinct(F.array(F.substring("token", 1, 1), F.substring("token", 1, 2)))))
    w = Window.partitionBy(q, "turn").orderBy("token", "position", spelling, key)
    rows = turns.join(held, "_p").where(F.startswith("token", "_t")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    rows = written(rows.groupBy(q, "turn", key, spelling).agg(F.count("*").alias("_n")))
    counts = rows.groupBy(q, "turn").agg(F.count("*").alias("n"))
    counts = turns.select(q, "turn").join(counts, [q, "turn"], "left").groupBy(q).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("n", F.lit(0)).alias("n")))).alias("_c"))  # three at most
    better = lambda s, c: F.when((s["n"] <= enough) | (c["n"] >= s["n"]), s).otherwise(c)
    pick = F.aggregate(F.slice("_c", 2, scans), F.get("_c", 0), better)
    chosen = counts.select(q, pick["turn"].alias("turn"))
    return rows.join(chosen, [q, "turn"]).join(typed.select(q, tokens), q).select(q, tokens, key, spelling)


def word_matches(typed: DataFrame, q: str, tokens: str, index: DataFrame, key: str, spelling: str, most: int) -> DataFrame:
    """q, key, spelling, rank: names every typed word begins a word of, the best spelling of each, the first `most` by
    (rank, length, text)."""
    rows = driver_rows(typed, q, tokens, index, key, spelling).withColumn("rank", names.match_rank(F.col(tokens), F.split(spelling, " "))).where("rank IS NOT NULL")
    best = rows.groupBy(q, key).agg(F.min_by(F.struct(spelling, "rank"), F.struct(-F.col("rank"), spelling)).alias("_b")).select(q, key, f"_b.{spelling}", "_b.rank")
    order = Window.partitionBy(q).orderBy(F.desc("rank"), F.length(spelling), spelling, key)
    return best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def suggest_typed(typed: DataFrame, q: str, kind_of, streets: DataFrame, places: DataFrame, zips: DataFrame, doors: DataFrame, corners: DataFrame, most: int = 8) -> DataFrame:
    """q, place, kind, label, confidence, lon, lat: the best suggestions of each typed text.

    kind_of makes struct(kind, a, b, number) of a text (zip, corner, address, street). streets and places have name
    (folded), label, lon, lat; zips have name; doors street, number; corners a, b (both orders); all with label, lon,
    lat. A ZIP code is looked up; a corner that exists is the answer, else its two streets and the words; a house number
    that is there is the answer, else its street and places; but a whole text that is a street is that street.
    """
    read = typed.select(q).distinct().withColumn("_q", kind_of(F.col(q))).where("_q IS NOT NULL")
    asked = read.select(q, "_q.*", names.fold(F.col(q)).alias("whole")).withColumn("tokens", names.name_words(F.col("whole")))
    named = asked.join(streets.select(F.col("name").alias("whole")).distinct().withColumn("_s", F.lit(True)), "whole", "left")
    named = named.withColumn("kind", F.when(F.col("_s") & (F.col("kind") == "address"), "street").otherwise(F.col("kind"))).drop("_s")
    named = written(named)  # read by every rung
    out = lambda rows, kind, trust: rows.select(q, F.lit(kind).alias("kind"), "label", trust.cast("double").alias("confidence"), "lon", "lat")
    sure = lambda k: F.lit(TRUST[k])

    by_zip = out(named.where("kind = 'zip'").join(zips, F.col("a") == F.col("name")), "zip", sure("zip"))
    met = out(named.where("kind = 'corner'").select(q, "a", "b").join(corners, ["a", "b"]), "corner", sure("corner"))
    at = out(named.where("kind = 'address'").select(q, F.col("a").alias("street"), "number").join(doors, ["street", "number"]), "address", sure("door"))
    met, at = written(met), written(at)
    left = written(named.where("kind <> 'zip'").join(met.unionByName(at).select(q).distinct(), q, "left_anti"))  # the first rungs found nothing
    halves = left.where("kind IN ('corner', 'address')").select(q, F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("name"))
    half = out(halves.join(streets, "name"), "street", sure("half"))
    whole = out(left.where("kind = 'street'").select(q, F.col("whole").alias("name")).join(streets, "name"), "street", sure("street"))

    def by_words(rows: DataFrame, table: DataFrame, kind: str, trust: dict[int, float]) -> DataFrame:
        index = names.token_index(table.select("name", F.col("name").alias("spelling")), "name", "spelling")
        hits = word_matches(rows.where(F.size("tokens") > 0).select(q, "tokens"), q, "tokens", index, "name", "spelling", most)
        return out(hits.join(table, "name"), kind, F.element_at(F.create_map(*[F.lit(x) for pair in trust.items() for x in pair]), F.col("rank")))

    words = by_words(left.where("kind <> 'address'"), streets, "street", STREET_WORDS).unionByName(by_words(left, places, "place", PLACE_WORDS))
    found = by_zip.unionByName(met).unionByName(at).unionByName(half).unionByName(whole).unionByName(words)
    best = found.groupBy(q, "kind", "label").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "lon", "lat")).alias("_b"))
    rows = best.select(q, "kind", "label", (-F.col("_b.c")).alias("confidence"), "_b.lon", "_b.lat")
    order = Window.partitionBy(q).orderBy(F.desc("confidence"), F.length("label"), "label", "lon", "lat", "kind")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
