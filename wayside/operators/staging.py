"""Reading and checking raw rows: points, widths, types, sink checks, keys, orders, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import common
from . import names
from .lineage import sent_if_few

#: fixed values: metres a degree of latitude, the usual width of a street and length of a car in feet
METRES_PER_DEGREE, USUAL_WIDTH, CAR_FEET = 111_132.0, 34.0, 22


def constant_violations(rows: DataFrame, column: str, expected: str) -> DataFrame:
    """value and n of the values of a column that should hold one only; no rows if it does."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(expected))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def geo_point(text: Column) -> Column:
    """struct(lon, lat) of a GeoJSON point with two finite numbers, else null."""
    p = F.from_json(text, "type string, coordinates array<string>")
    lon, lat = (F.get(p["coordinates"], i).try_cast("double") for i in (0, 1))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when((p["type"] == "Point") & finite(lon) & finite(lat), F.struct(lon.alias("lon"), lat.alias("lat")))


def line_string(text: Column) -> Column:
    """array of (x, y) of a GeoJSON line of two points or more, else null."""
    p = F.from_json(text, "type string, coordinates array<array<double>>")
    line = F.transform(p["coordinates"], lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))
    sound = F.forall(line, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    return F.when((p["type"] == "LineString") & (F.size(line) > 1) & sound, line)


def width_or_usual(width: Column) -> Column:
    """struct(width, assumed): a positive width, or the usual one with a mark."""
    good = F.coalesce(width > 0, F.lit(False))
    return F.struct(F.when(good, width.cast("double")).otherwise(USUAL_WIDTH).alias("width"), (~good).alias("assumed"))


def not_available(c: Column) -> Column:
    """Blank and N/A as null, whatever their case."""
    t = F.trim(c)
    return F.when((t != "") & (F.upper(t) != "N/A"), t)


def same_folded(c: Column, value: str) -> Column:
    return F.lower(F.trim(c)) == value.lower()


def kept_types(rows: DataFrame, column: str, kept: list) -> tuple[DataFrame, DataFrame]:
    """The rows whose type is kept, and (type, n) of those that are skipped."""
    good = F.coalesce(F.col(column).isin(kept), F.lit(False))
    return rows.where(good), rows.where(~good).groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))


def refusals(rows: DataFrame, price: Column, geometry: Column) -> DataFrame:
    """reason and n of the rows that must not be published: prices with parts of a cent or no number,
    geometry that is no line."""
    cents = price * 100
    bad_price = F.when(price.isNull() | F.isnan(price), "price is no number").when(F.abs(cents - F.round(cents)) > 1e-6, "price has parts of a cent")
    bad_line = F.when(line_string(geometry).isNull(), "geometry is no line")
    reasons = F.filter(F.array(bad_price, bad_line), lambda r: r.isNotNull())
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def refuse_unsound(rows: DataFrame, price: Column, geometry: Column) -> DataFrame:
    """rows, or an error that names the reasons."""
    found = refusals(rows, price, geometry).orderBy("reason").collect()  # two rows or three
    if found:
        raise ValueError("; ".join(f"{r['n']} rows: {r['reason']}" for r in found))
    return rows


def newest_file(files: DataFrame, name: str, year: str | None = None) -> DataFrame:
    """The last file by name; of those that name the year if any does."""
    has = F.col(name).contains(year).cast("int") if year else F.lit(0)
    return files.agg(F.max(F.struct(has.alias("h"), F.col(name).alias("n"))).alias("m")).select(F.col("m.n").alias(name))


def first_of_keys(meta: DataFrame, key: str, value: str, wanted: dict[str, list[str]]) -> DataFrame:
    """One row: for each name, the value of the first of its keys that meta has."""
    one = lambda k: F.max(F.when(F.col(key) == k, F.col(value)))
    return meta.agg(*[F.coalesce(*map(one, keys)).alias(n) for n, keys in wanted.items()])


def node_id(lon: Column, lat: Column) -> Column:
    """A place to seven decimals, as 'lon,lat'."""
    text = lambda c: F.format_string("%.7f", F.round(c, 7) + F.lit(0.0))
    return F.concat_ws(",", text(lon), text(lat))


def nodes_with_both(nodes: DataFrame, node: str, street: str, a: str, b: str) -> DataFrame:
    """The nodes where both streets meet, by one grouping."""
    hit = lambda v: F.bool_or(F.col(street) == v)
    return nodes.where(F.col(street).isin(a, b)).groupBy(node).agg(hit(a).alias("_a"), hit(b).alias("_b")).where("_a AND _b").select(node)


def chain_key(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), "+")


def name_quality(kind: Column) -> Column:
    """Trust in a name by how it was matched."""
    return F.when(kind == "exact", 1.0).when(kind == "alias", 0.95).when(kind == "edit", 0.9).when(kind == "similar", 0.8).otherwise(0.0)


def half_named(a: Column, b: Column) -> Column:
    """Exactly one of two cross streets is known."""
    return a.isNull() != b.isNull()


def side_code(c: Column) -> Column:
    """N, E, S, W of a letter in any case, else null."""
    up = F.upper(F.trim(c))
    return F.when(up.isin("N", "E", "S", "W"), up)


def shown_confidence(confidence: Column, verdict: Column, basis: Column) -> Column:
    """Null where a confidence says nothing: no data, or a verdict by absence."""
    return F.when((verdict != "no_data") & ~F.coalesce(basis == "absence", F.lit(False)), confidence)


def window_minutes(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.bround(F.timestamp_diff("SECOND", start, end) / 60).cast("int"))


def capacity(length: Column, placeholder: Column) -> Column:
    """Whole cars on a stretch; null where nothing is known of it."""
    return F.when(~placeholder, F.floor(length / CAR_FEET).cast("int"))


def placed(rows: DataFrame, groups: list[str], *order: Column) -> DataFrame:
    """rows with their place in their group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """struct(x, y): metres east and north of a place, on a flat earth about it."""
    return F.struct(((lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * METRES_PER_DEGREE).alias("y"))


def steps(line: Column) -> Column:
    """Each leg of a line (array of x, y) with the distance at which it begins and its length."""
    legs = F.transform(F.slice(line, 1, F.size(line) - 1), lambda p, i: F.struct(p.alias("p"), F.get(line, i + 1).alias("q")))
    legs = F.transform(legs, lambda g: F.struct(g["p"].alias("p"), g["q"].alias("q"), F.hypot(g["q"]["x"] - g["p"]["x"], g["q"]["y"] - g["p"]["y"]).alias("n")))
    return F.transform(legs, lambda g, i: F.struct(g["p"].alias("p"), g["q"].alias("q"), g["n"].alias("n"), F.aggregate(F.slice(legs, 1, i), F.lit(0.0), lambda a, h: a + h["n"]).alias("s")))


def point_along(legs: Column, distance: Column, aside: Column | None = None) -> Column:
    """struct(x, y) at a distance along a line given as steps(), clamped to its ends; `aside` moves it
    that far to the left of its direction there."""
    on = F.coalesce(F.try_element_at(F.filter(legs, lambda g: (g["n"] > 0) & (g["s"] <= distance)), F.lit(-1)), F.get(F.filter(legs, lambda g: g["n"] > 0), 0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distance - on["s"]) / on["n"]))
    dx, dy = on["q"]["x"] - on["p"]["x"], on["q"]["y"] - on["p"]["y"]
    off = aside if aside is not None else F.lit(0.0)
    return F.struct((on["p"]["x"] + t * dx - off * dy / on["n"]).alias("x"), (on["p"]["y"] + t * dy + off * dx / on["n"]).alias("y"))


def middle_vertex(line: Column) -> Column:
    return F.element_at(line, (F.size(line) / 2).cast("int") + 1)


def nearest_to_mean(rows: DataFrame, group: str, x: str, y: str, key: str) -> DataFrame:
    """Of each group, the row nearest the mean of its places (the smallest key on a tie)."""
    mean = rows.groupBy(group).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    away = F.round(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2), 6)
    return rows.join(mean, group).groupBy(group).agg(F.min_by(key, F.struct(away.alias("d"), key)).alias(key))


def rule_identity(texts: Column) -> Column:
    """The set of rules a post states: upper case, white space collapsed, the tail on what it supersedes off."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(texts), r"\(?SUPERSEDE.*$", ""), r"\s+", " "))
    return F.array_join(F.array_sort(F.collect_set(plain)), "|")


def gap_kind(names: Column, crossing: Column, whole: Column) -> Column:
    """Why a stretch has no rules: a face that could not be placed has its names among the crossing
    streets (or, where one name is unknown, shares one), or nothing was posted."""
    inside = F.size(F.array_except(names, crossing)) == 0
    return F.when((F.size(names) > 0) & F.when(whole, inside).otherwise(F.arrays_overlap(names, crossing)), "unmatched").otherwise("unposted")


def first_miss(rows: DataFrame, face: str, checks: list[tuple[str, Column]], classes: dict[str, str]) -> DataFrame:
    """face, n, n_missed, reason (of the first check that any row fails, in the order of checks) and its
    class; a face without a miss has neither."""
    order = F.coalesce(*[F.when(~ok, i) for i, (_, ok) in enumerate(checks)])
    sums = rows.groupBy(face).agg(F.count("*").alias("n"), F.count(order).alias("n_missed"), F.min(order).alias("_i"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("_i"))
    return sums.select(face, "n", "n_missed", pick([n for n, _ in checks]).alias("reason"), pick([classes[n] for n, _ in checks]).alias("class"))


def partition_signs(signs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """signs marked governing where their key is among keys, else other."""
    mark = keys.select(key).distinct().withColumn("_g", F.lit(True))
    return signs.join(mark, key, "left").withColumn("part", F.when(F.col("_g"), "governing").otherwise("other")).drop("_g")


def attach_siblings(links: DataFrame, posts: DataFrame, metas: DataFrame, owner: str, sign: str, post: list[str]) -> DataFrame:
    """(owner, sign): the meta signs at a post that a linked sign shares, where not linked already."""
    at = links.join(posts.select(sign, *post), sign).select(owner, *post).distinct()
    found = at.join(metas.select(F.col(sign), *post), post).select(owner, sign).distinct()
    return found.join(links.select(owner, sign), [owner, sign], "left_anti")


def emit_rules(rules: DataFrame, owner: str, parts: list[str], order: list[str]) -> DataFrame:
    """One row for each distinct rule of an owner, the first in order, with an id hashed from its parts."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (owner, *parts)])
    rows = rules.withColumn("rule_hash", F.substring(F.sha2(text, 256), 1, 16))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(owner, "rule_hash").orderBy(*order))).where("_n = 1").drop("_n")


def corners(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places where a candidate of one street (name, rank) meets one of another, best ranks first. pairs
    hold both orders, so it is two equi-joins and no product."""
    x, y = a.toDF("a", "rank_a"), b.toDF("b", "rank_b")
    return pairs.join(sent_if_few(x), "a").join(sent_if_few(y), "b").where("a <> b").withColumn("rank", F.col("rank_a") + F.col("rank_b"))


def suggestions(found: list[DataFrame], coverage: DataFrame | None = None, most: int = 8) -> DataFrame:
    """The best of candidates (kind, label, confidence, lon, lat, cell): one for each kind and label, of
    those in a covered cell, surest first, then short labels, then by label and place."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    if coverage is not None:  # before the cap, so covered places are not pushed out
        rows = rows.join(coverage.select("cell").distinct(), "cell", "left_semi")
    best = rows.groupBy("kind", "label").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "lon", "lat")).alias("b"))
    best = best.select("kind", "label", (-F.col("b.c")).alias("confidence"), "b.lon", "b.lat")
    return best.orderBy(F.desc("confidence"), F.length("label"), "label", "lon", "lat").limit(most)


def stage_doors(doors: DataFrame, displays: DataFrame, geometry: Column) -> tuple[DataFrame, DataFrame]:
    """Address points (house, suffix, street, zip) as (street_norm, number, display, zip, lon, lat), and one row with
    the number of those dropped for want of a place, a number or a street. displays (street_norm, spelling)
    holds each street once; the suffix is kept in the label only."""
    rows = doors.select("house", "suffix", "street", "zip", geo_point(geometry).alias("p"), common.leading_int(F.col("house")).alias("number"), names.fold(F.coalesce("street", F.lit(""))).alias("street_norm"))
    whole = F.col("p").isNotNull() & F.col("number").isNotNull() & (F.col("street_norm") != "")
    kept = rows.where(whole).join(displays, "street_norm", "left")
    door = F.concat(F.trim("house"), F.coalesce(F.trim("suffix"), F.lit("")))
    label = F.concat_ws(" ", door, F.coalesce(F.when(F.col("spelling") != "", F.col("spelling")), F.trim("street")))
    kept = kept.select("street_norm", "number", common.neutral_cell(label).alias("display"), common.five_digits(F.trim(F.col("zip"))).alias("zip"), "p.lon", "p.lat")
    return kept, rows.agg(F.count(F.when(~whole, 1)).alias("n"))


def stage_places(places: DataFrame, key: str, name: str, geometry: Column, streets: DataFrame, shorthand: dict = names.SHORTHAND, aliases: dict = names.PLACE_ALIASES) -> DataFrame:
    """key, display, lon, lat, spellings, kept of the places that have a name and a point. Spellings that a street (text)
    has as well are left out; a place whose own name is one, or that keeps none, is dropped (kept is false)."""
    rows = places.select(key, F.trim(name).alias("name"), geo_point(geometry).alias("p")).where("p IS NOT NULL AND name <> ''")
    each = rows.select(key, "name", "p", F.posexplode_outer(names.place_spellings(F.col("name"), shorthand, aliases)).alias("i", "text"))
    taken = streets.select("text").distinct().withColumn("_street", F.lit(True))
    each = each.join(taken, "text", "left").withColumn("_street", F.coalesce("_street", F.lit(False)))
    free = F.array_sort(F.collect_list(F.when(~F.col("_street"), F.col("text"))))
    own = F.bool_or((F.col("i") == 0) & F.col("_street"))
    found = each.groupBy(key, "name", "p").agg(free.alias("spellings"), own.alias("_own"))
    kept = (F.size("spellings") > 0) & ~F.coalesce("_own", F.lit(False))
    return found.select(key, common.neutral_cell(F.col("name")).alias("display"), "p.lon", "p.lat", "spellings", kept.alias("kept"))
