"""From signs to curbs: the chain a request means, posts, spans of both kinds of arrows, tiles of segment
sides with their rules, the sides without any and why, and the line of a curb.

Distances are whole hundredths of a foot, so equality is exact. A face is one side of one chain; a curb is
one side (left or right of its own direction) of one segment, whatever chains run over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, staging
from .lineage import sent_if_few, written
from .signs import arrow_arity

CAR, STEP, SHARP = 2200, 10.0, 0.05
#: fixed values: unit vectors of compass letters
COMPASS = {"N": (0.0, 1.0), "E": (1.0, 0.0), "S": (0.0, -1.0), "W": (-1.0, 0.0)}


def _compass(letter: Column, axis: int) -> Column:
    return F.coalesce(*[F.when(letter == k, v[axis]) for k, v in COMPASS.items()])


def leftness(dx: Column, dy: Column, side: Column) -> Column:
    """1 where a compass side lies left of the direction (dx, dy) or straight along it, else -1; null for no letter."""
    dot = -dy * _compass(side, 0) + dx * _compass(side, 1)
    return F.when(dot >= 0, 1).when(dot < 0, -1)


def points_forward(letter: Column, dx: Column, dy: Column) -> Column:
    """Whether an arrow towards a compass letter points along the direction; null if either says nothing."""
    first = F.substring(F.upper(F.trim(letter)), 1, 1)
    return F.when((dx != 0) | (dy != 0), dx * _compass(first, 0) + dy * _compass(first, 1) >= 0)


def choose_chain(chains: DataFrame, request: str, chain: str) -> DataFrame:
    """request, chain, n_tied, note: of a request's equally short chains, the one whose named curb faces away from
    the parallel carriageway.

    chains have x, y (their middle), dx, dy (from their first to their last point), side (a compass letter)
    and px, py (where the sign is said to be, or null). The nearest other middle is a chain's sibling; the
    chain whose way to the named side points most away from its sibling is meant. Where that doesn't
    separate, the nearest to (px, py) is, then the first. note says which: only, side or place.
    """
    c = chains.select(request, chain, "x", "y", "dx", "dy", "side", "px", "py")
    other = c.select(request, F.col(chain).alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    pairs = c.join(other, request, "left").where(F.col("_o") != F.col(chain))  # tied chains are few, see find_blocks
    away = F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2)
    sibling = pairs.groupBy(request, chain).agg(F.min(F.struct(away.alias("d"), F.col("_o").alias("o"), F.col("_x").alias("x"), F.col("_y").alias("y"))).alias("s"))
    rows = c.join(sibling, [request, chain], "left")
    far = lambda x, y: F.sqrt(x * x + y * y)
    run, gap = far(F.col("dx"), F.col("dy")), far(F.col("s.x") - F.col("x"), F.col("s.y") - F.col("y"))
    toward = (-F.col("dy") * (F.col("s.x") - F.col("x")) + F.col("dx") * (F.col("s.y") - F.col("y"))) * leftness(F.col("dx"), F.col("dy"), F.col("side"))
    facing = F.round(F.when((run > 0) & (gap > 0), toward / (run * gap)).otherwise(0.0), 6)
    off = F.coalesce(far(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0))
    rows = rows.withColumns({"_f": F.coalesce(facing, F.lit(0.0)), "_d": off})
    best = rows.groupBy(request).agg(F.min(F.struct("_f", "_d", chain)).alias("b"), F.max("_f").alias("_most"), F.count("*").alias("n_tied"))
    note = F.when(F.col("n_tied") == 1, "only").when(F.col("b._f") < F.col("_most"), "side").otherwise("place")
    return best.select(request, f"b.{chain}", "n_tied", note.alias("note"))


def posts(signs: DataFrame, chains: DataFrame, readings: DataFrame) -> DataFrame:
    """Posts of placed signs: sign, chain, side, at, length, family, arity, forward, rule.

    signs have sign, chain, side, distance, along (whether measured in the chain's own direction), text, code
    and direction (a compass word); chains have chain, length, dx, dy; readings are of sign_readings (text,
    panel, family_action, arity) with the id of the text's rules (rule). Panels make no post. A distance is
    clamped to the chain and turned to its direction; a family is the code before its dash and what the text
    does, or how it begins where that can't be read.
    """
    rows = signs.join(readings.where("panel IS NULL"), "text").join(chains, "chain")
    at = F.greatest(F.lit(0), F.least(F.col("length"), F.when(F.col("along"), F.col("distance")).otherwise(F.col("length") - F.col("distance"))))
    words = F.split(F.upper(F.trim("text")), r"\s+")
    begins = F.when(F.upper(F.trim("text")).rlike(r"^\d+ (?:HMP|HOUR|HR)\b"), "HMP").otherwise(F.array_join(F.slice(words, 1, 2), " "))
    family = F.concat_ws("|", F.coalesce(F.nullif(F.trim(F.substring_index("code", "-", 1)), F.lit("")), F.lit("UNKNOWN")), F.coalesce("family_action", begins))
    drawn = arrow_arity(F.upper(F.coalesce("text", F.lit(""))))
    arity = F.coalesce("arity", F.when(drawn == "both", "double").when(drawn == "one", "single").otherwise("none"))
    forward = F.when(arity == "single", points_forward(F.col("direction"), F.col("dx"), F.col("dy")))
    return rows.select("sign", "chain", "side", at.alias("at"), "length", family.alias("family"), arity.alias("arity"), forward.alias("forward"), "rule")


def reaches(posted: DataFrame) -> DataFrame:
    """posts with span_start and span_end: a single arrow reaches to the next post of its family that way, a double one
    to the next of its family or else of any, each way; a post without either, or without a readable
    direction, and one whose span has no length, covers its whole side. Both kinds in one pass over a face."""
    rows = spans.neighbours(posted, ["chain", "side"], "family", "at")
    single, double = (F.col("arity") == "single") & F.col("forward").isNotNull(), F.col("arity") == "double"
    before, after = F.coalesce("same_before", "any_before", F.lit(0)), F.coalesce("same_after", "any_after", "length")
    start = F.when(single, F.when(F.col("forward"), F.col("at")).otherwise(F.coalesce("same_before", F.lit(0)))).when(double, before).otherwise(0)
    end = F.when(single, F.when(F.col("forward"), F.coalesce("same_after", "length")).otherwise(F.col("at"))).when(double, after).otherwise(F.col("length"))
    rows = rows.withColumns({"_s": start, "_e": end})
    whole = F.col("_e") - F.col("_s") < 100
    return rows.select("sign", "chain", "side", "rule", "length", F.when(whole, 0).otherwise(F.col("_s")).alias("span_start"), F.when(whole, F.col("length")).otherwise(F.col("_e")).alias("span_end"))


def rule_spans(reached: DataFrame) -> DataFrame:
    """chain, side, rules, span_start, span_end: posts of one span state their rules together, and spans of the same
    rules that overlap or touch are one, since a repeated sign gives notice of one rule."""
    stated = reached.groupBy("chain", "side", "span_start", "span_end").agg(F.array_join(F.array_sort(F.collect_set("rule")), "|").alias("rules"))  # as many as texts differ
    return spans.union_touching(stated, ["chain", "side", "rules"]).drop("n")


def curb_tiles(found: DataFrame, members: DataFrame, segments: DataFrame, lost: DataFrame) -> DataFrame:
    """segment, curb (L or R), side, span_start, span_end, rules, cars, gap: every curb of every segment, cut wherever
    a rule begins or ends.

    found are rule_spans; members have chain, place, segment, seg_length and backwards; segments have segment,
    seg_length, dx, dy, street and crossing (the streets it meets). lost are faces that have signs but no chain:
    street, side and names of the cross streets. A curb takes the letter that covers most of it. A curb that
    nothing covers gives one row without rules and cars, and gap: unmatched where a lost face is there, else
    unposted; its letter is the one that lies on it (of E and W, else N and S).
    """
    local = spans.project(found, members, "chain", "place", "seg_length", F.col("backwards"))
    shape = segments.select("segment", "dx", "dy")
    local = local.join(shape, "segment").withColumn("curb", F.when(leftness(F.col("dx"), F.col("dy"), F.col("side")) > 0, "L").otherwise("R"))
    local = written(local.select("segment", "curb", "side", "rules", F.col("local_start").alias("span_start"), F.col("local_end").alias("span_end")))
    face = ["segment", "curb"]
    sets = spans.flatten(local.select(*face, "rules", "span_start", "span_end"), face, "rules")
    weighed = local.groupBy(*face, "side").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("w"))
    letters = weighed.groupBy(*face).agg(F.min_by("side", F.struct(-F.col("w"), "side")).alias("side"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("members", lambda m: F.split(m, r"\|")))))
    tiles = sets.join(letters, face).select(*face, "side", "span_start", "span_end", F.array_join(ids, "|").alias("rules"), F.floor((F.col("span_end") - F.col("span_start")) / CAR).cast("int").alias("cars"), F.lit(None).cast("string").alias("gap"))
    flat = F.abs(F.col("dx")) > F.abs(F.col("dy"))  # a street that runs east has curbs north and south
    left = F.when(flat, F.when(F.col("dx") > 0, "N").otherwise("S")).otherwise(F.when(F.col("dy") > 0, "W").otherwise("E"))
    right = F.when(flat, F.when(F.col("dx") > 0, "S").otherwise("N")).otherwise(F.when(F.col("dy") > 0, "E").otherwise("W"))
    every = segments.withColumn("_c", F.explode(F.array(F.struct(F.lit("L").alias("curb"), left.alias("side")), F.struct(F.lit("R").alias("curb"), right.alias("side")))))
    bare = every.select("segment", "seg_length", "street", "crossing", "_c.curb", "_c.side").join(letters.select(*face), face, "left_anti")
    known = lost.select("street", "side", "names").distinct()
    inside = (F.size("names") > 0) & (F.size(F.array_except("names", "crossing")) == 0)
    gaps = bare.join(known, ["street", "side"], "left").groupBy(*face, "side", "seg_length").agg(F.bool_or(F.coalesce(inside, F.lit(False))).alias("_lost"))
    none = F.lit(None).cast("string")
    empty = gaps.select(*face, "side", F.lit(0).alias("span_start"), F.col("seg_length").alias("span_end"), none.alias("rules"), F.lit(None).cast("int").alias("cars"), F.when(F.col("_lost"), "unmatched").otherwise("unposted").alias("gap"))
    return tiles.unionByName(empty)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once and named, not written out at each place of use."""
    return F.get(F.transform(F.array(value), use), 0)


def _xy(p: Column) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"))


def stretch(line: Column, start: Column, end: Column, least: float = 1.0) -> Column:
    """The part of a line (array of struct<x, y>) between two distances; one without length runs `least` ahead."""

    def cut(legs: Column) -> Column:
        last = F.element_at(legs, -1)
        total = last["s"] + last["n"]
        low, high = (F.greatest(F.least(v, total), F.lit(0.0)) for v in (start, end))
        ahead = F.greatest(F.least(low, total - least), F.lit(0.0))
        ends = F.when(high > low, F.struct(low.alias("a"), high.alias("b"))).otherwise(F.struct(ahead.alias("a"), F.least(ahead + least, total).alias("b")))
        inner = lambda r: F.transform(F.filter(legs, lambda g: (g["s"] > r["a"]) & (g["s"] < r["b"]) & (g["n"] > 0)), lambda g: _xy(g["p"]))
        return bound(ends, lambda r: F.concat(F.array(staging.point_along(legs, r["a"])), inner(r), F.array(staging.point_along(legs, r["b"]))))

    return bound(line, lambda v: bound(staging.steps(v), cut))


def parallel(line: Column, aside: Column) -> Column:
    """The line `aside` to the left (right if negative): every corner on the bisector of its two legs, so the legs stay
    parallel. null where a corner turns back so sharply that it would run away."""

    def corner(normal: Column, g: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(normal, i - 1)).otherwise(g)
        sharp = 1 + before["x"] * g["x"] + before["y"] * g["y"]
        return F.when(sharp > SHARP, F.struct((g["p"]["x"] + aside * (before["x"] + g["x"]) / sharp).alias("x"), (g["p"]["y"] + aside * (before["y"] + g["y"]) / sharp).alias("y")))

    def drawn(normal: Column) -> Column:
        last = F.element_at(normal, -1)
        end = F.struct((last["q"]["x"] + aside * last["x"]).alias("x"), (last["q"]["y"] + aside * last["y"]).alias("y"))
        return F.when(F.size(normal) > 0, F.concat(F.transform(normal, lambda g, i: corner(normal, g, i)), F.array(end)))

    across = lambda g: F.struct((-(g["q"]["y"] - g["p"]["y"]) / g["n"]).alias("x"), ((g["q"]["x"] - g["p"]["x"]) / g["n"]).alias("y"), _xy(g["p"]).alias("p"), _xy(g["q"]).alias("q"))
    points = bound(line, lambda v: bound(F.transform(F.filter(staging.steps(v), lambda g: g["n"] > 0), across), drawn))
    return bound(points, lambda v: F.when(~F.exists(v, lambda p: p.isNull()), v))


def sampled(line: Column, aside: Column, step: float = STEP) -> Column:
    """The line `aside` to the left, by points every `step` or so, each moved along the normal there."""

    def walk(legs: Column) -> Column:
        last = F.element_at(legs, -1)
        total = last["s"] + last["n"]
        n = F.greatest(F.floor(total / step), F.lit(1)).cast("int")
        return bound(F.struct(total.alias("t"), n.alias("n")), lambda r: F.transform(F.sequence(F.lit(0), r["n"]), lambda i: staging.point_along(legs, r["t"] * i / r["n"], aside)))

    return bound(line, lambda v: bound(staging.steps(v), walk))


def curb_line(line: Column, start: Column, end: Column, aside: Column) -> Column:
    """struct(points, fell_back): the curb between two distances of a line; sampled where no parallel can be drawn."""
    both = lambda part: F.struct(part.alias("part"), parallel(part, aside).alias("drawn"))
    pick = lambda r: F.struct(F.coalesce(r["drawn"], sampled(r["part"], aside)).alias("points"), r["drawn"].isNull().alias("fell_back"))
    return bound(bound(stretch(line, start, end), both), pick)


def shared_length(lines: DataFrame, others: DataFrame, key: str, other: str, line: str, cell: float, near: float = 1e-9) -> DataFrame:
    """key, other, shared: how far two lines run over each other: legs that lie on one straight line, to within near,
    as far as their stretches of it overlap. Legs meet in the cells their boxes touch, a pair in its first common
    one; legs of one line are taken not to overlap each other. Equal lines are measured once, and what is found is
    then said of each of them: a pair of keys costs a row of the result and no more, unless a key has several lines."""
    def shapes(df: DataFrame, name: str, mark: str) -> tuple[DataFrame, DataFrame, bool]:
        drawn = written(df.select(line).where(F.col(line).isNotNull()).distinct().withColumn(mark, F.monotonically_increasing_id()))
        held = written(df.select(name, line).join(drawn, line).select(name, mark))
        return drawn, held, held.groupBy(name).count().where("count > 1").isEmpty()

    def legs(df: DataFrame, name: str, mark: str) -> DataFrame:
        g = df.select(F.col(name), F.explode(staging.steps(F.col(line))).alias("g")).where("g.n > 0")
        box = {f"{m}{c}": f(F.col("g.p")[c], F.col("g.q")[c]) for c in "xy" for m, f in (("lo_", F.least), ("hi_", F.greatest))}
        g = g.select(name, *[F.col(f"g.{e}.{c}").alias(f"{mark}{e}{c}") for e in "pq" for c in "xy"], F.col("g.n").alias(f"{mark}n"), *[v.alias(f"{mark}{k}") for k, v in box.items()])
        span = lambda c: F.sequence(F.floor((F.col(f"{mark}lo_{c}") - near) / cell), F.floor((F.col(f"{mark}hi_{c}") + near) / cell))
        return g.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))

    (drawn, held, one), (drawn_too, held_too, one_too) = shapes(lines, key, "_a"), shapes(others, other, "_b")
    pairs = legs(drawn, "_a", "a").join(legs(drawn_too, "_b", "b"), ["_cx", "_cy"])
    first = lambda c: F.floor((F.greatest(F.col(f"alo_{c}"), F.col(f"blo_{c}")) - near) / cell)
    pairs = pairs.where((F.col("_cx") == first("x")) & (F.col("_cy") == first("y")))
    ux, uy = (F.col("aqx") - F.col("apx")) / F.col("an"), (F.col("aqy") - F.col("apy")) / F.col("an")
    off = lambda e: F.abs((F.col(f"b{e}x") - F.col("apx")) * uy - (F.col(f"b{e}y") - F.col("apy")) * ux)
    on = lambda e: (F.col(f"b{e}x") - F.col("apx")) * ux + (F.col(f"b{e}y") - F.col("apy")) * uy
    shared = F.least(F.greatest(on("p"), on("q")), F.col("an")) - F.greatest(F.least(on("p"), on("q")), F.lit(0.0))
    found = written(pairs.where((off("p") <= near) & (off("q") <= near) & (shared > 0)).groupBy("_a", "_b").agg(F.sum(shared).alias("shared")))
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows here can make many, so not left to their size
    rows = found.join(held, "_a").repartition(tasks, key, "_b").join(sent_if_few(held_too), "_b").select(key, other, "shared")
    return rows if one and one_too else rows.groupBy(key, other).agg(F.sum("shared").alias("shared"))
