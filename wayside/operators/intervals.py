"""Time windows cut at rule boundaries, and rule stacks resolved most restrictive first.

A window is (key, start, end), wall clocks of one zone without offset. A rule belongs to a stack and
has: rule_id, ordinal, action (park, stand, stop), permitted, vehicle (all, passenger or another),
exclusive, days (mask, Monday bit 0), from_min, to_min, season_from, season_to (month * 100 + day),
metered, limit_min, cleaning, school, except_sunday, including_sunday, snow, holiday_exempt, meta,
readable, confidence. Every "first wins" goes by ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import common as fn
from .lineage import sent_if_few

ZONE = "America/New_York"
#: fixed values: the severity of actions
RANKS = {"park": 1, "stand": 2, "stop": 3}
SURE = 0.8


def instant(wall: Column, zone: str = ZONE) -> Column:
    """Epoch seconds of a wall clock; a skipped hour counts forward, a repeated one is the first."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)


def cut_windows(windows: DataFrame, minutes: Column, zone: str | None = ZONE, key: str | None = None) -> DataFrame:
    """A row per piece of each window: its columns, with piece_start, piece_end and minutes (elapsed).

    With key, the windows, one narrow row each, are dealt by it first: pieces then stay with their key,
    and neither resolving nor reducing them shuffles again while the rules are few enough to be sent.

    minutes is an array column of minutes of the day; midnight always cuts. The cut is made inside a
    row, without a shuffle. zone None takes the day as 1440 minutes throughout.
    """
    if key:  # a stated number, as rows that grow by an explode shouldn't be coalesced by their size before it
        windows = windows.repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    days = F.sequence(F.to_date("start"), F.to_date("end"))
    at = F.array_union(F.array(F.lit(0), F.lit(1440)), F.filter(F.coalesce(minutes, F.array().cast("array<int>")), lambda m: m.isNotNull()))
    walls = F.flatten(F.transform(days, lambda d: F.transform(at, lambda m: d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), m))))
    inside = F.filter(walls, lambda t: (t > F.col("start")) & (t < F.col("end")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), inside)))
    cut = windows.where(F.col("end") > F.col("start")).withColumn("_edges", edges)
    pairs = F.transform(F.slice("_edges", 1, F.size("_edges") - 1), lambda t, i: F.struct(t.alias("s"), F.get(F.col("_edges"), i + 1).alias("e")))
    rows = cut.withColumn("_p", F.explode(pairs)).withColumns({"piece_start": F.col("_p.s"), "piece_end": F.col("_p.e")}).drop("_p", "_edges")
    seconds = F.timestamp_diff("SECOND", F.col("piece_start"), F.col("piece_end")) if zone is None else instant(F.col("piece_end"), zone) - instant(F.col("piece_start"), zone)
    return rows.withColumn("minutes", F.floor(seconds / 60).cast("int"))


def applies(permitted: Column, vehicle: Column, exclusive: Column) -> Column:
    """What a rule says to a passenger car: its own flag if it is about it, false if it reserves the
    place for others, null if it says nothing."""
    return F.when(vehicle.isin("all", "passenger"), permitted).when(exclusive, False)


def calendar_allows(r, c) -> Column:
    """r, c: functions of a column name, for a rule and for its day's calendar row."""
    no = F.lit(False)
    return ~((r("cleaning") & F.coalesce(c("suspended"), no)) | (r("holiday_exempt") & F.coalesce(c("major"), no)) | r("snow") | (r("school") & F.coalesce(c("no_school"), no)))


def is_active(start: Column, r, c) -> Column:
    day, minute = F.weekday(start), F.hour(start) * 60 + F.minute(start)
    return (
        fn.has_day(r("days"), day)
        & ~(r("except_sunday") & (day == 6))
        & fn.in_season(F.month(start) * 100 + F.day(start), r("season_from"), r("season_to"))
        & fn.in_clock_range(minute, r("from_min"), r("to_min"))
        & calendar_allows(r, c)
    )


def is_charged(start: Column, r, c) -> Column:
    """Metered, and meters run: not on Sundays unless the rule says so, nor on suspended or major days."""
    no = F.lit(False)
    runs = ~(F.coalesce(c("meters_off"), no) | F.coalesce(c("major"), no))
    return r("metered") & (r("including_sunday") | ((F.weekday(start) != 6) & runs))


def resolve(pieces: DataFrame, rules: DataFrame, calendar: DataFrame, key: str, stack: str) -> DataFrame:
    """One outcome per piece: permitted, prohibited by, charged, limit, by_absence.

    pieces have key, stack, piece_start, piece_end, minutes. rules have the same stack column; a stack
    is small. A piece without an active rule is permitted by absence.
    """
    rank = F.lit(0)
    for action, n in RANKS.items():
        rank = F.when(F.col("action") == action, n).otherwise(rank)
    days = calendar.select(F.col("date").alias("_date"), *[F.col(c).alias(f"_{c}") for c in ("suspended", "meters_off", "major", "no_school")])
    rows = pieces.join(sent_if_few(rules), stack, "left").join(F.broadcast(days), F.to_date("piece_start") == F.col("_date"), "left")  # one row a day of a calendar
    r, c = F.col, lambda name: F.col(f"_{name}")
    start = F.col("piece_start")
    on = F.coalesce(is_active(start, r, c), F.lit(False)) & r("rule_id").isNotNull()
    says = applies(r("permitted"), r("vehicle"), r("exclusive"))
    rows = rows.withColumns({"_no": on & (says == False), "_yes": on & (says == True) & (r("action") == "park"), "_rank": rank, "_charged": on & is_charged(start, r, c)})  # noqa: E712
    no, yes = F.coalesce("_no", F.lit(False)), F.coalesce("_yes", F.lit(False))
    first = -F.col("ordinal")
    out = rows.groupBy(key, stack, "piece_start", "piece_end", "minutes").agg(
        F.bool_or(no).alias("prohibited"),
        F.max_by(F.when(no, F.col("rule_id")), F.when(no, F.struct("_rank", first))).alias("prohibited_by"),
        F.bool_or(yes).alias("posted"),
        F.min(F.when(yes, F.col("limit_min"))).alias("limit_min"),
        F.min_by(F.when(yes, F.col("rule_id")), F.when(yes, F.struct(F.coalesce("limit_min", F.lit(1 << 30)).alias("l"), "ordinal"))).alias("permitted_by"),
        F.bool_or(yes & F.coalesce("_charged", F.lit(False))).alias("charged"),
    )
    free = ~F.col("prohibited")
    return out.select(
        key, stack, "piece_start", "piece_end", "minutes", free.alias("permitted"),
        F.when(free, F.col("permitted_by")).otherwise(F.col("prohibited_by")).alias("deciding"),
        (free & ~F.col("posted")).alias("by_absence"), (free & F.col("charged")).alias("charged"),
        F.when(free, F.col("limit_min")).alias("limit_min"),
    )


def verdicts(outcomes: DataFrame, rules: DataFrame, key: str, stack: str) -> DataFrame:
    """One row per key: verdict (no_data, ambiguous, illegal, legal), why, basis, minutes, charged
    minutes. Unreadable, meta and unsure rules poison a stack before anything else is decided."""
    stacks = rules.groupBy(stack).agg(
        F.bool_or(~F.col("readable")).alias("_unread"), F.bool_or("meta").alias("_meta"),
        F.bool_or(F.col("confidence") < SURE).alias("_unsure"), F.min("confidence").alias("confidence"),
    )
    limited = F.col("limit_min").isNotNull()
    spans = outcomes.groupBy(key, stack).agg(
        F.every("permitted").alias("_free"), F.every("by_absence").alias("_absent"),
        F.min(F.when(~F.col("permitted"), F.col("piece_start"))).alias("_first"),
        F.min_by(F.when(~F.col("permitted"), F.col("deciding")), F.when(~F.col("permitted"), F.col("piece_start"))).alias("_by"),
        F.min("limit_min").alias("_limit"), F.sum(F.when(limited, F.col("minutes")).otherwise(0)).alias("_in_limit"),
        F.sum("minutes").alias("minutes"), F.sum(F.when(F.col("charged"), F.col("minutes")).otherwise(0)).alias("charged_minutes"),
    )
    rows = spans.join(sent_if_few(stacks), stack, "left")
    why = (
        F.when(F.col("_unread").isNull(), "nothing posted").when(F.col("_unread"), "unreadable").when(F.col("_meta"), "meta").when(F.col("_unsure"), "unsure")
        .when(~F.col("_free"), F.concat(F.lit("prohibited by "), F.col("_by"), F.date_format("_first", " HH:mm")))
        .when(F.col("_limit") < F.col("_in_limit"), "over the limit").when(F.col("_absent"), "absence").otherwise("posted")
    )
    verdict = (
        F.when(F.col("why") == "nothing posted", "no_data").when(F.col("why").isin("unreadable", "meta", "unsure"), "ambiguous")
        .when(F.col("why").startswith("prohibited") | (F.col("why") == "over the limit"), "illegal").otherwise("legal")
    )
    rows = rows.withColumn("why", why).withColumn("verdict", verdict)
    basis = F.when(F.col("verdict") == "legal", F.col("why"))
    return rows.select(key, stack, "verdict", "why", basis.alias("basis"), "minutes", "charged_minutes", "confidence")


def coverage(pieces: DataFrame, rules: DataFrame, calendar: DataFrame, key: str, stack: str) -> DataFrame:
    """For each key and rule: active minutes of the window and whether that is none, part or all;
    null for rules that cannot be read."""
    days = calendar.select(F.col("date").alias("_date"), *[F.col(c).alias(f"_{c}") for c in ("suspended", "meters_off", "major", "no_school")])
    rows = pieces.join(sent_if_few(rules), stack).join(F.broadcast(days), F.to_date("piece_start") == F.col("_date"), "left")
    on = is_active(F.col("piece_start"), F.col, lambda name: F.col(f"_{name}"))
    sums = rows.groupBy(key, "rule_id", "readable").agg(F.sum("minutes").alias("total"), F.sum(F.when(on, F.col("minutes")).otherwise(0)).alias("active_minutes"))
    part = F.when(~F.col("readable"), None).when(F.col("active_minutes") == 0, "none").when(F.col("active_minutes") == F.col("total"), "all").otherwise("part")
    return sums.select(key, "rule_id", "active_minutes", part.alias("coverage"))


def caveats(pieces: DataFrame, rules: DataFrame, calendar: DataFrame, key: str, stack: str) -> DataFrame:
    """key and caveats, in a fixed order: no calendar, a snow rule, a school rule that is active in the
    window, cleaning suspended on a day of it, meters off in a part of it, nothing posted in all or in
    part of it. A key without pieces gives no row."""
    days = calendar.select(F.col("date").alias("_date"), *[F.col(c).alias(f"_{c}") for c in ("suspended", "meters_off", "major", "no_school")])
    known = calendar.agg((F.count("*") > 0).alias("_known"))
    rows = pieces.join(sent_if_few(rules), stack, "left").join(F.broadcast(days), F.to_date("piece_start") == F.col("_date"), "left")  # one row a day of a calendar
    r, c = F.col, lambda name: F.col(f"_{name}")
    start, no = F.col("piece_start"), F.lit(False)
    on = F.coalesce(is_active(start, r, c), no) & r("rule_id").isNotNull()
    says = applies(r("permitted"), r("vehicle"), r("exclusive"))
    yes = on & F.coalesce(says, no) & (r("action") == "park")
    each = rows.groupBy(key, "piece_start").agg(
        F.bool_or(F.coalesce(on & (says == False), no)).alias("no"), F.bool_or(F.coalesce(yes, no)).alias("yes"),  # noqa: E712
        F.bool_or(F.coalesce(yes & r("metered"), no)).alias("metered"), F.bool_or(F.coalesce(yes & is_charged(start, r, c), no)).alias("charged"),
        F.bool_or(F.coalesce(r("snow"), no)).alias("snow"), F.bool_or(F.coalesce(on & r("school"), no)).alias("school"),
        F.bool_or(F.coalesce(r("cleaning"), no)).alias("cleaning"), F.bool_or(F.coalesce(c("suspended"), no)).alias("suspended"),
    )
    free = ~F.col("no")
    spans = each.groupBy(key).agg(
        *[F.bool_or(n).alias(n) for n in ("snow", "school", "cleaning", "suspended")], F.bool_or(free & F.col("metered") & ~F.col("charged")).alias("unmetered"),
        F.every(free & ~F.col("yes")).alias("absent"), F.bool_or(free & ~F.col("yes")).alias("partly"),
    ).crossJoin(F.broadcast(known))  # one row
    said = F.array(
        F.when(~F.col("_known"), "no calendar"), F.when(F.col("snow"), "snow rule"), F.when(F.col("school"), "school days assumed"),
        F.when(F.col("cleaning") & F.col("suspended"), "cleaning suspended"), F.when(F.col("unmetered"), "meters off in part"),
        F.when(F.col("absent"), "nothing posted").when(F.col("partly"), "nothing posted in part"),
    )
    return spans.select(key, F.filter(said, lambda x: x.isNotNull()).alias("caveats"))


def effect_keys(rules: DataFrame, stack: str, seasons: tuple[int, ...] = (115, 415, 715, 1015), step: int = 5) -> DataFrame:
    """stack, effect: a hash of what a stack of rules means to a passenger car in every slot of `step` minutes of a week,
    at some days of the year (month * 100 + day). Stacks of the same effect mean the same, however they are worded.

    A slot is forbidden with the severest action, or permitted with its tightest limit and whether it is metered, or
    not spoken of. A stack is a few rules: they are held in its row, and no slot becomes a row."""
    fields = ["action", "permitted", "vehicle", "exclusive", "days", "from_min", "to_min", "season_from", "season_to", "metered", "limit_min", "except_sunday"]
    held = rules.groupBy(stack).agg(F.collect_list(F.struct(*fields)).alias("_r"))
    per_day = 1440 // step
    slots = F.sequence(F.lit(0), F.lit(7 * per_day * len(seasons) - 1))

    def said(s: Column) -> Column:
        season = F.get(F.array(*map(F.lit, seasons)), (s / (7 * per_day)).cast("int"))
        day, minute = (s % (7 * per_day) / per_day).cast("int"), s % per_day * step
        on = lambda r: fn.has_day(r["days"], day) & ~(r["except_sunday"] & (day == 6)) & fn.in_season(season, r["season_from"], r["season_to"]) & fn.in_clock_range(minute, r["from_min"], r["to_min"])
        says = lambda r: F.coalesce(applies(r["permitted"], r["vehicle"], r["exclusive"]), F.lit(None).cast("boolean"))
        rank = lambda r: F.coalesce(*[F.when(r["action"] == a, n) for a, n in RANKS.items()], F.lit(0))
        ban = F.array_max(F.transform("_r", lambda r: F.when(on(r) & ~says(r), rank(r))))
        yes = lambda r: on(r) & says(r) & (r["action"] == "park")
        limit = F.array_min(F.transform("_r", lambda r: F.when(yes(r), F.coalesce(r["limit_min"], F.lit(1 << 30)))))
        metered = F.coalesce(F.array_max(F.transform("_r", lambda r: F.when(yes(r), r["metered"].cast("int")))), F.lit(0))
        return F.when(ban.isNotNull(), F.concat(F.lit("n"), ban.cast("string"))).when(limit.isNotNull(), F.concat(F.lit("p"), limit.cast("string"), F.lit("m"), metered.cast("string"))).otherwise("-")

    return held.select(stack, F.sha2(F.array_join(F.transform(slots, said), ","), 256).alias("effect"))
