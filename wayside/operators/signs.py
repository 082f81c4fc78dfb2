"""Rules stated in sign texts, read with Spark's own text and array functions.

Texts repeat, so distinct ones are read once and joined back. A text is cleaned (arrows, drawn
symbols and tails in parentheses come off and leave flags), its spellings of days, clocks and dates
are brought to one form, and it is taken apart into pieces: known phrases, else single words. Each
piece gets a kind and what it says. An ordered fold over the pieces (`aggregate` with a struct as
state) then builds clauses: a phrase that opens a rule starts one or is folded into the one before;
days open a group of the clause, the clock ranges that follow belong to that group; words behind
EXCEPT are passed over. A clause gives one rule for each group and clock range.

What nothing takes lowers a text of prohibitions to 0.7 and leaves a text that would permit parking
without any rule; words of a reservation name its party and are taken as read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, PARTIAL = 400, 0.7

#: fixed values: phrases that open a rule -> (action, permitted, vehicle, exclusive, meta)
HEADS = {
    "NO PARKING": ("park", False, "all", False, False),
    "NO STANDING": ("stand", False, "all", False, False),
    "NO STOPPING": ("stop", False, "all", False, False),
    "AVO": ("park", True, "authorized", True, False),
    "AUTHORIZED VEHICLES ONLY": ("park", True, "authorized", True, False),
    "AUTHORIZED VEHICLE ONLY": ("park", True, "authorized", True, False),
    "LICENSE PLATES ONLY": ("park", True, "authorized", True, False),
    "PERMITS ONLY": ("park", True, "authorized", True, False),
    "VEHICLES WITH PERMIT ONLY": ("park", True, "authorized", True, False),
    "FIRE ZONE": ("stand", True, "authorized", True, False),
    "AMBULANCE ONLY": ("stand", True, "authorized", True, False),
    "AMBULETTE ONLY": ("stand", True, "authorized", True, False),
    "AMBULANCE AMBULETTE ONLY": ("stand", True, "authorized", True, False),
    "SECURITY CHECKPOINT": ("stand", True, "authorized", True, False),
    "CHECKPOINT": ("stand", True, "authorized", True, False),
    "COMMERCIAL VEHICLES ONLY": ("park", True, "commercial", True, False),
    "LOADING ONLY": ("stand", True, "commercial", True, False),
    "LOADING ZONE": ("stand", True, "commercial", True, False),
    "TRUCK LOADING ONLY": ("stand", True, "truck", True, False),
    "TRUCKS LOADING ONLY": ("stand", True, "truck", True, False),
    "TRUC LOADING ONLY": ("stand", True, "truck", True, False),
    "TRUCK WAITING LINE": ("stand", True, "truck", True, False),
    "BUS STOP": ("stand", True, "bus", True, False),
    "BUS STOP SIGN": ("stand", True, "bus", True, False),
    "BUS STAND": ("stand", True, "bus", True, False),
    "BUS LAYOVER ONLY": ("stand", True, "bus", True, False),
    "BUSES ONLY": ("stand", True, "bus", True, False),
    "BUSES WITH PERMIT ONLY": ("stand", True, "bus", True, False),
    "TAXI STAND": ("stand", True, "taxi", True, False),
    "TAXI RELIEF STAND": ("stand", True, "taxi", True, False),
    "TAXI FHV STAND": ("stand", True, "taxi", True, False),
    "TAXI/FHV STAND": ("stand", True, "taxi", True, False),
    "TAXI/FHV RELIEF STAND": ("stand", True, "taxi", True, False),
    "FOR-HIRE VEHICLES ONLY": ("stand", True, "taxi", True, False),
    "FOR HIRE VEHICLES ONLY": ("stand", True, "taxi", True, False),
    "PICK-UP/DROP-OFF ONLY": ("stand", True, "taxi", True, False),
    "PICK-UP DROP-OFF ONLY": ("stand", True, "taxi", True, False),
    "TAXI/FHV PICK-UP/DROP-OFF ONLY": ("stand", True, "taxi", True, False),
    "PRE-ARRANGED SERVICE ONLY": ("stand", True, "taxi", True, False),
    "WAITING LINE": ("stand", True, "other", True, False),
    "HOTEL LOADING ZONE": ("stand", True, "other", True, False),
    "FARMERS MARKET ONLY": ("stand", True, "other", True, False),
    "FLEA MARKET LOADING ONLY": ("stand", True, "other", True, False),
    "HORSE DRAWN CABS ONLY": ("stand", True, "other", True, False),
    "COMMUTER VAN STOP": ("stand", True, "other", True, False),
    "AUTHORIZED COMMUTER VANS ONLY": ("stand", True, "other", True, False),
    "MICROHUB ZONE": ("stand", True, "other", True, False),
    "CARSHARE PARKING ONLY": ("park", True, "other", True, False),
    "MOTORCYCLE PARKING ONLY": ("park", True, "other", True, False),
    "ELECTRIC VEHICLE CHARGING ONLY": ("park", True, "other", True, False),
    "ELECTRIC VEHICLES CHARGING ONLY": ("park", True, "other", True, False),
    "METERS ARE NOT IN EFFECT ABOVE TIMES": ("park", True, "all", False, True),
    "LIMITED PARKING IS NOT IN EFFECT ABOVE TIMES": ("park", True, "all", False, True),
}
#: fixed values: limits that open a rule -> (metered, minutes)
LIMITS = {
    "HMP": (True, 60), "HOUR METERED PARKING": (True, 60), "HR METERED PARKING": (True, 60), "HOUR PARKING": (False, 60), "HR PARKING": (False, 60),
    "MMP": (True, 1), "MINUTE PARKING": (False, 1), "MIN PARKING": (False, 1),
}
#: fixed values: a limit without a rule of its own -> minutes
LIMIT_RIDERS = {"HOUR LIMIT": 60, "HR LIMIT": 60}
#: fixed values: phrases that say nothing about the kerb -> whether they mark a temporary rule
RIDERS = {
    "TEMPORARY CONSTRUCTION REGULATION": True, "CONSTRUCTION": True, "NIGHT REGULATION": False, "SPECIAL NIGHT REGULATION": False, "IN TUNNEL": False, "NO ENGINE IDLING": False,
    "MAX FINE": False, "LICENSE PLATES": False, "DECALS ONLY": False, "DELIVERY DECAL REQUIRED": False, "ROUTES": False, "REVISED": False, "REVISION": False, "DATED": False,
}
#: fixed values: single words without meaning
IDLE = ["DATED", "ES", "FOR", "IF", "NECESSARY", "REV", "RIDER", "ROUTE", "ROUTES", "SEE", "SIZE", "SUPERSEDE", "SUPERSEDED", "SUPERSEDES", "SUPERSED"]
#: fixed values: what ends a clause
BREAKS = ["OTHER TIMES", "OTHERS"]
#: fixed values: misspellings of EXCEPT
EXCEPT = ["EXEPT", "EXCPET", "EXECPT"]
#: fixed values: blanks of a drawing to be filled in
BLANKS = ["XYY", "ZZZ", "XX", "XX XXYY", "XXXX", "999999", "TO BE SPECIFIED", "TO BE DET", "TO BE DETERMINED"]
#: fixed values: phrases of signs that state no rule of the kerb, looked for before a text is read, in order
PANELS = {
    "panel:pay_by_cell": ["PAY BY CELL", "PAY BY APP", "PARKNYC APP", "MUNI METER", "PARKING CARD"],
    "panel:mta_route": ["ROUTE PANEL", "DESTINATION PANEL", "BUS RIDER"],
    "panel:location": ["LOCATION PANEL"],
    "panel:parking_geometry": ["ANGLE PARKING ONLY", "DEG PARKING ONLY", "PARALLEL PARKING ONLY"],
}
#: fixed values: phrases of advice, which count only where no rule was found
ADVICE = [
    "KEEP LEFT", "KEEP RIGHT", "MUST EXIT", "NEXT LEFT", "NEXT RIGHT", "NO TRESPASSING", "SLIPPERY", "REVERSE CURVE", "DELINEATOR", "IDLING LAW", "NO ENGINE IDLING", "WEIGHT LIMIT",
    "INFORMATION SIGN", "INFORMATION BOX", "PLAZA RULES", "OPEN STREETS", "DISPATCHERS", "COMPLAINTS", "CHARGING SIGN", "CHARGING STATION", "MICROHUB SIGN", "NO TRUCKS", "NO BUSES",
    "CODING RIDER", "TEMPORARY CONSTRUCTION REGULATION", "DESCRIPTION NOT AVAILABLE", "GREENWAY",
]
#: fixed values: names of drawn symbols, dropped in front of a parenthesis that says it draws one
SYMBOL_NAMES = [
    "&", "ACCESS-A-RIDE", "BIKE", "BUS", "CAB", "CAR", "CROSS", "DIAMOND", "FHV", "HAIL", "HAILING", "HANDICAP", "HARDHAT", "HAT", "HARD", "HORSE", "DRAWN", "IDLING", "MICROHUB", "MOON", "NLZ",
    "PRESS", "STAR", "STARS", "TAXI", "TRUCK", "TRUCKS", "VAN", "VEHICLE", "W/", "WET", "WITH",
]
#: fixed values: names of days, Monday first
DAYS = [["MONDAY", "MON"], ["TUESDAY", "TUES", "TUE"], ["WEDNESDAY", "WED"], ["THURSDAY", "THURS", "THUR", "THU"], ["FRIDAY", "FRI"], ["SATURDAY", "SAT"], ["SUNDAY", "SUN"]]
#: fixed values: misspelt days
DAY_TYPOS = {"THURSDA": "THURSDAY", "STAURDAY": "SATURDAY", "SATRUDAY": "SATURDAY", "TUESAY": "TUESDAY", "WEDNSDAY": "WEDNESDAY", "MONDY": "MONDAY"}
#: fixed values
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
LAST = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

_DAY = "(?:" + "|".join(sorted((n for names in DAYS for n in names), key=len, reverse=True)) + ")"
_CLOCK = "(?:[0-9:]+(?:AM|PM)?|NOON|MIDNIGHT)"
_DATE = "(?:(?:" + "|".join(MONTHS) + ")[A-Z]*(?:/[0-9]+)?)"


def _any_of(phrases) -> str:
    return "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))


def _look_up(table: dict[str, int | bool], key: Column) -> Column:
    return F.try_element_at(_map(table), key)


def one_form(text: Column) -> Column:
    """Days, clocks and dates in one spelling each: 10A M is 10AM, JUNE 1 - NOV 30 is JUNE/1-NOV/30, MONDAY THRU
    FRIDAY is MONDAY-FRIDAY; a day broken in two is whole, a misspelt one right."""
    out = text
    for wrong in EXCEPT:
        out = F.regexp_replace(out, rf"\b{wrong}\b", "EXCEPT")
    for wrong, right in DAY_TYPOS.items():
        out = F.regexp_replace(out, rf"\b{wrong}\b", right)
    for names in DAYS:
        halves = "|".join(f"{names[0][:i]} {names[0][i:]}" for i in range(1, len(names[0])))
        out = F.regexp_replace(out, rf"\b(?:{halves})\b", names[0])
    out = F.regexp_replace(out, r"(?<=[0-9]) ?([AP])\.? ?M\b\.?", "$1M")
    out = F.regexp_replace(out, rf"\b((?:{'|'.join(MONTHS)})[A-Z]*)\.? ?([0-9]{{1,2}})(?![0-9A-Z:])", "$1/$2")
    for family, joint in ((_CLOCK, "-|TO"), (_DATE, "-"), (_DAY, "-|TO|THRU|THROUGH")):
        out = F.regexp_replace(out, rf"(?<![\w:/])({family}) ?(?:{joint}) ?({family})(?![\w:/])", "$1-$2")
    return out


def clock(token: Column) -> Column:
    """Minute of the day of 8AM, 8:30PM, NOON or MIDNIGHT; null for anything else."""
    half, digits = F.right(token, F.lit(2)), F.split(F.regexp_replace(token, "[AP]M$", ""), ":")
    hour, minute = F.get(digits, 0).try_cast("int"), F.coalesce(F.get(digits, 1), F.lit("0")).try_cast("int")
    read = half.isin("AM", "PM") & (F.size(digits) <= 2) & hour.between(0, 12) & minute.between(0, 59) & (F.translate(token, "0123456789:APM", "") == "")
    return F.when(token == "MIDNIGHT", 0).when(token == "NOON", 720).when(read, hour % 12 * 60 + minute + F.when(half == "PM", 720).otherwise(0))


def clock_range(token: Column) -> Column:
    """struct(a, b) of 7-10AM or NOON-MIDNIGHT; a start without AM or PM takes the end's."""
    ends = F.split(token, "-")
    first, last = F.get(ends, 0), F.get(ends, 1)
    bare = F.translate(first, "0123456789:", "") == ""
    a, b = clock(F.when(bare, F.concat(first, F.when(last.rlike("[AP]M$"), F.right(last, F.lit(2))).otherwise(""))).otherwise(first)), clock(last)
    return F.when((F.size(ends) == 2) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def season_range(token: Column) -> Column:
    """struct(a, b), month * 100 + day, of JUNE/1-NOV/30; a month without a day is whole."""
    ends = F.split(token, "-")

    def day(end: Column, last: bool) -> Column:
        parts = F.split(end, "/")
        month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.get(parts, 0), 1, 3)).cast("int"), F.lit(0))
        whole = F.element_at(F.array(*map(F.lit, LAST)), F.coalesce(month, F.lit(1))) if last else F.lit(1)
        number = F.when(F.size(parts) == 1, whole).otherwise(F.get(parts, 1).try_cast("int"))
        return F.when(number.between(1, 31), month * 100 + number)

    a, b = day(F.get(ends, 0), False), day(F.get(ends, 1), True)
    return F.when((F.size(ends) == 2) & token.rlike(f"^{_DATE}-{_DATE}$") & a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def days_of(piece: Column) -> Column:
    """Mask of the days of a list (MONDAY THURSDAY) or a range that may wrap (FRIDAY-MONDAY); null for anything else."""
    numbers = {name: i for i, names in enumerate(DAYS) for name in names}
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    ends = F.transform(F.split(piece, "-"), lambda w: _look_up(numbers, w))
    a, b = F.get(ends, 0), F.get(ends, 1)
    spread = F.aggregate(F.sequence(F.lit(0), F.pmod(b - a, F.lit(7))), F.lit(0), lambda m, k: m.bitwiseOR(bit((a + k) % 7)))
    listed = F.transform(F.split(F.regexp_replace(piece, " HOLIDAYS?$", ""), " "), lambda w: _look_up(numbers, w))
    named = F.when(~F.exists(listed, lambda x: x.isNull()), F.aggregate(listed, F.lit(0), lambda m, i: m.bitwiseOR(bit(i))))
    return F.when((F.size(ends) == 2) & a.isNotNull() & b.isNotNull(), spread).otherwise(named)


def drafting_mark(token: Column) -> Column:
    """A note of who drew the sign: a fine ($50), a sheet size (12"), a number of routes or revision (W/4, #2, REV.3),
    a date or number (5-7-98, 12/4), a sign code (SW-473, PS-1.G). A pair of hours (8-6) is none: it may be a
    time without its halves."""
    digits, number = "0123456789", F.translate(token, "0123456789", "")
    starts, tail = token.startswith, F.regexp_replace(token, "^[^-]*-", "")
    hours = F.transform(F.split(token, "-"), lambda x: x.try_cast("int").between(1, 12))
    pair = (number == "-") & (F.size(hours) == 2) & ~F.exists(hours, lambda x: ~F.coalesce(x, F.lit(False)))
    dated = (number != "") & (F.translate(number, "-/.", "") == "") & F.translate(F.right(token, F.lit(1)), digits, "").eqNullSafe("") & ~pair
    code = token.contains("-") & (F.translate(F.left(token, F.lit(1)), digits + "-", "") != "") & (F.translate(tail, digits, "") != tail)
    return (
        starts("$") & (F.translate(token, "$X" + digits, "") == "") | (F.length(number) <= 2) & number.isin("W/", "#") & (F.length(token) > F.length(number))
        | starts("REV") & (F.translate(F.substring(token, 4, 400), ".#" + digits, "") == "") | number.isin("'", '"', "'X", '"X') & (F.length(token) > F.length(number)) | dated | code
    )


def arrow_arity(text: Column) -> Column:
    return F.when(text.rlike(r"<-+>"), "both").when(text.rlike(r"<-+|-+>|SINGLE\s+ARROW|O'CLOCK\s+ARROW|\(\s*ARROW\s*\)"), "one").otherwise("none")


_HEAD_FIELDS = ["action", "permitted", "vehicle", "exclusive", "meta"]
_SPAN = "struct<a: int, b: int>"


def _type(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in fields.items()) + ">"


_GROUP = {"days": "int", "school": "boolean", "nosun": "boolean", "sun": "boolean", "all_times": "boolean", "times": f"array<{_SPAN}>"}
_CLAUSE = {
    "action": "string", "permitted": "boolean", "vehicle": "string", "exclusive": "boolean", "meta": "boolean", "metered": "boolean", "limit_min": "int", "season": _SPAN, "temporary": "boolean",
    "other": "boolean", "unread": "int", "last": "int", "groups": f"array<{_type(_GROUP)}>",
}
_STATE = {"done": f"array<{_type(_CLAUSE)}>", "open": "boolean", "now": _type(_CLAUSE), "pending": "int", "passing": "boolean", "other": "boolean"}


def _with(struct: str, fields: dict[str, str], **new: str) -> str:
    """SQL of the struct with some fields replaced."""
    return "named_struct(" + ", ".join(f"'{n}', cast({new.get(n, f'{struct}.{n}')} AS {t})" for n, t in fields.items()) + ")"


def _map(table: dict) -> Column:
    """A literal map; its values are plain or, for heads, tuples in the order of _HEAD_FIELDS."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    value = lambda v: "named_struct(" + ", ".join(f"'{n}', {text(x)}" for n, x in zip(_HEAD_FIELDS, v, strict=True)) + ")" if isinstance(v, tuple) else text(v)
    return F.expr("map(" + ", ".join(f"{text(k)}, {value(v)}" for k, v in table.items()) + ")")


def pieces(text: Column) -> Column:
    """Array of struct(kind, what it says) of a cleaned text, in order."""
    limits = rf"[0-9]{{1,4}} (?:{_any_of(LIMITS)})"
    whole = [limits, _any_of([*HEADS, *BREAKS]), _any_of(RIDERS), rf"[0-9]{{1,4}} (?:{_any_of(LIMIT_RIDERS)})", "ALL DAYS?", "7 DAYS", "SCHOOL DAYS", "(?:EXCEPT|INCLUDING) SUNDAY", rf"{_DAY}(?: {_DAY})*(?: HOLIDAYS?)?", r"\S+"]
    found = F.regexp_extract_all(text, F.lit(r"(?<!\S)(?:" + "|".join(whole) + r")(?!\S)"), F.lit(0))
    heads = _map(HEADS)
    units = {k: n for k, (_, n) in LIMITS.items()}
    metered = {k: m for k, (m, _) in LIMITS.items()}
    limit_head = F.struct(*[F.lit(z).alias(n) for n, z in zip(_HEAD_FIELDS, ("park", True, "all", False, False), strict=True)])

    def read(t: Column) -> Column:
        unit, count = F.regexp_replace(t, "^[0-9]+ ", ""), F.regexp_extract(t, "^([0-9]{1,6}) ", 1).try_cast("int")
        is_limit, times, season = t.rlike(f"^{limits}$"), clock_range(t), season_range(t)
        days = F.when(t.isin("ALL DAYS", "7 DAYS", "INCLUDING SUNDAY"), 127).when(t == "SCHOOL DAYS", 31).when(t == "EXCEPT SUNDAY", 63).otherwise(days_of(t))
        rider, rest = _look_up(RIDERS, t), _look_up(LIMIT_RIDERS, unit) * count
        head = F.when(is_limit, limit_head).otherwise(F.try_element_at(heads, t))
        kind = (
            F.when(head.isNotNull(), "head").when(t.isin(BREAKS), "break").when(season.isNotNull(), "season").when(times.isNotNull(), "times").when(t == "ANYTIME", "anytime").when(t == "ALL DAY", "all_day")
            .when(days.isNotNull(), "days").when(t == "EXCEPT", "except").when(rider.isNotNull(), "rider").when(rest.isNotNull(), "limit").when(t.isin([*IDLE, "-"]) | drafting_mark(t), "idle").otherwise("word")
        )
        return F.struct(
            kind.alias("kind"), head.alias("head"), F.coalesce(is_limit & _look_up(metered, unit), F.lit(False)).alias("metered"),
            F.when(is_limit, _look_up(units, unit) * count).otherwise(rest).cast("int").alias("limit_min"), F.coalesce(season, times).alias("span"), days.alias("days"),
            (t == "SCHOOL DAYS").alias("school"), (t == "EXCEPT SUNDAY").alias("nosun"), (t == "INCLUDING SUNDAY").alias("sun"), F.coalesce(rider, F.lit(False)).alias("temporary"), (t == "OTHERS").alias("others"),
        )

    return F.transform(found, read)


def clauses(said: str) -> Column:
    """The fold over a column of pieces: struct(done: the clauses that they build, pending: words that belong to none).

    s is the state and p a piece: s.now is the clause being built, if s.open, and s.done those before it.
    """
    keep = lambda **new: _with("s", _STATE, **{"passing": "p.kind = 'except'", **new})
    clause = lambda **new: _with("s.now", _CLAUSE, **{"last": "0", **new})
    case = lambda *whens, other: "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in whens) + f" ELSE {other} END"
    inside = lambda of: f"IF(s.open, {of}, {keep()})"
    none = "size(s.now.groups) = 0"

    # a phrase that opens a rule: another name of the rule before it, or a rule of its own
    plain = "s.open AND NOT p.head.meta AND NOT s.now.meta"
    same_party = f"{plain} AND p.head.exclusive AND s.now.exclusive AND {none}"
    party = f"{plain} AND p.head.exclusive AND NOT s.now.exclusive AND s.now.vehicle = 'all' AND ({none} OR s.now.permitted)"
    ban_of_party = f"{plain} AND NOT p.head.permitted AND s.now.exclusive AND {none}"
    moved = "IF(s.open AND p.head.exclusive AND NOT s.now.permitted, s.now.last, 0)"  # words in front of a party's name are its own
    opened = _with("p.head", _CLAUSE, **{
        "metered": "p.metered", "limit_min": "p.limit_min", "season": "null", "temporary": "false", "other": "s.other", "unread": f"s.pending + {moved}", "last": "0", "groups": "array()",
    })
    before = f"IF(s.open, concat(s.done, array({_with('s.now', _CLAUSE, unread=f's.now.unread - {moved}')})), s.done)"
    named_party = clause(action="IF(s.now.permitted, p.head.action, s.now.action)", permitted="true", vehicle="p.head.vehicle", exclusive="true")
    on_head = case(
        (same_party, keep(now=clause())), (party, keep(now=named_party)), (ban_of_party, keep(now=clause(action="p.head.action"))),
        other=keep(done=before, open="true", now=opened, pending="0", other="false"),
    )

    # what belongs to the clause's last group, which is made if there is none
    blank = _with("", _GROUP, days="null", school="false", nosun="false", sun="false", all_times="false", times="array()")
    last = f"IF({none}, {blank}, element_at(s.now.groups, -1))"
    ends = lambda **new: keep(now=clause(groups=f"concat(slice(s.now.groups, 1, greatest(size(s.now.groups) - 1, 0)), array({_with(last, _GROUP, **new)}))"))
    named = {"days": "p.days", "school": "p.school", "nosun": "p.nosun", "sun": "p.sun"}
    on_days = f"IF({last}.days IS NULL, {ends(**named)}, {keep(now=clause(groups=f'concat(s.now.groups, array({_with(blank, _GROUP, **named)}))'))})"
    unread = f"IF(s.open, {keep(now=_with('s.now', _CLAUSE, unread='s.now.unread + 1', last='s.now.last + 1'))}, {keep(pending='s.pending + 1')})"
    then = case(
        ("p.kind = 'head'", on_head), ("p.kind = 'break'", keep(done="IF(s.open, concat(s.done, array(s.now)), s.done)", open="false", other="NOT p.others")),
        ("p.kind = 'season'", inside(keep(now=clause(season="p.span")))), ("p.kind = 'times'", f"IF(s.open, {ends(times=f'concat({last}.times, array(p.span))')}, {keep(pending='s.pending + 1')})"),
        ("p.kind = 'anytime'", inside(ends(days=f"coalesce({last}.days, 127)", all_times="true"))), ("p.kind = 'all_day'", inside(ends(all_times="true"))),
        ("p.kind = 'days'", inside(on_days)), ("p.kind = 'rider'", inside(keep(now=clause(temporary="s.now.temporary OR p.temporary")))),
        ("p.kind = 'limit'", inside(keep(now=clause(limit_min="p.limit_min")))), ("p.kind = 'word'", unread), other=keep(),
    )
    stops = "(p.kind IN ('times', 'season', 'days') OR p.kind = 'head' AND NOT p.head.exclusive)"
    empty = f"cast(named_struct('done', array(), 'open', false, 'now', null, 'pending', 0, 'passing', false, 'other', false) AS {_type(_STATE)})"
    end = "s -> named_struct('done', IF(s.open, concat(s.done, array(s.now)), s.done), 'pending', s.pending)"
    return F.expr(f"aggregate({said}, {empty}, (s, p) -> IF(s.passing AND NOT {stops}, s, {then}), {end})")


def read_signs(df: DataFrame, text: str) -> DataFrame:
    """A row per rule: text, ordinal, action, permitted, vehicle, exclusive, meta, metered, limit_min,
    days, from_min, to_min, season_from, season_to, cleaning, snow, school, except_sunday,
    including_sunday, temporary, arrow, confidence. Texts without any rule, texts that would permit
    parking but have a part that isn't read, and texts of more than MAX_CHARS characters give one row with
    a null action and confidence 0; null texts give none."""
    rows = df.select(text).where(F.col(text).isNotNull()).distinct()
    short = F.when(F.length(text) <= MAX_CHARS, F.col(text)).otherwise("")
    up = F.upper(F.regexp_replace(short, r"[^ -~]", " "))
    inside = F.array_join(F.regexp_extract_all(up, F.lit(r"\(([^()]*)\)?"), F.lit(1)), " ")
    bare = F.regexp_replace(up, r"\(?\s*(?:W/\s*)?SINGLE\s+ARROW\s*\)?|W/\s*\d+M?\s*O'CLOCK\s+ARROW|\(\s*ARROW\s*\)|<-+>?|-+>", " ")
    bare = F.regexp_replace(bare, rf"(?:(?<!\S)/?(?:{_any_of(SYMBOL_NAMES)})\s+)*\([^()]*(?:SYMBO|LOGO|BROOM)[^()]*\)?", " ")
    bare = F.regexp_replace(bare, r"\([^()]*\)?", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?<=\s|^)[/.,;:!+*]+|[.,;:!+*]+(?=\s|$)", " "), r"(?<=\s|^)[^A-Z0-9\s-]+(?=\s|$)", " ")
    bare = F.regexp_replace(bare, r"\b(NO )?(STANDING|PARKING|STOPPING)(?=[A-Z])", "$1$2 ")
    clean = one_form(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<=\s|^)-+(?=\s|$)", "-"), r"\s+", " ")))
    rows = rows.select(
        text, arrow_arity(up).alias("arrow"), inside.contains("BROOM").alias("cleaning"), inside.contains("SNOW").alias("snow"), pieces(clean).alias("_p"),
    ).withColumn("_c", clauses("_p")).drop("_p")
    some = lambda g: g["days"].isNotNull() | (F.size(g["times"]) > 0) | g["all_times"]
    rows = rows.withColumn("_done", F.transform("_c.done", lambda c: c.withField("groups", F.filter(c["groups"], some))))
    skips = lambda c: c["other"] | ~c["exclusive"] & (c["unread"] > 0) | (F.size(c["groups"]) > 1) & F.exists(c["groups"], lambda g: g["days"].isNotNull() & (F.size(g["times"]) == 0))
    permits = lambda c: c["permitted"] & c["vehicle"].isin("all", "passenger")
    rows = rows.withColumn("_skipped", (F.col("_c.pending") > 0) | F.exists("_done", skips))
    rows = rows.withColumn("_done", F.when(F.col("_skipped") & F.exists("_done", permits), F.slice("_done", 1, 0)).otherwise(F.col("_done")))
    blank = F.lit(None).cast(_type(_GROUP))
    each = lambda c, g: F.transform(F.when(F.size(g["times"]) > 0, g["times"]).otherwise(F.array(F.lit(None).cast(_SPAN))), lambda t: F.struct(c.alias("c"), g.alias("g"), t.alias("t")))
    groups = lambda c: F.when(F.size(c["groups"]) > 0, c["groups"]).otherwise(F.array(blank))
    rules = F.flatten(F.transform("_done", lambda c: F.flatten(F.transform(groups(c), lambda g: each(c, g)))))
    rows = rows.select("*", F.posexplode_outer(rules).alias("_i", "_r"))
    stated = F.col("_r").isNotNull()
    flag = lambda f: F.coalesce(F.col(f"_r.{f}"), F.lit(False))
    return rows.select(
        text, F.coalesce(F.col("_i") + 1, F.lit(0)).alias("ordinal"), "_r.c.action", "_r.c.permitted", "_r.c.vehicle", flag("c.exclusive").alias("exclusive"), flag("c.meta").alias("meta"),
        flag("c.metered").alias("metered"), "_r.c.limit_min", F.when(stated, F.coalesce("_r.g.days", F.lit(127))).alias("days"), F.col("_r.t.a").alias("from_min"), F.col("_r.t.b").alias("to_min"),
        F.col("_r.c.season.a").alias("season_from"), F.col("_r.c.season.b").alias("season_to"), "cleaning", "snow", flag("g.school").alias("school"), flag("g.nosun").alias("except_sunday"),
        flag("g.sun").alias("including_sunday"), flag("c.temporary").alias("temporary"), "arrow",
        F.when(~stated, 0.0).when(F.col("_skipped"), PARTIAL).otherwise(1.0).alias("confidence"),
    )


def _words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[^A-Z0-9]+", " ")), F.lit(" "))


def _says(words: Column, phrases) -> Column:
    """Whether one of the phrases stands in the words."""
    return F.exists(F.array(*[F.lit(f" {' '.join(re.findall('[A-Z0-9]+', p))} ") for p in phrases]), lambda p: F.contains(words, p))


def panel_class(text: Column) -> Column:
    """The kind of a sign that states no rule, by its words alone; null if it may state one. A blank
    template that names a rule does state one, of unknown days."""
    up = F.upper(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(up, r"\([^()]*\)?|<?-+>?", " "), r"[^A-Z0-9]+", " "))
    kind, words = F.when(bare == "", F.when(up.contains("SUPERSED"), "panel:supersedes_only").otherwise("panel:blank")), _words(up)
    kind = kind.when(_says(words, BLANKS), F.when(~_says(words, HEADS), "panel:template"))
    for label, phrases in PANELS.items():
        kind = kind.when(_says(words, phrases), label)
    return kind


def sign_readings(df: DataFrame, text: str) -> DataFrame:
    """A row per distinct text: panel (its kind, if it states no rule), outcome (panel, full, partial,
    unparsed), family_action (the most restrictive prohibition for a passenger car, else park, else
    null; rules that only qualify others don't count) and arity (double, single, none; null without a
    rule)."""
    rank = F.when(F.col("action") == "stop", 3).when(F.col("action") == "stand", 2).otherwise(1)
    stated = F.col("action").isNotNull()
    says = F.when(stated & ~F.col("meta"), F.when(F.col("vehicle").isin("all", "passenger"), F.col("permitted")).when(F.col("exclusive"), False))
    rows = read_signs(df, text).groupBy(text).agg(
        F.max_by("action", F.when(~says, rank)).alias("_no"), F.bool_or(says).alias("_yes"), F.bool_or(stated).alias("_rule"), F.min("confidence").alias("_least"),
        F.max(F.when(stated, F.when(F.col("arrow") == "both", 3).when(F.col("arrow") == "one", 2).otherwise(1))).alias("_arrow"),
    )
    advice = F.when(~F.col("_rule") & _says(_words(F.upper(text)), ADVICE), "panel:advisory")
    rows = rows.withColumn("panel", F.coalesce(panel_class(F.col(text)), advice))
    free = F.col("panel").isNull()
    return rows.select(
        text, "panel",
        F.when(~free, "panel").when(~F.col("_rule") | (F.col("_least") == 0), "unparsed").when(F.col("_least") < 1, "partial").otherwise("full").alias("outcome"),
        F.when(free, F.when(F.col("_no").isNotNull(), F.concat(F.lit("no-"), "_no")).when(F.col("_yes"), "park")).alias("family_action"),
        F.when(free, F.when(F.col("_arrow") == 3, "double").when(F.col("_arrow") == 2, "single").when(F.col("_arrow") == 1, "none")).alias("arity"),
    )


def hour_rates(text: Column) -> Column:
    """Hourly prices of a rate text, as decimals in hour order: one flat rate, or terms numbered 1st,
    2nd, ... and additional. Anything else gives an empty array: a wrong price is worse than none."""
    term = r"\$\s*(\d+(?:\.\d{1,2})?)\s*(?:(per hour)|(\d)(?:st|nd|rd|th) hour|(add'?l|additional))"
    clean = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    part = lambda g: F.regexp_extract_all(clean, F.lit(term), F.lit(g))
    amounts, flat, order, more = (part(g) for g in (1, 2, 3, 4))
    n = F.size(amounts)
    is_flat = (n == 1) & (F.get(flat, 0) != "")
    in_order = F.forall(F.transform(order, lambda o, i: (o == (i + 1).cast("string")) | ((F.get(more, i) != "") & (i > 0))), lambda x: x) & F.forall(flat, lambda x: x == "")
    prices = F.transform(amounts, lambda a: a.cast("decimal(12,2)"))
    return F.when((n > 0) & (is_flat | in_order), prices).otherwise(F.array().cast("array<decimal(12,2)>"))


def session_limit(text: Column) -> Column:
    """The shortest of the limits a text states, in minutes."""
    hours = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+)\s*(?:hr|hour)"), F.lit(1)), lambda x: x.cast("int") * 60)
    minutes = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+)\s*min"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_min(F.concat(hours, minutes))
