"""Name resolution: normal forms, variants, positional word index, match ranks, fuzzy cascade."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: words of a street name and their usual short form
WORD_FORMS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "PLACE": "PL", "DRIVE": "DR", "DRIVEWAY": "DR", "PARKWAY": "PKWY", "TERRACE": "TER",
    "SQUARE": "SQ", "ROAD": "RD", "LANE": "LN", "COURT": "CT", "ALLEY": "ALY", "PLAZA": "PLZ", "BRIDGE": "BRG", "EXPRESSWAY": "EXPY", "HIGHWAY": "HWY",
    "CIRCLE": "CIR", "TUNNEL": "TUNL", "EAST": "E", "WEST": "W", "NORTH": "N", "SOUTH": "S", "FT": "FORT", "SAINT": "ST", "MT": "MOUNT",
    "FIRST": "1", "SECOND": "2", "THIRD": "3", "FOURTH": "4", "FIFTH": "5", "SIXTH": "6", "SEVENTH": "7", "EIGHTH": "8", "NINTH": "9", "TENTH": "10",
    "ELEVENTH": "11", "TWELFTH": "12",
}
#: fixed values: spelt numbers, words that say nothing in a name, how kinds of schools are shortened, what places are called
CARDINALS = {"ONE": "1", "TWO": "2", "THREE": "3", "FOUR": "4", "FIVE": "5", "SIX": "6", "SEVEN": "7", "EIGHT": "8", "NINE": "9", "TEN": "10"}
STOP_WORDS = ["THE", "OF", "AND", "AT", "A"]
SHORTHAND = {"PUBLIC SCHOOL": "PS", "HIGH SCHOOL": "HS", "MIDDLE SCHOOL": "MS"}
PLACE_ALIASES = {
    "MOMA": "MUSEUM OF MODERN ART (MOMA)", "THE MET": "METROPOLITAN MUSEUM OF ART", "MET MUSEUM": "METROPOLITAN MUSEUM OF ART",
    "PORT AUTHORITY": "PORT AUTHORITY BUS TERMINAL", "GRAND CENTRAL": "GRAND CENTRAL TERMINAL", "MSG": "MADISON SQUARE GARDEN",
}
#: fixed values: directions and street kinds that a variant may leave out
DIRECTIONS = ["E", "W", "N", "S"]
SUFFIXES = ["ST", "AVE", "BLVD", "PL", "DR", "PKWY", "TER", "SQ", "RD", "LN", "CT", "ALY", "PLZ"]


def _map(forms: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])


def normalize(name: Column, forms: dict[str, str] = WORD_FORMS, aliases: dict[str, str] | None = None) -> Column:
    """Cut at an asterisk, without dots and commas, upper case, single spaces, each word in its form,
    then the alias of the whole. Normalising twice changes nothing."""
    text = F.upper(F.regexp_replace(F.regexp_replace(name, r"\*.*$", ""), "[.,]", ""))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    table = _map(forms)
    out = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return F.coalesce(F.try_element_at(_map(aliases), out), out) if aliases else out


def fold(name: Column, **kw) -> Column:
    """normalize after punctuation has become space and ordinals like 3RD have become numbers."""
    text = F.regexp_replace(F.upper(name), r"[^A-Z0-9 ]", " ")
    return normalize(F.regexp_replace(text, r"\b(\d+)(ST|ND|RD|TH)\b", "$1"), **kw)


def name_words(folded: Column) -> Column:
    """The words that a folded name is searched by, in order: numbers as digits, stop words left out."""
    words = F.filter(F.split(folded, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    table = _map(CARDINALS)
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def place_spellings(name: Column, shorthand: dict[str, str] = SHORTHAND, aliases: dict[str, str] = PLACE_ALIASES) -> Column:
    """Array of the texts a place answers to: its own words (first), with each phrase once shortened where
    it occurs, and what it is called otherwise."""
    words, none = name_words(fold(name)), F.array().cast("array<array<string>>")

    def shortened(phrase: str, short: str) -> Column:
        want = F.array(*map(F.lit, phrase.split(" ")))
        n = len(phrase.split(" "))
        hits = F.filter(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.slice(words, i, F.lit(n)) == want)
        swap = lambda i: F.concat(F.slice(words, 1, i - 1), F.array(F.lit(short)), F.slice(words, i + n, F.size(words)))
        return F.when(F.size(words) >= n, F.transform(hits, swap)).otherwise(none)

    found = [F.array(words), *(shortened(*pair) for pair in shorthand.items())]
    for alias, target in aliases.items():
        found.append(F.when(words == name_words(fold(F.lit(target))), F.array(name_words(fold(F.lit(alias))))).otherwise(none))
    return F.array_distinct(F.filter(F.transform(F.concat(*found), lambda w: F.array_join(w, " ")), lambda s: s != ""))


def variants(norm: Column) -> Column:
    """Array of shorter forms: without the last word if it is a suffix, without the leading direction (of
    three words or more, or before a number), without both."""
    words = F.split(norm, " ")
    n = F.size(words)
    tail = F.element_at(words, -1).isin(sorted({*WORD_FORMS.values(), *SUFFIXES})) & (n > 1)
    numbered = norm.rlike(r"^[EW] \d{1,3}$")
    head = F.element_at(words, 1).isin(DIRECTIONS) & ((n > 2) | numbered)
    part = lambda start, length: F.array_join(F.slice(words, start, F.greatest(length, F.lit(0))), " ")
    found = F.array(norm, F.when(tail, part(F.lit(1), n - 1)), F.when(head, part(F.lit(2), n - 1)), F.when(head & tail & (n > 2), part(F.lit(2), n - 2)))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != "")))


def token_index(names: DataFrame, key: str, spelling: str) -> DataFrame:
    """token, position, key, spelling: a row per word; written sorted by token it is a range index."""
    rows = names.select(key, spelling, F.posexplode(F.split(spelling, " ")).alias("position", "token"))
    return rows.where("token <> ''").select("token", "position", key, spelling).distinct()


def with_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """The range scan token >= prefix and < its successor, which row groups can be pruned by."""
    return index.where((F.col("token") >= prefix) & (F.col("token") < prefix[:-1] + chr(ord(prefix[-1]) + 1)))


def match_rank(tokens: Column, words: Column, any_leads: bool = True) -> Column:
    """4 whole (the words are the tokens), 3 prefix (token by token from the start), 2 leading (a token,
    or without any_leads the first one, begins the first word), 1 inner; null unless every token begins
    some word."""
    every = F.forall(tokens, lambda t: F.exists(words, lambda w: F.startswith(w, t)))
    n = F.size(tokens)
    paired = F.zip_with(tokens, F.slice(words, 1, F.greatest(n, F.lit(1))), lambda t, w: F.coalesce(F.startswith(w, t), F.lit(False)))
    leads = F.exists(tokens if any_leads else F.slice(tokens, 1, 1), lambda t: F.startswith(F.get(words, 0), t))
    rank = F.when(tokens == words, 4).when(F.forall(paired, lambda x: x), 3).when(leads, 2).otherwise(1)
    return F.when(every, rank)


def best_matches(queries: DataFrame, names: DataFrame, q: str, key: str, spelling: str, most: int, any_leads: bool = True) -> DataFrame:
    """For each query the best spelling of each name, the first `most` names by (rank, length, text).
    Names are met through the words their longest token begins: an equi-join on its first two letters,
    or on its only one."""
    longest = F.aggregate(F.split(q, " "), F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    tokens = queries.withColumn("_t", F.filter(F.split(q, " "), lambda t: t != "")).withColumn("_p", F.substring(longest, 1, 2)).where("_p <> ''")
    words = names.withColumn("_w", F.split(spelling, " "))
    prefixes = F.flatten(F.transform("_w", lambda w: F.array(F.substring(w, 1, 1), F.substring(w, 1, 2))))
    words = words.withColumn("_p", F.explode(F.array_distinct(prefixes)))
    rows = tokens.join(words, "_p").withColumn("rank", match_rank(F.col("_t"), F.col("_w"), any_leads)).where("rank IS NOT NULL")
    best = rows.groupBy(q, key).agg(F.min_by(F.struct(spelling, "rank"), F.struct(-F.col("rank"), F.length(spelling), spelling)).alias("_b"))
    best = best.select(q, key, F.col(f"_b.{spelling}").alias(spelling), "_b.rank")
    w = Window.partitionBy(q).orderBy(F.desc("rank"), F.length(spelling), spelling, key)
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def one_edit(words: DataFrame, vocabulary: DataFrame, word: str, token: str, shortest: int = 4) -> DataFrame:
    """Pairs within one insertion, deletion or substitution. Both sides are keyed by what is left when
    any one letter is taken out, and by themselves: words one edit apart share such a key."""

    def keys(df: DataFrame, c: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        return df.where(F.length(c) >= shortest - 1).withColumn("_k", F.explode(F.array_distinct(F.array_append(cut, F.col(c)))))

    rows = keys(words.where(F.length(word) >= shortest), word).join(keys(vocabulary, token), "_k")
    return rows.where(F.levenshtein(word, token) <= 1).drop("_k").distinct()


def cascade(asked: DataFrame, vocabulary: DataFrame, q: str, token: str, aliases: dict[str, str], most: int = 40) -> DataFrame:
    """q, token, how: exact, then alias, then prefix (at most `most`), then one edit; the first that
    finds anything."""
    exact = asked.join(vocabulary, F.col(q) == F.col(token)).select(q, token, F.lit("exact").alias("how"), F.lit(1).alias("_r"))
    alias = asked.withColumn("_a", F.try_element_at(_map(aliases), F.col(q))).join(vocabulary, F.col("_a") == F.col(token)).select(q, token, F.lit("alias"), F.lit(2))
    w = Window.partitionBy(q).orderBy(token)
    short = F.substring(token, 1, 2)
    prefix = asked.join(vocabulary, (F.substring(q, 1, 2) == short) & F.startswith(F.col(token), F.col(q)) & (F.length(q) >= 2)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    fuzzy = one_edit(asked, vocabulary, q, token)
    rows = exact.union(alias).union(prefix.select(q, token, F.lit("prefix"), F.lit(3))).union(fuzzy.select(q, token, F.lit("one edit"), F.lit(4)))
    first = F.min("_r").over(Window.partitionBy(q))
    return rows.withColumn("_m", first).where("_r = _m").select(q, token, "how")


def likeness(a: str, b: str) -> Column:
    """Twice the letters in matching blocks over all letters of two text columns."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, u, v).ratio() for u, v in zip(x, y, strict=True)])

    return ratio(a, b)


def likeness_bound(a: str, b: str) -> Column:
    """What likeness() is at most, by the lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def closest(asked: DataFrame, vocabulary: DataFrame, q: str, token: str, least: float = 0.92) -> DataFrame:
    """q with its most similar token by matching blocks (twice the matched letters over all letters), if
    at least `least`. A similar pair leaves at most 2 * (1 - least) * (both lengths) of q's two-letter
    runs unmatched, so q is posted under so many of its rarest runs and one more, and frequent runs are
    seldom used; the ratio is computed on pairs of near length in Arrow batches."""
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(F.col(c), i, F.lit(2)))))
    posted = vocabulary.select(token, grams(token).alias("_g"))
    usual = posted.groupBy("_g").agg(F.count("*").alias("_n"))
    # the longest token that can be similar has length(q) * (2 - least) / least
    lost = F.floor(2 * (1 - least) * F.length(q) * (1 + (2 - least) / least) + 1e-9)
    rarest = F.row_number().over(Window.partitionBy(q).orderBy(F.coalesce("_n", F.lit(0)), "_g"))
    wanted = asked.select(q, grams(q).alias("_g")).join(usual, "_g", "left").withColumn("_k", rarest).where(F.col("_k") <= lost + 1)
    pairs = wanted.select(q, "_g").join(posted, "_g").select(q, token).distinct()
    rows = pairs.where(likeness_bound(q, token) >= least).withColumn("ratio", likeness(token, q)).where(F.col("ratio") >= least)
    return rows.groupBy(q).agg(F.min_by(F.struct(token, "ratio"), F.struct(-F.col("ratio"), token)).alias("b")).select(q, f"b.{token}", "b.ratio")
