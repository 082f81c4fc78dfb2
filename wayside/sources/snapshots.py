"""Readers and writers: JSON snapshots, TSV, calendars, manifests, published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_DAYS = 14
#: fixed values: holidays on which meters stop
MAJOR = ["NEW YEAR'S DAY", "MEMORIAL DAY", "INDEPENDENCE DAY", "LABOR DAY", "THANKSGIVING DAY", "CHRISTMAS DAY"]


def read_snapshot(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A file that is one JSON array of objects; every scalar stays text, absent keys are null, and an
    unreadable object is an error."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """count, sign_codes, sign_description of a tab-separated corpus with a header."""
    return spark.read.schema("count long, sign_codes string, sign_description string").option("sep", "\t").option("header", True).csv(path)


def latest(manifest: DataFrame, key: str, at: str) -> DataFrame:
    """The newest record of each key of an append-only log."""
    return manifest.groupBy(key).agg(F.max_by(F.struct("*"), F.col(at)).alias("r")).select("r.*")


def upsert(old: DataFrame, batches: list[DataFrame], keys: list[str], order: str | None = None, keep: str = "last") -> DataFrame:
    """old with the rows of several batches put in, in the order of the batches and, inside one, of the column
    `order` (a number of arrival; without it a batch has a key once). keep="last": a row replaces what its
    key had; keep="first": it is left out if its key is there already. All batches go in by one grouping: a key's
    rows meet as one struct each, and only the first or last by arrival stays. Null keys are equal to each other."""
    columns = old.columns
    at = lambda df, n: df.select(*columns, F.struct(F.lit(n).alias("batch"), (F.col(order).cast("long") if order and n else F.lit(0).cast("long")).alias("place")).alias("_at"))
    rows = at(old, 0)
    for n, batch in enumerate(batches, 1):
        rows = rows.unionByName(at(batch, n))
    pick = F.max_by if keep == "last" else F.min_by
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(F.struct(*columns), "_at").alias("r")).select("r.*")


def calendar_days(texts: DataFrame, text: str) -> DataFrame:
    """date, label, meters_suspended, is_major, one row a day, of iCalendar texts (a row per file).

    Folded lines are joined, events found by pattern, days run from DTSTART to before DTEND, at least
    one and at most MAX_DAYS; of several events on a day the last in the file counts.
    """
    whole = F.regexp_replace(F.regexp_replace(text, "\r", ""), "\n[ \t]", "")
    events = texts.select(F.posexplode(F.regexp_extract_all(whole, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("_n", "_e"))
    day = lambda name: F.to_date(F.nullif(F.regexp_extract("_e", rf"{name}[^:\n]*:(\d{{8}})", 1), F.lit("")), "yyyyMMdd")
    detail = F.regexp_replace(F.regexp_replace(F.regexp_extract("_e", r"(?m)^DESCRIPTION[^:\n]*:(.*)$", 1), r"\\[nN]", "\n"), r"\\([,;])", "$1")
    events = events.withColumns({"_a": day("DTSTART"), "_b": day("DTEND"), "_d": detail}).where("_a IS NOT NULL")
    days = F.least(F.greatest(F.coalesce(F.date_diff("_b", "_a"), F.lit(1)), F.lit(1)), F.lit(MAX_DAYS))
    label = F.coalesce(F.nullif(F.trim(F.regexp_extract("_d", r"suspended[^.\n]*\bfor ([^.\n]+)", 1)), F.lit("")), F.lit("Suspended"))
    meters = F.lower("_d").contains("meters will not be in effect")
    rows = events.select("_n", label.alias("label"), meters.alias("meters_suspended"), F.explode(F.sequence("_a", F.date_add("_a", days - 1))).alias("date"))
    last = rows.groupBy("date").agg(F.max_by(F.struct("label", "meters_suspended"), "_n").alias("r")).select("date", "r.label", "r.meters_suspended")
    return last.withColumn("is_major", F.col("meters_suspended") | is_major(F.col("label")))


def is_major(label: Column) -> Column:
    plain = F.upper(F.regexp_replace(label, "[‘’]", "'"))
    return F.exists(F.array(*map(F.lit, MAJOR)), lambda m: F.contains(plain, m))


def publish_by(df: DataFrame, path: str, parts: list[str], ranges: list[str]) -> None:
    """Writes df as Parquet, a folder for each value of parts, rows inside ordered by ranges, so a scan for one
    part reads only its folder, and one for a range only the files and row groups whose bounds meet it."""
    df.repartitionByRange(*parts, *ranges).sortWithinPartitions(*parts, *ranges).write.mode("overwrite").partitionBy(*parts).parquet(path)


def publish(df: DataFrame, table: str, cluster_by: list[str]) -> None:
    """Writes a table sorted by its leading keys, so row groups prune range scans. Readers see the old
    files until the write is committed."""
    df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by).write.mode("overwrite").saveAsTable(table)
