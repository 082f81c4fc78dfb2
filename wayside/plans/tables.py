"""Table access and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL of the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def posted(spark: SparkSession, sf_dir: str, texts: list[str], column: str) -> DataFrame:
    """The rows of `part`, each with one of the texts, in turn: a table that repeats texts, as signs and rates do."""
    rows = spark.createDataFrame(list(enumerate(texts)), f"_k int, {column} string")
    parts = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(texts)).cast("int").alias("_k"))
    return parts.join(F.broadcast(rows), "_k").drop("_k")  # a row per literal


def sql_posted(rows: list[tuple], columns: str) -> str:
    """SQL of the literal rows with n_posts, the rows of `part` that have each (its place in the list, in turn)."""
    one = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), 2 * chr(39))}'" if isinstance(v, str) else str(v)
    values = ", ".join(f"({i}, {', '.join(map(one, r))})" for i, r in enumerate(rows))
    return f"SELECT * EXCLUDE (_k) FROM (VALUES {values}) t(_k, {columns}) JOIN (SELECT p_partkey % {len(rows)} AS _k, count(*) AS n_posts FROM part GROUP BY 1) USING (_k)"
