"""Logs, upserts and tables written so that scans can leave most of them out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import snapshots
from .tables import query, read


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def manifest_latest(spark, d):
    """Events are an append-only log: each user's newest record."""
    return snapshots.latest(read(spark, d, "events"), "user_id", "event_id").select("event_id", "ts", "user_id", "event_type", "value", "props")


_UPSERT = """WITH r AS (SELECT o_orderkey AS k, o_totalprice AS v, 0 AS batch, 0 AS seq FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT l_orderkey, l_extendedprice, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END, l_linenumber * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem)
    SELECT k, {pick}(v, (batch, seq)) AS v FROM r GROUP BY k"""


def _upserted(spark, d, keep):
    old = read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    seq = F.col("l_linenumber") * F.lit(10_000_000_000) + F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"), seq.alias("seq"), "l_linenumber")
    return snapshots.upsert(old, [lines.where("l_linenumber <= 3"), lines.where("l_linenumber > 3")], ["k"], "seq", keep)


@query(_UPSERT.format(pick="arg_max"))
def upsert_replace(spark, d):
    """A third of the orders, then two batches of line items, each row replacing what its key had before it."""
    return _upserted(spark, d, "last")


@query(_UPSERT.format(pick="arg_min"))
def upsert_ignore(spark, d):
    """The same batches, each row left out if its key is there already."""
    return _upserted(spark, d, "first")


def stored_signs(spark, d) -> str:
    """Line items as signs, written by whether they were matched to a block and ranged by place; the path."""
    path = f"{shared_folder(spark)}/signs-{uuid.uuid4().hex}"
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") != 0.1).alias("matched"), (F.col("l_partkey") % 1000).alias("x"), (F.col("l_suppkey") % 1000).alias("y"))
    snapshots.publish_by(rows, path, ["matched"], ["x", "y"])
    return path


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 1000 AS x, l_suppkey % 1000 AS y FROM lineitem WHERE l_discount = 0.1 AND l_partkey % 1000 BETWEEN 100 AND 180 AND l_suppkey % 1000 BETWEEN 0 AND 60")
def unmatched_scan(spark, d):
    """Signs without a block inside a box: one folder of the stored table, and of its files those whose bounds meet the box."""
    signs = spark.read.parquet(stored_signs(spark, d))
    return signs.where("NOT matched AND x BETWEEN 100 AND 180 AND y BETWEEN 0 AND 60").select("l_orderkey", "l_linenumber", "l_partkey", "x", "y")
