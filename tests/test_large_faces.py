"""Operators over one face whose work would grow with the square of its rows if frames or joins were badly chosen."""

import time

from pyspark.sql import functions as F

from wayside.operators import joins, ranking, spans

N = 200_000


def within(seconds, df):
    began = time.time()
    n = df.count()
    df.write.format("noop").mode("overwrite").save()
    assert time.time() - began < seconds
    return n


def test_one_face_of_many_rows(spark):
    rows = spark.range(N).select(F.lit(1).alias("face"), (F.col("id") % 7).alias("family"), (F.col("id") * 3).alias("at"), F.lit(3 * N).alias("len"), F.col("id"))
    assert within(60, spans.double_arrow(rows, ["face"], "family", "at", "len")) == N
    known = rows.where("id % 3 = 0").select("face", "at", F.col("id").cast("double").alias("v"))
    assert within(60, joins.asof_interpolate(rows.select("face", "at"), known, ["face"], "at", "v", 100)) == N
    assert within(60, joins.nearest_key(rows.select("face", "at"), known, ["face"], "at")) == N
    assert within(60, ranking.anchored_bands(rows, "face", "id", "at", 10.0)) == N
    held = rows.select("face", "id", F.col("at").alias("span_start"), (F.col("at") + 7).alias("span_end"))
    assert within(60, spans.flatten(held, ["face"], "id")) > N


def test_bands_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(g, i, float(i * i % 97) / 4) for g in range(3) for i in range(60)]
        got = {(r.g, r.k): r.band for r in ranking.anchored_bands(spark.createDataFrame(rows, "g int, k int, s double"), "g", "k", "s", 1.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in range(3):
        anchor, band = None, -1
        for s, k in sorted((s, k) for h, k, s in rows if h == g):
            if anchor is None or s - anchor > 1.5:
                anchor, band = s, band + 1
            want[g, k] = band
    assert got == want
