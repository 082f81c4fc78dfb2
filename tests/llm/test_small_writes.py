"""Tables written between steps: few files for many small partitions, and wide rows to Python in small batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from wayside.llm import common, near_dedup, packing, suffix_dedup

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(df):
    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.mapInArrow(apply, "n long")


def test_many_small_partitions_are_few_files(spark):
    rows = spark.range(0, 3000, 1, 300)
    most = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    for table in (common.cut(rows), common.written(rows)):
        assert sorted(r.id for r in table.collect()) == list(range(3000))
    assert common.cut(rows).rdd.getNumPartitions() <= most < 300
    assert len(common.written(rows).inputFiles()) <= most
    assert common.cut(spark.range(0, 30, 1, 3)).rdd.getNumPartitions() == 3


def test_wide_rows_pass_in_small_batches(spark):
    rows = spark.range(0, 5000, 1, 1)
    for write in (common.cut, common.written):
        assert [r.n for r in write(sizes(rows)).collect()] == [5000]
        assert sorted(r.n for r in write(sizes(rows), rows=700).collect()) == [100, *[700] * 7]
        assert spark.conf.get(BATCH, None) is None
    spark.conf.set(BATCH, "300")  # a smaller one that the session states holds, and is put back
    try:
        assert max(r.n for r in common.cut(sizes(rows), rows=700).collect()) == 300
        assert spark.conf.get(BATCH) == "300"
    finally:
        spark.conf.unset(BATCH)


def test_texts_pass_in_small_batches(spark, monkeypatch):
    """near_dedup, packing and suffix_dedup never hold more than WIDE_ROWS texts in a batch."""
    base = "".join(chr(97 + i * i % 23) + " " * (i % 5 == 0) for i in range(500))
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit(base), (F.col("id") % 20).cast("string")).alias("text"))
    want = {}
    for rows in (1000, 3):
        for module in (near_dedup, packing, suffix_dedup):
            monkeypatch.setattr(module, "WIDE_ROWS", rows)
        seen, conf = [], spark.conf

        class Noted(type(conf)):
            def set(self, key, value):
                if key == BATCH:
                    seen.append(value)
                return super().set(key, value)

        monkeypatch.setattr(type(spark), "conf", property(lambda self, c=Noted(conf._jconf): c))
        got = [sorted(map(tuple, f(docs).collect())) for f in (near_dedup.near_duplicates, packing.pack, suffix_dedup.dedup)]
        assert seen and set(seen) == {str(rows)}
        assert want.setdefault("rows", got) == got
