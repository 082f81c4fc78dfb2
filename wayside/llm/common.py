"""What the operators of this package share: table access, words, folds, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@cache
def _archive() -> str:
    """The library as a zip file in a fresh temporary folder of the driver."""
    root = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="wayside-")) / "wayside_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    return str(out)


def ship(spark: SparkSession) -> None:
    """Sends the library to the executors, once a context, so tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_wayside", None) is None and (Path(__file__).resolve().parent.parent / "__init__.py").is_file():
        context.addPyFile(_archive())
        context._wayside = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo folds; null ids are in fold 0 of the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, near the wanted ones."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, which its driver and executors share. Only a
    session that runs in one process, as in tests, may leave it unset: then it is a local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        there = spark.conf.get("spark.checkpoint.dir", None)
        if there is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            there = f"{tempfile.gettempdir()}/wayside-checkpoints"
        context.setCheckpointDir(there)
    return context._jsc.sc().getCheckpointDir().get()


#: rows of whole texts or sets that pass between Spark and Python at once; Spark's 10,000 are tens of MB on both sides of each task
WIDE_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _batches(spark: SparkSession, rows: int | None):
    """What runs inside passes at most so many rows to Python at once."""
    before = spark.conf.get(_BATCH, None)
    least = rows if before is None or int(before) <= 0 else min(rows or int(before), int(before))
    if rows:
        spark.conf.set(_BATCH, str(least))
    try:
        yield
    finally:
        if rows:
            spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def _few_files(df: DataFrame) -> DataFrame:
    """df in at most a quarter of the session's shuffle partitions, or eight tasks a core: many small partitions are
    written one after the other in a task. No row is moved. For each file of a local folder Hadoop starts chmod twice,
    and until such a child begins it counts as a second executor of the same memory."""
    spark = df.sparkSession
    return df.coalesce(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def written(df: DataFrame, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: compact, and read by column. rows: as in cut()."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _batches(df.sparkSession, rows):
        _few_files(df).write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that written() made, once nothing will read it any more."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(table.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


#: ids, 8 or 16 bytes each, that are sent to all tasks; where there are more, rows are joined by shuffle
SENT_IDS = 1_000_000


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose key is among ids, a table of one narrow column (left_anti: is not). Up to SENT_IDS
    ids are counted and sent to the tasks, so that wide rows are not shuffled only to be dropped."""
    (key,) = ids.columns
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, key, how)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df to the session's shared checkpoint folder and reads it from there: later steps
    neither recompute it nor depend on the executors that made it. rows: that pass to Python at once."""
    _shared_folder(df.sparkSession)
    with _batches(df.sparkSession, rows):
        return _few_files(df).checkpoint(eager=True)


#: a key is hot if it has more than one in HOT_PART of all rows, so there are fewer than HOT_PART hot
#: keys and their list can be sent to all tasks; each is dealt to SALTS groups
HOT_PART, SALTS = 2000, 64


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The keys of counts (a written table: a row per key, with its number of rows n of total) that are hot."""
    return counts.where(F.col(n) * HOT_PART > total).select(*keys)


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with other, in which a key occurs once, by shuffle. Rows of hot keys are dealt to
    SALTS groups by the hash of the columns `by`, and their partner goes to each of these."""
    s, h = unused(rows, "_salt", "_hot")
    mark = F.broadcast(hot.withColumn(h, F.lit(True)))  # fewer than HOT_PART rows
    deal = F.when(F.col(h), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col(h), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.join(mark, keys, "left").withColumn(s, deal).drop(h)
    return dealt.join(other.join(mark, keys, "left").withColumn(s, every).drop(h), [*keys, s], how).drop(s)
