"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder once and read it back.

    A reliable copy, so a lost executor costs only the tasks it was running; columns that a later step
    does not need are not read again. It stays until drop_since(), as the result may be read at any time.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """stored(), and the place of the table, for a step that can delete() it once the next is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _mine().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_written = threading.local()


def _mine() -> list[str]:
    """What this thread has written: jobs of other threads of a driver have lists of their own."""
    if not hasattr(_written, "paths"):
        _written.paths = []
    return _written.paths


def written() -> int:
    """How many tables stored() has written so far in this thread; a mark for drop_since()."""
    return len(_mine())


def drop_since(spark: SparkSession, mark: int) -> None:
    """Delete what stored() has written since a mark, once nothing reads it any more."""
    for path in _mine()[mark:]:
        delete(spark, path)
    del _mine()[mark:]


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Ranks are found in at least so many hash buckets, and in buckets of about so many rows.
BUCKETS, BUCKET_ROWS = 512, 1 << 16


def with_rank(df: DataFrame, key: str, order: list[str], rows: int, *, name: str = "rank") -> DataFrame:
    """0-based rank of each row within `key`, gapless, in the order of a hash of `order` and then `order`.

    A key may hold any share of the rows: rows are ranked within (key, hash bucket), and buckets start where the
    counts of the buckets before them end, so no task sees a whole key. Rows alike in all of `order` are ranked in
    any order among themselves. A key must not be null. `df` is read twice; it should be a table. `rows` is how many it has.
    """
    buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
    hashed = F.xxhash64(*order)
    dealt = df.withColumn("_hash", hashed).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 40), F.lit(buckets)).cast("int"))
    counts = df.select(F.col(key), F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(buckets)).cast("int").alias("_bucket"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
        .select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), "_start")
    )
    within = Window.partitionBy(key, "_bucket").orderBy("_hash", *order)
    ranked = dealt.withColumn("_row", F.row_number().over(within))
    return (
        ranked.join(starts, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(name, F.col("_start") + F.col("_row") - 1)
        .drop("_hash", "_bucket", "_row", "_key", "_b", "_start")
    )
