"""Sinks: CSV reports, JSON-lines ledgers, snapshots and mirrors of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import like_pattern_safe
from sievework.operators.reports import safe_sheet


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sheet as CSV with a header; no cell is a formula."""
    safe_sheet(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_report(sheets: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """A folder for each sheet. Workbooks need a library that is not here."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}", mode)


def append_ledger(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def put_settings(df: DataFrame, path: str) -> None:
    """Key, value (JSON) and at (a number that grows): added to the settings at `path`."""
    append_ledger(df.select("key", "value", F.col("at").cast("long").alias("at")), path)


def snapshot(df: DataFrame, path: str, partition_by: list[str] = (), files: int | None = None) -> DataFrame:
    """Write and read back. Partition folders hold few large files: rows of a folder meet before they are written."""
    if partition_by:
        df = df.repartition(files, *partition_by) if files else df.repartition(*partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mirror(tables: dict[str, DataFrame], path: str, skip: tuple[str, ...] = ("leases",), reset: bool = False) -> list[str]:
    """Copy tables to a folder. A table that is there already is an error, and then nothing is written, unless reset."""
    names = [like_pattern_safe(n) for n in tables if n not in skip]
    spark = next(iter(tables.values())).sparkSession
    if not reset and (there := [n for n in names if exists(spark, f"{path}/{n}")]):
        raise FileExistsError(f"mirrored already: {there}")
    for n in names:
        tables[n].write.mode("overwrite" if reset else "errorifexists").parquet(f"{path}/{n}")
    return names


def drop_mirror(spark: SparkSession, path: str) -> bool:
    """S14."""
    fs, where = _at(spark, path)
    return bool(fs.delete(where, True))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where))


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
