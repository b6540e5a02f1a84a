"""Streams: folders that are watched, idempotent merges, daily windows, deduplication, budgets and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sievework.operators.changes import upserted
from sievework.operators.joins import join_counted


def watched(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100, file_format: str = "parquet") -> DataFrame:
    """New files of a folder, some at a time; which ones were read is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(file_format).load(path)


def daily_counts(events: DataFrame, at: str, measures: dict[str, Column], late: str = "1 day", duration: str = "1 day") -> DataFrame:
    """Tumbling windows with a watermark. A zoneless time counts as UTC: watermarks need an instant."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", duration)).agg(*[F.count(F.when(test, 1)).alias(n) for n, test in measures.items()]).select(F.col("window.start").alias("start"), *measures)


def daily_activity(events: DataFrame, at: str, measures: dict[str, Column], folder: str, late: str = "1 day", duration: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(windows that are over with their measures, rows that came too late for theirs), from a stream run to its end.

    A row is too late if its window ended by the watermark: `late` before the latest time of all batches before its own.
    Such rows go to a side table; the others to windows in append mode, whose state goes when the watermark passes them.
    So a row is in one or the other or in a window that is still open. Both are tables under `folder`, which all tasks
    share; a batch that is sent again writes the same rows in the same place. Rows without a time count as late.
    """
    spark, schema = events.sparkSession, events.schema
    timed = F.col(at).cast("timestamp")

    def split(batch: DataFrame, n: int) -> None:
        marks = spark.read.schema("batch long, latest timestamp").parquet(f"{folder}/marks") if n else None
        mark = marks.where(F.col("batch") < n).agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("m")).first()["m"] if n else None  # a row a batch
        over = F.coalesce(F.window(timed, duration)["end"] <= F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        marked = batch.withColumn("_late", over | timed.isNull()).persist()
        try:
            marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{folder}/late/batch={n}")
            marked.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{folder}/kept/{n}")
            marked.agg(F.max(timed).alias("latest")).write.mode("overwrite").parquet(f"{folder}/marks/batch={n}")
        finally:
            marked.unpersist()

    events.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/checkpoint-split").trigger(availableNow=True).start().awaitTermination()
    own = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/kept/*")
    windows = into_files(daily_counts(own, at, measures, late, duration), f"{folder}/windows", f"{folder}/checkpoint-windows")
    return windows, spark.read.schema(schema).parquet(f"{folder}/late")


def without_repeats(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first of each key within the watermark; its state is dropped afterwards."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


class MergedTable:
    """A table at `path`, a folder that all tasks share, to which batches of upserts are applied; for foreachBatch.

    Rows lie in buckets of their keys. A batch writes only the buckets that it touches, and then a manifest that says
    which batch wrote each bucket last; a table is what the manifest of its last batch names. A batch that is sent again
    starts from the manifest before its own and leaves the same rows. Of several changes of a key in a batch the last by
    `order` holds. Null keys are equal to each other. What neither of the last two manifests names is deleted.

    There are as many buckets as it takes for `bucket_rows` rows in each, a power of two; a table that outgrows them is
    dealt anew with its next batch. A bucket is written by several tasks.
    """

    PARTS = 4

    def __init__(self, spark: SparkSession, path: str, start: DataFrame, keys: list[str], order: str, bucket_rows: int = 1 << 20):
        self.spark, self.path, self.keys, self.order, self.bucket_rows = spark, path.rstrip("/"), keys, order, bucket_rows
        self.schema, self.start = start.schema, start

    def _bucket(self, of: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(of)).cast("int")

    def manifest(self, n: int) -> dict[int, tuple[int, int]]:
        """By bucket the batch that wrote it last and its rows, after batch n; the number of buckets is that of the entries."""
        return {r["bucket"]: (r["batch"], r["rows"]) for r in self.spark.read.schema("bucket int, batch int, rows long").parquet(f"{self.path}/manifests/{n}").collect()}  # a row a bucket

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        root, fs = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n) for n in names if fs.exists(self._fs(f"manifests/{n}/_SUCCESS")[0]))

    def _rows(self, held: dict[int, tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/data/batch={n}/_bucket={b}" for b, (n, rows) in held.items() if rows]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.start.where(F.lit(False))

    def read(self) -> DataFrame:
        done = self.batches()
        return self._rows(self.manifest(done[-1])) if done else self.start

    def apply(self, batch: DataFrame, n: int) -> None:
        done = [k for k in self.batches() if k < n]
        before = self.manifest(done[-1]) if done else {}
        rest = [c for c in self.start.columns if c not in self.keys]
        last = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("_r")).select(*self.keys, "_r.*")
        many = sum(rows for _, rows in before.values()) if done else self.start.count() + batch.count()
        of = max(len(before), 1)
        while of * self.bucket_rows < many:
            of *= 2
        if of == len(before):
            touched = {r["b"] for r in batch.select(self._bucket(of).alias("b")).distinct().collect()}  # no more than there are buckets
            old = self._rows({b: k for b, k in before.items() if b in touched})
        else:  # the first batch, or too few buckets
            touched, old = set(range(of)), self._rows(before) if done else self.start
        rows = upserted(old, last, self.keys).withColumn("_bucket", self._bucket(of))
        data = f"{self.path}/data/batch={n}"
        rows.repartition("_bucket", F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(self.PARTS))).write.mode("overwrite").partitionBy("_bucket").parquet(data)
        counted = {r["_bucket"]: r["count"] for r in self.spark.read.schema("_bucket int").parquet(data).groupBy("_bucket").count().collect()} if touched else {}  # a row a bucket
        held = (before if of == len(before) else {}) | {b: (n, counted.get(b, 0)) for b in touched}
        self.spark.createDataFrame([(b, k, c) for b, (k, c) in sorted(held.items())], "bucket int, batch int, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{n}")
        self._drop({k for m in (held, before) for k in m.items()}, n)

    def _drop(self, named: set[tuple[int, tuple[int, int]]], n: int) -> None:
        """Deletes buckets of earlier batches that are not among those named, and their manifests but the last."""
        kept = {(k, b) for b, (k, _) in named}
        root, fs = self._fs("data")
        for folder in fs.listStatus(root):
            k = int(folder.getPath().getName().partition("=")[2])
            for own in fs.listStatus(folder.getPath()) if k < n else ():
                name = own.getPath().getName()
                if name.startswith("_bucket=") and (k, int(name.partition("=")[2])) not in kept:
                    fs.delete(own.getPath(), True)
        for k in [k for k in self.batches() if k < n][:-1]:
            fs.delete(self._fs(f"manifests/{k}")[0], True)


def into_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there, appended to a table of files, and read back."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there, into a table in the driver's memory; for results that are small by their nature, such as windows."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def attempts(events: DataFrame, key: str, at: str, most: int = 5) -> DataFrame:
    """A durable count for each key: failures since its last success, `most` at most; needs a key, a time and a boolean `ok`.

    The order of times counts, not that of arrival: a key's rows come in frames and batches in any order. Its state is
    the time of its last success and its `most` latest failures after that, which is all that later rows can change; at
    one time a failure follows a success. Null times and outcomes count for nothing. job_states() has retries and ends.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(ident: tuple, frames, state: GroupState):
        success, failures = state.get if state.exists else (None, [])
        for frame in frames:
            known = frame[frame["_us"].notna() & frame["ok"].notna()]
            passed = known["ok"].astype(bool)
            if passed.any():
                last = int(known.loc[passed, "_us"].max())
                success = last if success is None else max(success, last)
            failed = known.loc[~passed, "_us"].astype("int64").nlargest(most).tolist()
            failures = sorted((t for t in [*failures, *failed] if success is None or t >= success), reverse=True)[:most]
        state.update((success, failures))
        n = len(failures)
        yield pd.DataFrame({key: [ident[0]], "failures": [n], "state": ["failed" if n >= most else "retry" if n else "queued"]})

    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, "ok", F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, failures int, state string", "success long, failures array<long>", "update", GroupStateTimeout.NoTimeout)


def budget_left(requests: DataFrame, at: str, day: str, limit: int) -> DataFrame:
    """Requests of a day (UTC) and how many are left; one row."""
    inside = requests.where(F.to_date(at) == F.lit(day).cast("date"))
    return inside.agg(F.count(F.lit(1)).alias("used"), F.greatest(F.lit(0), F.lit(limit) - F.count(F.lit(1))).alias("remaining"))


def request_rate(requests: DataFrame, key: str, seconds: Column, ident: str, span: int = 60) -> DataFrame:
    """For each request how many of its key lie in the span that it ends. `ident` tells requests apart.

    Requests are counted by their second first; only different seconds of a key meet in a window.
    """
    timed = requests.withColumn("_at", seconds)
    counts = timed.groupBy(key, "_at").agg(F.count(F.lit(1)).alias("_n"))
    recent = Window.partitionBy(key).orderBy("_at").rangeBetween(-(span - 1), Window.currentRow)
    placed = counts.withColumn("in_span", F.sum("_n").over(recent))
    return join_counted(timed, placed, [key, "_at"], "_n", ident).select(*requests.columns, "in_span")


#: Seconds of a key in a stretch: prefix sums run over the seconds of a stretch, and over stretches.
_STRETCH = 3600
#: Requests of a key in a range, in rounds of its limit: running maxima run over a range, and over ranges.
_ROUNDS = 4096


def _numbered(requests: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """`_i`: the 0-based place of each request among its key's by (`at`, `ident`). Requests of one second meet in a task, those of a key do not."""
    second = F.floor(F.col(at) / 1_000_000)
    counts = requests.groupBy(F.col(key).alias("_k"), second.alias("_s")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.floor(F.col("_s") / _STRETCH))
    hours = counts.groupBy("_k", "_h").agg(F.sum("_n").alias("_m"))
    before = hours.select(F.col("_k").alias("_k2"), F.col("_h").alias("_h2"), F.coalesce(F.sum("_m").over(Window.partitionBy("_k").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = counts.withColumn("_c", F.coalesce(F.sum("_n").over(Window.partitionBy("_k", "_h").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = inside.join(before, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_h") == F.col("_h2"))).select("_k", "_s", (F.col("_b") + F.col("_c")).alias("_start"))
    row = F.row_number().over(Window.partitionBy(key, "_second").orderBy(at, ident))
    placed = requests.withColumn("_second", second).withColumn("_row", row)
    return placed.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_second") == F.col("_s"))).withColumn("_i", F.col("_start") + F.col("_row") - 1).drop("_k", "_s", "_start", "_second", "_row")


def admission_times(requests: DataFrame, key: str, at: str, ident: str, limit: int, span: int = 60) -> DataFrame:
    """When each request may start if at most `limit` of a key start in any `span` seconds: all rows with `admitted`.

    `at` and `admitted` are microseconds, `ident` orders requests of one time; a null key is a key, requests without a
    time have none. The i-th request starts at max(at, start of the (i - limit)-th + span). So requests fall into `limit`
    chains, and the k-th of a chain starts at k spans + the largest (at - k spans) up to it: a running maximum, which
    ranges of a key share. Each range adds the largest of those before it; a key may hold any share of all requests.
    """
    if limit < 1:
        raise ValueError("a limit is at least 1")
    wide = span * 1_000_000
    placed = _numbered(requests.where(F.col(at).isNotNull()), key, at, ident)
    k, chain = F.floor(F.col("_i") / limit), F.pmod("_i", F.lit(limit))
    chained = placed.withColumns({"_k": k, "_chain": chain, "_free": F.col(at) - k * wide}).withColumn("_range", F.floor(F.col("_k") / max(1, _ROUNDS // limit)))
    most = chained.groupBy(F.col(key).alias("_key"), F.col("_chain").alias("_c"), F.col("_range").alias("_r")).agg(F.max("_free").alias("_most"))
    ranges = most.withColumn("_before", F.max("_most").over(Window.partitionBy("_key", "_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).drop("_most")
    running = chained.withColumn("_up", F.max("_free").over(Window.partitionBy(key, "_range", "_chain").orderBy("_k")))
    joined = running.join(ranges, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chain") == F.col("_c")) & (F.col("_range") == F.col("_r")))
    timed = joined.select(*requests.columns, (F.greatest("_up", F.coalesce("_before", F.col("_up"))) + F.col("_k") * wide).alias("admitted"))
    return timed.unionByName(requests.where(F.col(at).isNull()).withColumn("admitted", F.lit(None).cast("long")))
