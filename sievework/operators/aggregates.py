"""Aggregates: dense histograms, pivots, weighted scores, activity, usage, health, evaluation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.predicates import score_band


def dense_counts(df: DataFrame, column: Column, values: Iterable[str], name: str = "value") -> DataFrame:
    """A5: a count for each of a fixed list of values, zero where there is none, with its place in the list."""
    wanted = list(values)
    dimension = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(wanted)], f"place int, {name} string")
    counts = df.select(column.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return dimension.join(counts, name, "left").select("place", name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """Scores by band."""
    return dense_counts(df, score_band(F.col(score)), [b[0] for b in V.SCORE_BANDS], "band")


def level_pivot(df: DataFrame, keys: list[str], level: Column, levels: Iterable[str] = tuple(V.LEVEL_FACTORS)) -> DataFrame:
    """Counts of each level by key, as columns, in one pass."""
    return df.groupBy(*keys).agg(*[F.count(F.when(level == v, 1)).alias(v) for v in levels])


def criteria_counts(criteria: DataFrame, findings: DataFrame, key: str, level: Column, levels: Iterable[str] = tuple(V.LEVEL_FACTORS)) -> DataFrame:
    """A row for each criterion of the rubric with all its columns and the counts of each level, zeros where there are no findings."""
    counts = level_pivot(findings, [key], level, levels)
    return criteria.join(counts, key, "left").select(*criteria.columns, *[F.coalesce(v, F.lit(0)).alias(v) for v in levels])


def first_findings(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of several findings on one key the first counts."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_r")).select(*keys, "_r.*")


def average_or_null(column: str, places: int = 1) -> Column:
    """Null where there is nothing to average. Halves are rounded up."""
    return F.round(F.avg(column), places)


def weighted_points(weight: Column, level: Column) -> Column:
    """The points of one finding."""
    factor = None
    for name, share in V.LEVEL_FACTORS.items():
        factor = F.when(level == name, share) if factor is None else factor.when(level == name, share)
    return weight * factor


def daily_activity(df: DataFrame, at: str, last_day: str, measures: dict[str, Column], days: int = 7) -> DataFrame:
    """For each of the days up to `last_day` (UTC) how many rows meet each condition, zeros included."""
    spark = df.sparkSession
    day = spark.range(days).select(F.date_sub(F.lit(last_day).cast("date"), (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))
    first = F.date_sub(F.lit(last_day).cast("date"), days - 1)
    inside = df.where((F.col(at) >= first.cast("timestamp_ntz")) & (F.col(at) < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")))
    counts = inside.groupBy(F.to_date(at).alias("day")).agg(*[F.count(F.when(test, 1)).alias(name) for name, test in measures.items()])
    return day.join(counts, "day", "left").select("day", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in measures])


def usage_summary(events: DataFrame, *, model: str = "model", sections: str = "sections", chars: str = "chars", tokens: str = "tokens", at: str = "at", provider: str = "provider") -> DataFrame:
    """One row; tokens are null if none was ever reported, and so is the last time of no event."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(F.coalesce(sections, F.lit(0))), F.lit(0)).cast("long").alias("sections"),
        F.coalesce(F.sum(F.coalesce(chars, F.lit(0))), F.lit(0)).cast("long").alias("chars"),
        F.sum(tokens).cast("long").alias("tokens_reported"),
        F.max(at).alias("last"),
        F.array_sort(F.collect_set(F.coalesce(provider, F.lit("local")))).alias("providers"),
    )


def usage_by_model(events: DataFrame, model: str = "model", sections: str = "sections") -> DataFrame:
    """Sections by model; a missing model is unknown."""
    named = F.coalesce(F.when(F.col(model) != "", F.col(model)), F.lit("unknown"))
    return events.groupBy(named.alias("model")).agg(F.sum(F.coalesce(sections, F.lit(0))).cast("long").alias("sections"))


def health(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Failed jobs, and active records whose index failed."""
    failed = jobs.agg(F.count(F.when(F.col("state") == "failed", 1)).alias("jobs_failed"))
    index = records.agg(F.count(F.when((F.col("index_status") == "failed") & F.col("active"), 1)).alias("index_failed"))
    return failed.crossJoin(index)  # one row and one row


def recent_failures(jobs: DataFrame, n: int = 5) -> DataFrame:
    """A18, L2."""
    return jobs.where("state = 'failed' AND error IS NOT NULL").orderBy(F.desc("error_at"), F.desc("id")).limit(n).select("application_id", "step", "error", "error_at")


def weighted_confidence(words: DataFrame, page: list[str], text: str = "text", confidence: str = "conf") -> DataFrame:
    """The confidence of a page by the length of its words; words without text or with a negative one do not count."""
    kept = words.where((F.trim(text) != "") & (F.col(confidence) >= 0))
    return kept.groupBy(*page).agg(F.try_divide(F.sum(F.col(confidence) * F.length(text)), F.sum(F.length(text))).alias("confidence"))


def recognised_lines(words: DataFrame, page: list[str], line: list[str], position: str = "word_num", text: str = "text") -> DataFrame:
    """Words of a page put back into lines and lines into a text, in their order. Words that lie by page, as those of
    pages_dealt() do, are not shuffled."""
    kept = words.where(F.trim(text) != "")
    lines = kept.groupBy(*page, *line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda w: w[text]), " ").alias("_line"))
    return lines.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*line, "_line"))), lambda x: x["_line"]), "\n").alias("text"))


def pages_dealt(pages: DataFrame, page: list[str], text: str = "text", most: int = 8 << 20) -> DataFrame:
    """Whole pages dealt to tasks by their keys, about `most` bytes of text to each: words split from them are grouped
    where they are, and in memory."""
    size = pages.agg(F.sum(F.octet_length(text))).first()[0] or 0  # one row
    return pages.repartition(max(1, -(-size // most)), *page)


def evaluated(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Passed where the status is among those allowed, nothing is wrong with the evidence, and an expected score is met.

    `expected`: key, statuses (array), score (null: any). What is expected and missing fails.
    """
    wanted = expected.select(key, "statuses", F.col("score").alias("expected_score"))
    joined = wanted.join(actual, key, "left")
    passed = F.array_contains("statuses", F.col("status")) & (F.coalesce("errors", F.lit(0)) == 0) & (F.col("expected_score").isNull() | F.col("score").eqNullSafe(F.col("expected_score")))
    more = [c for c in actual.columns if c not in (key, "status", "score", "errors")]
    return joined.select(key, "status", "score", *more, F.coalesce(passed, F.lit(False)).alias("passed"))


def acceptance(results: DataFrame, tokens: str | None = None) -> DataFrame:
    """A20, one row: cases, how many passed and are there at all, and whether all did and are; with `tokens` their sum, and
    whether each case that is there reports them. Of no cases all pass, as of none fails."""
    there = F.col("status").isNotNull()
    n, passed, complete = F.count(F.lit(1)), F.count_if("passed"), F.count_if(there)
    sums = [F.sum(tokens).alias("tokens"), (F.count_if(there & F.col(tokens).isNull()) == 0).alias("tokens_reported")] if tokens else []
    return results.agg(n.alias("cases"), passed.alias("passed"), complete.alias("found"), (n == passed).alias("all_passed"), (n == complete).alias("complete"), *sums)


def size_stats(chunks: DataFrame, keys: list[str], text: str, most: int = V.MAX_CHARS) -> DataFrame:
    """Number, least, mean and largest size of passages, and how many are over the limit."""
    n = F.length(text)
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.min(n).cast("long").alias("min_chars"), F.round(F.avg(n), 1).alias("mean_chars"), F.max(n).cast("long").alias("max_chars"), F.count(F.when(n > most, 1)).alias("over_max"))


def coverage(records: DataFrame, readable: Column, indexed: Column) -> DataFrame:
    """How many records were searched, how many have no text and how many no current index."""
    return records.agg(F.count(F.lit(1)).alias("searched"), F.count(F.when(~F.coalesce(readable, F.lit(False)), 1)).alias("unreadable"), F.count(F.when(~F.coalesce(indexed, F.lit(False)), 1)).alias("unindexed"))


def unique_groups(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Keys that name exactly one value."""
    return df.groupBy(key.alias("key")).agg(F.collect_set(value).alias("values")).where(F.size("values") == 1).select("key", F.col("values")[0].alias("value"))
