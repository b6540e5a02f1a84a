"""The four sheets of a report, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.nested import joined, looked_up
from sievework.functions.predicates import filled
from sievework.functions.text import iso_utc, sheet_safe, source_link
from sievework.operators.aggregates import weighted_points


def _named(df: DataFrame, titles: tuple[str, ...], columns: list) -> DataFrame:
    return df.select(*[c.alias(t) for c, t in zip(columns, titles, strict=True)])


def ranked_sheet(ranking: DataFrame) -> DataFrame:
    """One row for each ranked record. `ranking`: id, name, rank, tie, score, status, assessed_at, file_id, findings, and
    criteria as a map from id to description."""
    f = F.col("findings")

    def told(x):
        return looked_up(F.col("criteria"), x.criterion_id, F.lit(""))

    positive = F.filter(f, lambda x: x.level != "not_demonstrated")
    quotes = F.flatten(F.transform(positive, lambda x: F.transform(x.evidence, lambda e: e.quote)))
    return _named(ranking.orderBy(F.desc("score"), "id"), V.RANKED_SHEET, [
        F.col("rank"), F.when(F.col("tie"), "Tie").otherwise(""), F.col("id"), filled(F.col("name"), "Name not provided"), F.col("score"),
        joined(positive, told), F.array_join(quotes, "; "), joined(f, lambda x: x.explanation, lambda x: x.level == "supported"),
        joined(f, lambda x: F.concat(told(x), F.lit(": "), x.missing_information), lambda x: x.level != "supported"),
        F.col("status"), iso_utc("assessed_at"), source_link("file_id"),
    ])


def evidence_sheet(ranking: DataFrame) -> DataFrame:
    """One row for each citation of each finding, and one for a finding without any. `ranking` as above, with
    criteria as a map from id to struct(description, weight) and sections as a map from id to location."""
    found = ranking.select("id", "sections", "criteria", F.posexplode("findings").alias("_i", "f"))
    cited = found.select("*", F.posexplode_outer("f.evidence").alias("_j", "e"))
    criterion = F.try_element_at("criteria", F.col("f.criterion_id"))
    return _named(cited.orderBy("id", "_i", "_j"), V.EVIDENCE_SHEET, [
        F.col("id"), criterion["description"], criterion["weight"], weighted_points(criterion["weight"], F.col("f.level")), F.col("f.explanation"),
        F.coalesce("e.quote", F.lit("")), F.coalesce(F.try_element_at("sections", F.coalesce("e.section_id", F.lit(""))), F.lit("")),
    ])


def review_sheet(records: DataFrame) -> DataFrame:
    """Active records that are not completed, or duplicates, and why."""
    copy = F.concat(F.lit("Duplicate of application "), F.col("duplicate_of").cast("string"))
    why = F.coalesce(F.when(F.col("review_reason") != "", F.col("review_reason")), F.when(F.col("duplicate_of") != 0, copy), F.lit("Pending assessment"))
    kept = records.where("active AND (status <> 'completed' OR duplicate_of IS NOT NULL)")
    return _named(kept, V.REVIEW_SHEET, [F.col("id"), F.col("filename"), F.col("status"), why, source_link("file_id")])


def log_sheet(jobs: DataFrame, records: DataFrame, assessments: DataFrame, revision: int) -> DataFrame:
    """Every job, with the model of its assessment if there is one: one join, not a look-up for each row."""
    models = assessments.select("application_id", "version", "rubric_id", "model")
    rows = jobs.join(records.select(F.col("id").alias("application_id"), "file_id"), "application_id").join(models, ["application_id", "version", "rubric_id"], "left")
    return _named(rows.orderBy("id"), V.LOG_SHEET, [
        F.col("file_id"), F.col("application_id"), F.col("version"), F.col("rubric_id"), F.coalesce("model", F.lit("")), F.col("state"), F.col("step"), F.col("attempts"),
        iso_utc("updated"), iso_utc("error_at"), F.coalesce("error", F.lit("")), F.lit(revision),
    ])


def safe_sheet(df: DataFrame) -> DataFrame:
    """T12 over every text column."""
    return df.select(*[sheet_safe(f"`{f.name}`").alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in df.schema])
