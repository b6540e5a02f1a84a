"""A corpus pipeline over the documents table: each stage applies one operator to all that the stage before it kept.

language    documents whose language is not recognised go
lines       lines that many documents share go from all but one; texts and n_chars change, no document goes
duplicates  one document of each group of near-duplicates stays
mix         documents are put in the order of the source schedule: parts and rows of the result are in that order
pack        documents become token pieces with a place in sequences of 1024, both in the schedule's order

All stages but the last return the columns of documents. Columns may be null: a null text is empty, a null source is a
source, a null identifier a document. Repeated rows are documents like others until the duplicates stage, which keeps one.
Texts are read whole. Other columns travel along, whatever their names. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import delete, drop_since, shared_dir, written
from sievework.llm.langid import fit_language_model, identify
from sievework.llm.line_dedup import dedup_lines
from sievework.llm.mixing import in_mix_order
from sievework.llm.packing import pack_in_order
from sievework.llm.shingle_dedup import drop_similar


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification, learned from the labelled documents; those that it rejects go, with them null texts and those
    without a letter. Of no labelled documents nothing is learned and all go."""
    return identify(docs, fit_language_model(docs)).where(~F.col("rejected")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line deduplication; a document that loses all its lines stays with an empty text."""
    left = dedup_lines(docs, carry=True)
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*[(now[c] if c in now else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by SimHash, checked exactly, and by MinHash what SimHash cannot reach: five-word shingles alike by
    0.8 or more; the document with the smallest identifier stays for its group, one without an identifier only where all are. Texts without words are one group."""
    return drop_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pfair mix of the sources: all documents, in its order; the null source is one of them."""
    return in_mix_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens, in the order that the mix stage wrote; an empty text is one token."""
    return pack_in_order(docs)


STAGES = [("language", language), ("lines", lines), ("duplicates", duplicates), ("mix", mixed), ("pack", pack)]

#: Language identification, fingerprints, the schedule and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, and what it needed on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        mark, path = written(), f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_since(spark, mark)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
