"""Questions over records: a question becomes a specification on the driver, and the specification a plan.

The specification is about one line of text. All that touches records is a DataFrame plan: filters, joins and, where
words find nothing, nearest vectors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import vocabulary as V
from sievework.functions.text import has_term, source_link
from sievework.functions.vectors import cosine, norm

#: In the order in which a question's status is looked for.
_STATUSES = ("completed", "review", "queued", "duplicate", "failed")
_ORDINALS = (("second", 2), ("first", 1), ("third", 3))


def _word(pattern: str, text: str) -> bool:
    return re.search(rf"\b(?:{pattern})\b", text) is not None


@dataclass(frozen=True)
class QuerySpec:
    """What a question asks for."""

    question: str
    terms: tuple[str, ...] = ()
    any_term: bool = False
    wants_list: bool = False
    status: str | None = None
    ranks: bool = False
    ordinal: int | None = None
    compares: bool = False
    level: str | None = None
    top_three: bool = False
    selected: tuple = field(default=())

    @property
    def structured(self) -> bool:
        return bool(self.ranks or self.selected or self.wants_list or self.status or self.level)


def parse_question(question: str, group_name: str = "", selected: tuple = ()) -> QuerySpec:
    """T8-T10. Quoted phrases replace words; words of the group's own name are no terms; `or` anywhere means any of them."""
    if not isinstance(question, str) or not question.strip() or len(question) > 1000:
        raise ValueError("a question has 1 to 1000 characters")
    low = question.lower()
    stop = {*V.QUESTION_STOP_WORDS, *re.findall(r"\w+", group_name.lower())}
    words = (w.rstrip(".") for w in re.findall(r"[\w+#.]+", low))
    terms = re.findall(r'"([^"]+)"', low) or [w for w in words if len(w) > 1 and w not in stop and not w.isdigit()]
    ranks = _word("rank|ranked|score|scores|compare|top", low)
    level = "not_demonstrated" if "not demonstrated" in low else "partial" if _word("partial|partially supported", low) else "supported" if _word("supported", low) else None
    return QuerySpec(
        question=question, terms=tuple(terms[:12]), any_term=_word("or", low),
        wants_list=re.search(r"\b(list|show)\b.*\b(all )?(applicants|candidates|applications)\b", low) is not None,
        status=next((s for s in _STATUSES if _word(s, low)), None), ranks=ranks,
        ordinal=next((n for w, n in _ORDINALS if _word(w, low)), None) if ranks else None,
        compares="compare" in low, level=level, top_three=_word("top (?:three|3)", low), selected=tuple(selected),
    )


@dataclass
class Frames:
    """What a question is asked of, one group's or with `scope` many: records, their passages, their ranking, findings.

    records: id, name, status, duplicate_of, file_id, job_state. sections: record_id, section_id, location, text.
    ranking: id, score, rank, tie. findings: record_id, criterion_id, level, evidence. criteria: id, description.
    vectors: record_id, section_id, location, text, embedding.
    """

    records: DataFrame
    sections: DataFrame
    ranking: DataFrame
    findings: DataFrame | None = None
    criteria: DataFrame | None = None
    vectors: DataFrame | None = None


def compared(records: DataFrame, question: str) -> DataFrame:
    """Ids of the records whose whole name is in the question or, if there are none, whose first name is and is the only such one."""
    low = F.lit(question.lower())
    named = records.where("name <> ''").select("id", F.lower("name").alias("n"), F.element_at(F.split(F.lower(F.trim("name")), r"\s+"), 1).alias("first"))
    whole = named.where(F.contains(low, F.col("n"))).select("id")
    lone = named.groupBy("first").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k")).where("k = 1")
    literal = F.replace(F.col("first"), F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # a name may hold what ends a quotation
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), literal, F.lit(r"\E(?!\w)"))
    by_first = lone.where(F.rlike(low, quoted)).select("id")
    return whole.union(by_first.join(_is_empty(whole), F.col("none")).select("id"))


def _is_empty(ids: DataFrame) -> DataFrame:
    """One row: whether there are none."""
    return ids.agg((F.count(F.lit(1)) == 0).alias("none"))


def _matching(spec: QuerySpec, frames: Frames) -> DataFrame | None:
    """Ids of the records that meet the terms; None if there is nothing to meet."""
    if not spec.terms:
        return None
    if spec.level:
        if frames.findings is None or frames.criteria is None:
            return frames.records.where(F.lit(False)).select(F.col("id").alias("record_id"))
        described = F.concat_ws(" ", F.translate("id", "_", " "), "description")
        asked = frames.criteria.select(F.col("id").alias("criterion_id"), *[has_term(described, t).alias(f"t{i}") for i, t in enumerate(spec.terms)])
        hits = frames.findings.where(F.col("level") == spec.level).join(F.broadcast(asked), "criterion_id")  # a rubric has 15 criteria at most
    else:
        hits = frames.sections.select("record_id", *[has_term("text", t).alias(f"t{i}") for i, t in enumerate(spec.terms)])
    met = hits.groupBy("record_id").agg(*[F.max(f"t{i}").alias(f"t{i}") for i in range(len(spec.terms))])
    tests = [F.col(f"t{i}") for i in range(len(spec.terms))]
    whole = tests[0]
    for t in tests[1:]:
        whole = whole | t if spec.any_term else whole & t
    return met.where(whole).select("record_id")


def plan(spec: QuerySpec, frames: Frames) -> DataFrame:
    """Cards: id, name, status, score, rank, tie, link, place, in the order of the answer. See tie_beyond_limit() for ties."""
    out = frames.records.join(frames.ranking.select("id", "score", "rank", "tie"), "id", "left")
    chosen = bool(spec.selected)
    if chosen:
        out = out.where(F.col("id").isin(*spec.selected))
    elif spec.compares:
        ids, chosen = compared(frames.records, spec.question), True
        if spec.ordinal:  # who holds the rank is meant; names only if nobody does
            there = frames.ranking.where(F.col("rank") == spec.ordinal).select("id").join(frames.records.select("id"), "id", "left_semi")
            ids = there.union(ids.join(_is_empty(there), F.col("none")).select("id"))
        out = out.join(ids, "id", "left_semi")
    elif spec.ordinal:
        out, chosen = out.where(F.col("rank") == spec.ordinal), True
    if spec.compares:  # of fewer than two there is nothing to compare
        enough = F.lit(len(set(spec.selected)) >= 2) if spec.selected else None
        out = out.where(enough) if enough is not None else out.join(ids.agg((F.count(F.lit(1)) >= 2).alias("enough")), F.col("enough")).drop("enough")  # one row
    if spec.status:
        out = out.where(F.col("job_state") == "failed" if spec.status == "failed" else F.col("status") == spec.status)
    if not chosen and not spec.wants_list:
        out = out.where("duplicate_of IS NULL")
    if spec.ranks and not spec.compares and not chosen:
        out = out.where("rank IS NOT NULL")
    if not chosen:
        met = _matching(spec, frames)
        if met is not None:
            out = out.join(met, out.id == met.record_id, "left_semi")
        elif not spec.structured:
            out = out.where(F.lit(False))
    order = [F.col("rank").asc_nulls_last(), F.col("id")] if spec.ranks else [F.col("id")]
    cards = out.select("id", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("Name not provided")).alias("name"), "status", "score", "rank", F.coalesce("tie", F.lit(False)).alias("tie"), source_link("file_id").alias("link"))
    return cards.orderBy(*order).limit(3) if spec.top_three else cards.orderBy(*order)


def citations(spec: QuerySpec, cards: DataFrame, frames: Frames) -> DataFrame:
    """What backs each card: findings' quotes for structured questions, else the passages that hold a term."""
    ids = cards.select(F.col("id").alias("record_id"))
    places = frames.sections.select("record_id", "section_id", "location")
    if spec.structured:
        if frames.findings is None:
            return frames.sections.where(F.lit(False)).select("record_id", "section_id", F.col("text").alias("quote"), "location")
        quotes = frames.findings.join(ids, "record_id", "left_semi").select("record_id", F.explode("evidence").alias("e")).select("record_id", "e.section_id", "e.quote")
        return quotes.join(places, ["record_id", "section_id"], "left").select("record_id", "section_id", "quote", F.coalesce("location", F.lit("")).alias("location"))
    any_term = F.lit(False)
    for t in spec.terms:
        any_term |= has_term("text", t)
    return frames.sections.where(any_term).join(ids, "record_id", "left_semi").select("record_id", "section_id", F.col("text").alias("quote"), "location")


def nearest(vectors: DataFrame, query: list[float], k: int = 8, scope: Column | None = None, vector: str = "embedding", ident: str = "section_id") -> DataFrame:
    """V2, L4: the k nearest by cosine among those in scope, exactly; ties by identifier. The query's norm is taken once."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    inside = vectors.where(scope) if scope is not None else vectors
    return inside.withColumn("similarity", cosine(F.col(vector), q, norm(F.col(vector)), length)).orderBy(F.desc("similarity"), F.asc(ident)).limit(k)


def in_scope(vectors: DataFrame, records: DataFrame, model: str | None = None) -> DataFrame:
    """Vectors that may answer: of records that are there and no duplicates, of their present version if both frames
    have one, and made by `model` if one is named."""
    alive = records.where("duplicate_of IS NULL")
    same = [c for c in ("version",) if c in vectors.columns and c in records.columns]
    own = vectors.where(F.col("model") == model) if model is not None else vectors
    return own.join(alive.select(F.col("id").alias("record_id"), *same), ["record_id", *same], "left_semi").select(*vectors.columns)


def answer(spec: QuerySpec, frames: Frames, embed=None, k: int = 8, model: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(cards, citations, mode). Nearest passages in scope come in only if words found nothing and nothing structured was asked."""
    cards = plan(spec, frames)
    if spec.structured or embed is None or frames.vectors is None or cards.limit(1).count():
        mode = "database scores and cited findings" if spec.structured else f"all extracted CVs: exact terms, {'OR' if spec.any_term else 'AND'} match"
        return cards, citations(spec, cards, frames), mode
    found = nearest(in_scope(frames.vectors, frames.records, model), embed(spec.question), k)
    near = found.groupBy("record_id").agg(F.max("similarity").alias("best"))
    cards = near.join(frames.records, near.record_id == frames.records.id).join(frames.ranking.select("id", "score", "rank", "tie"), "id", "left")
    named = cards.orderBy(F.desc("best"), "id").select("id", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("Name not provided")).alias("name"), "status", "score", "rank", F.coalesce("tie", F.lit(False)).alias("tie"), source_link("file_id").alias("link"))
    return named, found.select("record_id", "section_id", F.col("text").alias("quote"), "location"), "semantic excerpt suggestions"


def tie_beyond_limit(ranking: DataFrame, most: int = 3) -> DataFrame:
    """Whether the card after the last one shown has its rank; one row, from the first few cards only."""
    first = ranking.orderBy(F.col("rank").asc_nulls_last(), "id").limit(most + 1).withColumn("_n", F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "id")))
    return first.agg(F.coalesce(F.max(F.when(F.col("_n") == most, F.col("rank"))) == F.max(F.when(F.col("_n") == most + 1, F.col("rank"))), F.lit(False)).alias("tie_beyond_limit"))


def numbered_passages(cited: DataFrame, *order: str) -> DataFrame:
    """Citations with running identifiers c1, c2 and so on, by `order`, which tells them apart.

    Rows are dealt to ranges of the order, numbered within, and a range starts where the counts of those before it end;
    so no task sees all of them. `cited` is stored in a folder that all tasks share, as ranges are to stay what they are.
    """
    from sievework.plans.session import workspace

    spark, path = cited.sparkSession, workspace(cited.sparkSession, "citations") + "/rows"
    dealt = cited.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = held.withColumn("_i", within).join(starts, F.col("_part") == F.col("_p"))
    return numbered.withColumn("citation_id", F.concat(F.lit("c"), (F.col("_start") + F.col("_i")).cast("string"))).select(*cited.columns, "citation_id")
