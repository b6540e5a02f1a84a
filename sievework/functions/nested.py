"""Nested rows: findings, citations, rubrics and claims as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import is_identifier

CRITERION = "struct<id:string,description:string,weight:double>"
FINDING = "struct<criterion_id:string,level:string,evidence:array<struct<section_id:string,quote:string>>,missing_information:string,explanation:string>"


def parsed(json: Column, schema: str) -> Column:
    """A typed value from JSON; null where it is not well formed or not an object of that type."""
    return F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, schema))


def first_of(items: Column, test) -> Column:
    """The first item that passes, or null."""
    return F.try_element_at(F.filter(items, test), F.lit(1))


def looked_up(pairs: Column, key: Column, default: Column) -> Column:
    """The value of a key in a map, or `default`."""
    return F.coalesce(F.try_element_at(pairs, key), default)


def joined(items: Column, text, test=None, separator: str = "; ") -> Column:
    """Texts of the items that pass, put together."""
    kept = F.filter(items, test) if test else items
    return F.array_join(F.transform(kept, text), separator)


def is_subset(a: Column, b: Column) -> Column:
    """U5."""
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def unique(a: Column) -> Column:
    """A17."""
    return F.size(a) == F.size(F.array_distinct(a))


def is_grounded(cited: Column, known: Column) -> Column:
    """A claim cites something, and nothing that was not given."""
    return (F.size(cited) > 0) & F.forall(F.array_distinct(cited), lambda c: F.coalesce(F.array_contains(known, c), F.lit(False)))


def grounded_claims(claims: Column, known: Column) -> Column:
    """(kept, dropped) of claims<text, citation_ids>."""
    kept = F.filter(claims, lambda c: is_grounded(c.citation_ids, known))
    return F.struct(kept.alias("kept"), (F.size(claims) - F.size(kept)).alias("dropped"))


def weighted_score(criteria: Column, findings: Column, factors: dict[str, float]) -> Column:
    """Weights times the factors of the levels found, to four places."""
    factor = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    level = F.map_from_entries(F.transform(findings, lambda f: F.struct(f.criterion_id, f.level)))
    return F.round(F.aggregate(criteria, F.lit(0.0), lambda s, c: s + c.weight * F.coalesce(F.try_element_at(factor, F.try_element_at(level, c.id)), F.lit(0.0))), 4)


def rubric_errors(criteria: Column) -> Column:
    """What is wrong with a rubric: number, identifiers, repeats, weights, their sum."""
    tests = [
        (F.coalesce(F.size(criteria).between(1, 15), F.lit(False)), "1 to 15 criteria"),
        (F.forall(criteria, lambda c: F.coalesce(is_identifier(c.id), F.lit(False))), "identifier"),
        (unique(F.transform(criteria, lambda c: c.id)), "identifiers repeat"),
        (F.forall(criteria, lambda c: F.coalesce((c.weight > 0) & (c.weight <= 100), F.lit(False))), "weight"),
        (F.abs(F.aggregate(criteria, F.lit(0.0), lambda s, c: s + F.coalesce(c.weight, F.lit(0.0))) - 100) <= 1e-5, "weights do not add up to 100"),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in tests]))


def evidence_errors(findings: Column, criterion_ids: Column, sections: Column, covered: Column, seen: Column) -> Column:
    """What is wrong with an assessment; every rule is tried. `sections`: map of section id to text."""
    answered = F.transform(findings, lambda f: f.criterion_id)
    everything = F.map_keys(sections)
    once = F.when(~(unique(answered) & same_set(answered, criterion_ids)), F.lit("Address each rubric criterion exactly once"))
    read = F.when(~(same_set(covered, everything) & is_subset(everything, seen)), F.lit("Read and cover all extracted sections"))

    def of_finding(f: Column) -> Column:
        bare = F.when((f.level != "not_demonstrated") & (F.size(f.evidence) == 0), F.concat(f.criterion_id, F.lit(": positive match needs evidence")))

        def misquoted(c: Column) -> Column:
            text = F.coalesce(F.try_element_at(sections, c.section_id), F.lit(""))
            return F.when(~F.array_contains(seen, c.section_id) | ~F.contains(text, c.quote), F.concat(f.criterion_id, F.lit(": citation is not in the inspected source section")))

        return F.concat(F.array(bare), F.transform(f.evidence, misquoted))

    return F.array_compact(F.concat(F.array(once, read), F.flatten(F.transform(findings, of_finding))))
