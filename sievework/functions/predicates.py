"""Predicates and derived labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.text import general_number


def filled(x: Column, default) -> Column:
    """F8: `default` for null, and for what counts as nothing: the empty string."""
    return F.coalesce(F.when(x != "", x), F.lit(default))


def score_band(score: Column, bands: Iterable[tuple[str, float, float]] = V.SCORE_BANDS) -> Column:
    """the label of the half-open band that holds a score; null outside of all."""
    out = None
    for label, low, high in bands:
        inside = (score >= low) & (score < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def directory_match(term: str, *columns: str, state: Column | None = None, wanted: str | None = None, score: Column | None = None, low: float | None = None, high: float | None = None) -> Column:
    """text in any of the columns taken together, and optionally a state and a range of scores."""
    found = F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term.strip().lower()))
    if wanted is not None:
        found &= state == wanted
    if low is not None:
        found &= score >= low
    if high is not None:
        found &= score <= high
    return found


def stage_of(status: Column, latest_state: Column) -> Column:
    """a final status as it is; else failed if the latest job failed, else pending."""
    return F.when(status.isin("completed", "review", "duplicate"), status).otherwise(F.when(F.coalesce(latest_state, F.lit("")) == "failed", "failed").otherwise("pending"))


def below_threshold(points: Column, threshold: float) -> Column:
    """equality passes, and a threshold of 0 asks nothing."""
    return F.lit(bool(threshold)) & (points < threshold)


def low_score_reason(points: Column, threshold: float) -> Column:
    """why a record needs review, or null."""
    told = F.concat(F.lit("Incompatible resume: rubric score "), general_number(points), F.lit(f"/100 is below the {threshold}/100 review threshold. HR review required."))
    return F.when(below_threshold(points, threshold), told)


def is_source(name: Column, is_folder: Column | None = None, reserved: Iterable[str] = (), generated: Column | None = None) -> Column:
    """F16: neither a folder, nor a reserved name whatever its case, nor one of our own reports."""
    kept = ~F.lower(name).isin(*[r.lower() for r in reserved]) if reserved else F.lit(True)
    for out in (is_folder, generated):
        if out is not None:
            kept &= ~F.coalesce(out, F.lit(False))
    return kept


def hold_active(kind: Column, wanted: str, active: Column, expires: Column, now: Column) -> Column:
    """an active hold of a kind that has not run out by `now`."""
    return (kind == wanted) & active & (expires > now)


def backoff_seconds(attempts: Column, base: float = 15, most: float = 3600) -> Column:
    """V8: base, twice it, four times it and so on, up to a limit."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(62))))


def retry_state(attempts: Column, most: int = 5) -> Column:
    """V8: what a failed attempt leads to; `attempts` counts it."""
    return F.when(attempts >= most, "failed").otherwise("retry")


def following_tick(scheduled: Column, now: Column, interval: float) -> Column:
    """V9: the first tick after `now` on the grid of the schedule; missed ticks become one."""
    return scheduled + (F.floor(F.greatest(F.lit(0.0), now - scheduled) / interval) + 1) * interval


def is_offline(heartbeat: Column, now: Column, seconds: float = 650) -> Column:
    """No heartbeat for longer than that, or none at all."""
    return F.coalesce(now - heartbeat > seconds, F.lit(True))


def missed_scan(last: Column, now: Column, interval: float) -> Column:
    """More than two intervals since the last scan."""
    return F.coalesce(now - last > 2 * interval, F.lit(True))


def by_language(name: Column, language: str = "UNICODE_CI_AI") -> Column:
    """A name that compares and is searched as its language does: by default whatever its case and accents."""
    return F.collate(name, language)


def named_like(name: Column, part: str, language: str = "UNICODE_CI_AI") -> Column:
    """names that hold a part, whatever its case and accents."""
    return F.contains(F.collate(name, language), F.collate(F.lit(part.strip()), language))
