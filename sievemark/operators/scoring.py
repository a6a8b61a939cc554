"""Levels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_level(score: Column) -> Column:
    """SAFE to 30, CAUTION to 60, HIGH beyond; null for null."""
    return F.when(score <= 30, "SAFE").when(score <= 60, "CAUTION").when(score > 60, "HIGH")


def composite_score(scores: Column) -> Column:
    """The highest of an array of scores, 5 more for each further one, at most 100; 0 for none."""
    return F.when(F.size(scores) > 0, F.least(F.lit(100), F.array_max(scores) + 5 * (F.size(scores) - 1))).otherwise(F.lit(0)).cast("int")


def by_severity(threats: Column, score: str = "score", tie: str = "ord") -> Column:
    """Threats, the severest first; ties by `tie`."""
    return F.array_sort(threats, lambda a, b: F.when(a[score] != b[score], b[score] - a[score]).otherwise(a[tie] - b[tie]))


#: How the levels, the choices and the preview are named in a dialog.
LEVEL_LABELS = {"SAFE": "SAFE", "CAUTION": "CAUTION", "HIGH": "HIGH RISK"}
DECISION_LABELS = {"REDACTED": "Redact & Send", "SENT_ANYWAY": "Send Anyway", "CANCELLED": "Cancel"}


def risk_label(level: Column, score: Column) -> Column:
    """'HIGH RISK · 90/100': the level's name, an unknown level itself, and the score; null if either is null."""
    names = F.create_map(*(F.lit(x) for kv in LEVEL_LABELS.items() for x in kv))
    return F.concat(F.coalesce(names[level], level), F.lit(" · "), score.cast("string"), F.lit("/100"))


def count_label(count: Column) -> Column:
    """'×2' for more than one match, an empty text otherwise."""
    return F.when(count > 1, F.concat(F.lit("×"), count.cast("string"))).otherwise("")


def bar_width(score: Column) -> Column:
    """Percent of the bar that shows a score: 4 at least; null for null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(4), score.cast("int")))
