"""Export of events as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "timestamp,llm,riskLevel,riskScore,threatCategories,threatCount,userDecision,processingTimeMs"


def iso_utc(ms: Column) -> Column:
    """Unix ms as YYYY-MM-DDTHH:MM:SS.mmmZ, whatever the session's time zone; null for null."""
    day = F.floor(ms / F.lit(86_400_000))
    rest = ms - day * F.lit(86_400_000)
    part = lambda v, w: F.lpad(v.cast("bigint").cast("string"), w, "0")
    clock = F.concat(part(F.floor(rest / 3_600_000), 2), F.lit(":"), part(F.floor(rest / 60_000) % 60, 2), F.lit(":"), part(F.floor(rest / 1000) % 60, 2), F.lit("."), part(rest % 1000, 3))
    return F.concat(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def csv_lines(events: DataFrame, ms: str = "timestamp") -> DataFrame:
    """line: one for each event. Lists are joined by '|' and quoted, nothing else is quoted or escaped; nulls are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.coalesce(F.array_join("threat_categories", "|"), F.lit("")), F.lit('"'))
    return events.select(F.concat_ws(",", F.coalesce(iso_utc(F.col(ms)), F.lit("")), text("llm"), text("risk_level"), text("risk_score"), quoted, text("threat_count"), text("user_decision"), text("processing_time_ms")).alias("line"))


def write_csv(events: DataFrame, path: str, ms: str = "timestamp") -> None:
    """Writes the lines as text files, one a task, and HEADER into a file of its own beside them, so that nothing is gathered in one task."""
    csv_lines(events, ms).write.mode("overwrite").text(f"{path}/rows")
    events.sparkSession.createDataFrame([(HEADER,)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
