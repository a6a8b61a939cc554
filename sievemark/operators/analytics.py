"""Figures over scan events. All are grouped: one pass for every tenant, with partial sums before the shuffle.

Expected columns: timestamp (Unix ms), llm, risk_level, risk_score, threat_categories, threat_count, user_decision.
A null threat_count counts as 0, a null risk_score as 0, a null list as empty, unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionary import category_color, category_label
from ..functions.timing import DAY_MS

_threats = lambda: F.coalesce("threat_count", F.lit(0)) > 0


def summary(events: DataFrame, *keys: str) -> DataFrame:
    """keys, total, threats, redaction_rate: percent of redacted events (of all) to those with threats, half to even; 0 without threats."""
    out = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(_threats()).alias("threats"), F.count_if(F.coalesce(F.col("user_decision") == "REDACTED", F.lit(False))).alias("_redacted"))
    rate = F.when(F.col("threats") > 0, F.bround(F.col("_redacted") / F.col("threats") * 100)).otherwise(0).cast("bigint")
    return out.select(*keys, "total", "threats", rate.alias("redaction_rate"))


def counts_by(events: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, column, n: null is a value of its own."""
    return events.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))


def top_categories(events: DataFrame, seen: str, *keys: str, limit: int | None = 8) -> DataFrame:
    """keys, category, n, place: the most frequent categories of each group, every naming counted; on ties the one first seen in the order of `seen`, then by name."""
    named = events.select(*keys, F.col(seen).alias("_seen"), F.explode("threat_categories").alias("category")).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"), F.min("_seen").alias("_seen"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_seen", "category"))
    out = named.select(*keys, "category", "n", place.alias("place"))
    return out.where(F.col("place") <= limit) if limit else out


def breakdown(events: DataFrame, seen: str, *keys: str) -> DataFrame:
    """keys, category, n, place, label, color of every category."""
    return top_categories(events, seen, *keys, limit=None).withColumns({"label": category_label(F.col("category")), "color": category_color(F.col("category"))})


def _label(ms: Column) -> Column:
    return F.date_format(F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int")), "MM-dd")


def trend(events: DataFrame, *keys: str, days: int = 30, ms: str = "timestamp") -> DataFrame:
    """keys, label, value: mean risk score of each month-day (years fall together), half to even, the last `days` labels of each group. Rows without time don't count."""
    if not 1 <= days <= 180:
        raise ValueError("days must be from 1 to 180")
    daily = events.where(F.col(ms).isNotNull()).groupBy(*keys, _label(F.col(ms)).alias("label")).agg((F.sum(F.coalesce("risk_score", F.lit(0))) / F.count(F.lit(1))).alias("_mean"))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("label")))
    return daily.select(*keys, "label", F.bround("_mean").cast("bigint").alias("value"), last.alias("_k")).where(F.col("_k") <= days).drop("_k")


def dense_trend(events: DataFrame, today: str, *keys: str, days: int = 30, ms: str = "timestamp") -> DataFrame:
    """keys, label, value for each of the `days` days up to today (a UTC date): mean risk score, half up, 0 on days without events. Groups are those that have any event with a time."""
    day = F.date_from_unix_date(F.floor(F.col(ms) / F.lit(DAY_MS)).cast("int"))
    last = F.lit(today).cast("date")
    rows = events.where(F.col(ms).isNotNull()).select(*keys, day.alias("_day"), "risk_score")
    daily = rows.groupBy(*keys, "_day").agg(F.sum(F.coalesce("risk_score", F.lit(0))).alias("_s"), F.count(F.lit(1)).alias("_n"))
    spine = daily.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("_day"))
    joined = spine.join(daily, [*keys, "_day"], "left")
    return joined.select(*keys, F.date_format("_day", "MM-dd").alias("label"), F.coalesce(F.floor(F.col("_s") / F.col("_n") + 0.5), F.lit(0)).cast("bigint").alias("value"))


def stats(events: DataFrame, *keys: str, ms: str = "timestamp", order: str = "delivery_id") -> DataFrame:
    """keys, total, threats_caught, redaction_rate (half up), clean_streak: how many of the newest events in a row have a threat_count of exactly 0.

    A null threat_count ends the streak. Events of one time: the lower `order` is the newer. Rows without time are the oldest.
    One aggregation finds the newest event that ends the streak, a second counts those after it; nothing is sorted.
    """
    ends = ~F.coalesce(F.col("threat_count") == 0, F.lit(False))
    when = F.struct(F.coalesce(F.col(ms), F.lit(-(2**62))).alias("t"), (-F.col(order)).alias("o"))
    marked = events.select(*keys, when.alias("_when"), ends.alias("_ends"), _threats().alias("_threat"), F.coalesce(F.col("user_decision") == "REDACTED", F.lit(False)).alias("_redacted"))
    last = marked.groupBy(*keys).agg(F.max(F.when(F.col("_ends"), F.col("_when"))).alias("_last"), F.count(F.lit(1)).alias("total"), F.count_if("_threat").alias("threats_caught"), F.count_if("_redacted").alias("_redacted_n"))
    ends = last.select(*(F.col(k).alias(f"_{k}") for k in keys), "_last")
    inside = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    after = marked.join(ends, inside).where(F.col("_last").isNull() | (F.col("_when") > F.col("_last"))).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("clean_streak"))
    rate = F.when(F.col("threats_caught") > 0, F.floor(F.col("_redacted_n") / F.col("threats_caught") * 100 + 0.5)).otherwise(0).cast("bigint")
    return last.join(after, inside, "left").select(*keys, "total", "threats_caught", rate.alias("redaction_rate"), F.coalesce("clean_streak", F.lit(0)).alias("clean_streak"))


def popup_stats(events: DataFrame, since_ms: int, *keys: str, ms: str = "timestamp", order: str = "delivery_id", totals: DataFrame | None = None) -> DataFrame:
    """keys, total_scans, stored_events, today_scans, today_threats, threats_caught, clean_streak, last_threat_at, last_threat_categories; today begins at since_ms. Nulls for no threat.

    totals: keys, total, the lifetime counter; where it has no row or 0, total_scans is the number of events. clean_streak as in stats.
    """
    today = F.coalesce(F.col(ms) >= since_ms, F.lit(False))
    newest = F.struct(F.coalesce(F.col(ms), F.lit(-(2**62))), -F.col(order))
    last = F.max_by(F.when(_threats(), F.struct(F.col(ms).alias("t"), F.col("threat_categories").alias("c"))), F.when(_threats(), newest))
    out = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored_events"), F.count_if(today).alias("today_scans"), F.count_if(today & _threats()).alias("today_threats"), last.alias("_last"))

    def beside(df: DataFrame, *columns: str | Column) -> DataFrame:
        other = df.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *columns)
        inside = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.lit(True))
        return out.join(other, inside, "left").drop(*(f"_of_{k}" for k in keys))

    out = beside(stats(events, *keys, ms=ms, order=order), "threats_caught", "clean_streak")
    if totals is not None:
        out = beside(totals, F.col("total").alias("_ever"))
    ever = F.coalesce(F.nullif("_ever", F.lit(0)), F.col("stored_events")) if totals is not None else F.col("stored_events")
    return out.select(*keys, ever.alias("total_scans"), "stored_events", "today_scans", "today_threats", "threats_caught", "clean_streak", F.col("_last.t").alias("last_threat_at"), F.col("_last.c").alias("last_threat_categories"))


def filtered(events: DataFrame, risk: str = "ALL", llm: str = "ALL") -> DataFrame:
    """Events of a risk level and a service; ALL means any."""
    for column, value in (("risk_level", risk), ("llm", llm)):
        if value != "ALL":
            events = events.where(F.col(column) == value)
    return events


def sorted_history(events: DataFrame, key: str = "timestamp", descending: bool = True) -> DataFrame:
    """Events in the order of a column, nulls last; lists compare as text joined by commas."""
    by = F.array_join(key, ",") if events.schema[key].dataType.typeName() == "array" else F.col(key)
    return events.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last())


def recent(events: DataFrame, n: int = 10, ms: str = "timestamp", order: str = "delivery_id") -> DataFrame:
    """The n newest events; a top-n, not a sort of all."""
    return events.orderBy(F.col(ms).desc_nulls_last(), order).limit(n)


#: Ranges of values that the percentiles of a group are looked for in.
RANGES = 1_000


def _within(values: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, value, n, part: each distinct value of a group, its number of rows, and the part of the group's range (its span cut into RANGES) that it lies in."""
    counted = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ends = counted.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    both = counted.join(ends, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True)))
    span = F.col("_high").cast("double") - F.col("_low").cast("double")
    place = F.when(span > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("_v").cast("double") - F.col("_low").cast("double")) / span * RANGES))).otherwise(0)
    return both.select(*keys, "_v", "_n", F.coalesce(place, F.lit(0)).cast("int").alias("_part"))


def exact_percentiles(values: DataFrame, value: str, percents: list[int], *keys: str) -> DataFrame:
    """keys, p, value: the (floor(p / 100 * n) + 1)-th smallest of n values (the last at most), without interpolation; nulls don't count.

    Equal values are counted first and travel once. A group's range is cut into RANGES parts, whose counts tell in which part
    each rank lies; only the distinct values of that part are put in order, so a hot group is never sorted as a whole.
    """
    given = _within(values, value, keys)
    parts = given.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    order = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.select(*keys, "_part", (F.sum("_in").over(order) - F.col("_in")).alias("_before"), "_in", F.sum("_in").over(Window.partitionBy(*keys)).alias("_all"))
    rank = F.least(F.floor(F.col("p") * F.col("_all") / 100), F.col("_all") - 1)
    asked = parts.select("*", F.explode(F.array(*map(F.lit, percents))).alias("p")).where((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in")))
    asked = asked.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_wanted"), "p", (rank - F.col("_before")).alias("_rest"))
    inside = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_part") == F.col("_wanted"))
    near = given.join(asked, inside)
    to = F.sum("_n").over(Window.partitionBy(*keys, "p").orderBy("_v"))
    return near.select(*keys, "p", F.col("_v").alias("value"), to.alias("_to"), "_n", "_rest").where((F.col("_rest") >= F.col("_to") - F.col("_n")) & (F.col("_rest") < F.col("_to"))).select(*keys, "p", "value")


def oldest(events: DataFrame, n: int = 1, ms: str = "timestamp", order: str = "delivery_id") -> DataFrame:
    """The n oldest events that have a time; a top-n, not a sort of all."""
    return events.where(F.col(ms).isNotNull()).orderBy(ms, order).limit(n)


def timings(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, n, p50, p95, p99, mean and rate (rows a second: 1000 / mean) of times in ms; nulls don't count. A mean of 0 has no rate."""
    mean = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(value)) / F.count(F.lit(1))).cast("double").alias("mean"))
    wide = exact_percentiles(values, value, [50, 95, 99], *keys).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in (50, 95, 99)))
    inside = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    return mean.join(wide, inside).select(*keys, "n", "p50", "p95", "p99", "mean", F.round(F.lit(1000.0) / F.nullif("mean", F.lit(0.0))).cast("bigint").alias("rate"))


def ago(ms: Column, now_ms: Column, wording: str = "short") -> Column:
    """How long ago: 'just now', then minutes, hours and days, as '5m ago' (short) or '5 min ago', '1 hour ago', '3 day(s) ago' (long)."""
    minutes = F.floor((now_ms - ms) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    text = lambda n, s: F.concat(n.cast("string"), F.lit(s))
    if wording == "short":
        return F.when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m ago")).when(hours < 24, text(hours, "h ago")).otherwise(text(days, "d ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, text(minutes, " min ago")).when(hours == 1, "1 hour ago").when(hours < 24, text(hours, " hours ago")).otherwise(text(days, " day(s) ago"))
