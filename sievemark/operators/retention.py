"""A bounded store of events: a full store drops its oldest event, by time, before it takes the next arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 500


def bounded_store(events: DataFrame, *keys: str, arrival: str = "delivery_id", stamp: str = "timestamp", id: str = "delivery_id", capacity: int = CAPACITY) -> DataFrame:
    """What the store of each group holds after all arrivals: the last arrival, whatever its time, and of the others the capacity - 1 newest by (stamp, id). Null times are the oldest.

    The last arrival is found by an aggregation; the others are ranked with a limit that Spark applies within each task before
    the shuffle (a group limit), so a group's rows beyond the capacity don't travel.
    """
    if keys:
        tagged = events.join(events.groupBy(*keys).agg(F.max(arrival).alias("_last")), list(keys))
    else:
        tagged = events.withColumn("_last", events.agg(F.max(arrival)).scalar())
    newest = tagged.where(F.col(arrival) == F.col("_last")).drop("_last")
    order = Window.partitionBy(*keys).orderBy(F.col(stamp).desc_nulls_last(), F.col(id).desc())
    rest = tagged.where(F.col(arrival) != F.col("_last")).drop("_last").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= capacity - 1).drop("_rank")
    return newest.unionByName(rest)


def with_defaults(events: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Events as they are stored: an id and a time where they have none, no nulls in lists and counts. Missing columns are added."""
    now = F.lit(now_ms).cast("bigint") if now_ms is not None else F.unix_millis(F.current_timestamp())
    has = lambda c: F.col(c) if c in events.columns else F.lit(None)
    return events.withColumns(
        {
            "id": F.coalesce(has("id").cast("string"), F.uuid()),
            "timestamp": F.coalesce(has("timestamp").cast("bigint"), now),
            "threat_categories": F.coalesce(has("threat_categories").cast("array<string>"), F.array().cast("array<string>")),
            "threat_count": F.coalesce(has("threat_count").cast("int"), F.lit(0)),
            "pattern_match_count": F.coalesce(has("pattern_match_count").cast("int"), F.lit(0)),
        }
    )


def soft_deleted(patterns: DataFrame, org: str, id: str) -> DataFrame:
    """The patterns, with that of this organisation and id no longer active; those of others stay."""
    hit = F.coalesce((F.col("org_id") == org) & (F.col("id") == id), F.lit(False))
    return patterns.withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
