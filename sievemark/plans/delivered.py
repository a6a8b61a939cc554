"""The deliveries of scan events, stored and not yet stored, and the rows that are kept of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.idents import ident_key
from ..operators.seen import first_deliveries
from ..sources.tables import table

#: Organisations are joined by broadcast up to so many; beyond it by a shuffle.
BROADCAST_ORGS = 100_000


def stored(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """delivery_id, org_id, ident (as bytes) and the named columns of sync_events."""
    rows = table(spark, folder, "sync_events")
    return rows.select("delivery_id", "org_id", ident_key(F.col("id")).alias("ident"), *columns)


def waiting(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """delivery_id, org_id, ident (as bytes) and the named columns of event_in, without rows whose key hash no organisation has."""
    orgs = table(spark, folder, "organizations", "api_key_hash", F.col("id").alias("org_id")).where("api_key_hash IS NOT NULL")
    if orgs.limit(BROADCAST_ORGS + 1).count() <= BROADCAST_ORGS:
        orgs = F.broadcast(orgs)
    return table(spark, folder, "event_in").join(orgs, "api_key_hash").select("delivery_id", "org_id", ident_key(F.col("event_id")).alias("ident"), *columns)


def kept(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """delivery_id, org_id and the named columns of the rows of sync_events that aren't further copies of a message.

    The first deliveries are found on the keys alone, by hash; the rows with their other columns are then picked by their unique
    delivery_id, which no hot key can skew. A message whose first delivery still waits keeps no stored row.
    """
    first = first_deliveries(stored(spark, folder).unionByName(waiting(spark, folder)), "org_id", "ident", "delivery_id")
    return table(spark, folder, "sync_events", "delivery_id", "org_id", *columns).join(first, "delivery_id", "left_semi")
