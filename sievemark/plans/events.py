"""Queries on delivered events: p1 (repeated deliveries), p2 (late events) and p5 (rolling totals), with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panes, rolling, seen
from ..session import scratch
from ..sources.tables import table
from .delivered import kept, stored, waiting


def _deduplicated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The deliveries and what was admitted of them, in the order in which they came: the stored log, then what waits."""
    store = seen.SeenBitmaps(spark, scratch(spark, "seen"))
    batches = [stored(spark, folder), waiting(spark, folder)]
    first, second = (store.admit(b, "org_id", "ident", "delivery_id") for b in batches)
    return batches[0].unionByName(batches[1]).select("delivery_id", "ident"), first.unionByName(second)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """delivery_id of each further copy of a message."""
    batches, admitted = _deduplicated(spark, folder)
    return seen.further_copies(batches, admitted, "ident", "delivery_id")


def p1_admitted(spark: SparkSession, folder: str) -> DataFrame:
    """delivery_id of the one delivery of each message, those without identifier included."""
    batches, admitted = _deduplicated(spark, folder)
    return admitted.unionByName(batches.where("ident IS NULL").select("delivery_id"))


#: The most batches that the queries of problem 2 make of a log.
MOST_BATCHES = 6


def _paned(spark: SparkSession, folder: str, size: int) -> panes.PaneStore:
    """A store into which the kept rows of sync_events have come by month of arrival: successive months together if there are more than MOST_BATCHES."""
    month = F.trunc("created_at", "month")
    months = sorted(r[0] for r in table(spark, folder, "sync_events", "created_at").where("created_at IS NOT NULL").select(month).distinct().toLocalIterator())
    starts = months[:: -(-len(months) // MOST_BATCHES) or 1]
    number = sum(((month >= F.lit(m)).cast("int") for m in starts[1:]), F.lit(0))
    rows = panes.sliced(kept(spark, folder, "timestamp", "created_at", "risk_score")).where("kind IS NOT NULL")
    rows.select("delivery_id", "org_id", "risk_score", "pane", "arrived", "kind", number.alias("batch")).write.partitionBy("batch").option("compression", "zstd").parquet(to := scratch(spark, "sliced"))
    written = spark.read.schema("delivery_id bigint, org_id string, risk_score smallint, pane date, arrived date, kind string, batch int").parquet(to)
    store = panes.PaneStore(spark, scratch(spark, "panes"), ["org_id"], size)
    for k in range(max(1, len(starts))):
        store.apply(written.where(F.col("batch") == k), "risk_score", "delivery_id", tag=("sync_events", k))
    return store


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """delivery_id and kind of the kept rows that came late or beyond the cut-off, as the store of panes reported them."""
    return _paned(spark, folder, 1).reported()


def p2_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The current figures of each organisation and day, with the number of the last revision."""
    return _paned(spark, folder, 1).current().select("org_id", F.col("window_end").cast("string").alias("day"), "revision", "n", "total")


def p2_weekly_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every emission of the windows of seven panes."""
    return _paned(spark, folder, 7).emissions().select("org_id", F.col("window_end").cast("string").alias("window_end"), F.col("arrived").cast("string").alias("arrived"), "revision", "n", "total")


#: The range of days that p5 reports, and how many days a step of its state takes in.
FIRST_DAY, LAST_DAY, STEP = dt.date(2025, 4, 1), dt.date(2025, 6, 30), 30


def _rolling(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the last day: stepped on by what came in time, then corrected by the late rows.

    The first day's 30 days begin 29 days before it; what happened earlier or later is in no period that is reported.
    """
    start = FIRST_DAY - dt.timedelta(days=max(rolling.PERIODS) - 1)
    rows = panes.sliced(kept(spark, folder, "timestamp", "created_at", "risk_score"))
    # a row without created_at can't be cut: it counts as in time
    rows = rows.where(F.col("pane").between(F.lit(start), F.lit(LAST_DAY)) & (F.coalesce("kind", F.lit("in_time")) != "cut")).withColumn("late", F.coalesce(F.col("kind") == "late", F.lit(False)))
    amounts = rows.groupBy(F.col("org_id").alias("entity"), F.col("pane").alias("day"), "late").agg(F.sum(F.coalesce("risk_score", F.lit(0))).cast("bigint").alias("total"), F.count(F.lit(1)).alias("n"))
    amounts.write.parquet(to := scratch(spark, "amounts"))
    amounts = spark.read.parquet(to)
    store = rolling.RollingStore(spark, scratch(spark, "rolling"), start)
    entities = table(spark, folder, "organizations", F.col("id").alias("entity"))
    while store.last_day() < LAST_DAY:
        store.advance(amounts.where("NOT late"), entities, min(LAST_DAY, store.last_day() + dt.timedelta(days=STEP)))
    store.correct(amounts.where("late").groupBy("entity", "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    return store.state().where(F.col("day") >= F.lit(FIRST_DAY))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Organisations and days on which the last 7 days hold at least half of a positive total of the last 30."""
    return _rolling(spark, folder).where("total_30 > 0 AND 2 * total_7 >= total_30").select(F.col("entity").alias("org_id"), F.col("day").cast("string").alias("day"))


def p5_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals, numbers of rows, and averages by day and by row of the last 7 and 30 days, for every organisation and day."""
    per = [F.round(F.col(f"total_{w}") / F.lit(w), 6).alias(f"avg_day_{w}") for w in (7, 30)] + [F.round(F.col(f"total_{w}") / F.nullif(F.col(f"n_{w}"), F.lit(0)), 6).alias(f"avg_row_{w}") for w in (7, 30)]
    return _rolling(spark, folder).select(F.col("entity").alias("org_id"), F.col("day").cast("string").alias("day"), "total_7", "n_7", "total_30", "n_30", *per)


QUERIES = {f.__name__: f for f in (p1_found, p1_admitted, p2_found, p2_daily, p2_weekly_revisions, p5_found, p5_rolling)}

#: The kept rows and their times, for the SQL of other modules too.
DELIVERIES_SQL = """
deliveries AS (
  SELECT delivery_id, org_id, id AS ident FROM sync_events
  UNION ALL SELECT e.delivery_id, o.id, e.event_id FROM event_in e JOIN organizations o ON e.api_key_hash = o.api_key_hash),
numbered AS (
  SELECT delivery_id, row_number() OVER (
    PARTITION BY org_id, CASE WHEN ident IS NULL OR ident = '' THEN CAST(delivery_id AS VARCHAR) ELSE '#' || regexp_replace(lower(ident), '[^0-9a-f]', '', 'g') END
    ORDER BY delivery_id) AS copy FROM deliveries),
found AS (SELECT delivery_id FROM numbered WHERE copy > 1),
kept AS (
  SELECT *, CASE WHEN "timestamp" <= 0 THEN NULL WHEN "timestamp" < 100000000000 THEN "timestamp" * 1000
            WHEN "timestamp" >= 100000000000000 THEN "timestamp" // 1000 ELSE "timestamp" END AS ms
  FROM sync_events WHERE delivery_id NOT IN (SELECT delivery_id FROM found)),
timed AS (
  SELECT *, ms // 86400000 AS day_no, CAST(DATE '1970-01-01' + CAST(ms // 86400000 AS INTEGER) AS DATE) AS pane, CAST(created_at AS DATE) AS arrived,
    CASE WHEN ms IS NULL OR created_at IS NULL THEN NULL WHEN epoch_us(created_at) > (ms + 259200000) * 1000 THEN 'cut'
         WHEN epoch_us(created_at) > ((ms // 86400000 + 1) * 86400000 + 3600000) * 1000 THEN 'late' ELSE 'in_time' END AS kind
  FROM kept)"""
_CHANGES = """, changes AS (
  SELECT org_id, pane, arrived, count(*) AS n, CAST(sum(coalesce(risk_score, 0)) AS BIGINT) AS total FROM timed
  WHERE kind IN ('in_time', 'late') GROUP BY ALL)"""
_ROLLING = f""", daily AS (
  SELECT org_id, pane AS day, sum(coalesce(risk_score, 0)) AS total, count(*) AS n FROM timed WHERE ms IS NOT NULL AND coalesce(kind, '') <> 'cut' GROUP BY ALL),
wanted AS (
  SELECT o.id AS org_id, CAST(r.day AS DATE) AS day FROM organizations o, range(DATE '{FIRST_DAY}', DATE '{LAST_DAY}' + 1, INTERVAL 1 DAY) r(day)),
rolled AS (
  SELECT w.org_id, w.day, CAST(coalesce(sum(d.total) FILTER (d.day > w.day - 7), 0) AS BIGINT) AS total_7, CAST(coalesce(sum(d.n) FILTER (d.day > w.day - 7), 0) AS BIGINT) AS n_7,
    CAST(coalesce(sum(d.total), 0) AS BIGINT) AS total_30, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n_30
  FROM wanted w LEFT JOIN daily d ON d.org_id = w.org_id AND d.day <= w.day AND d.day > w.day - 30 GROUP BY ALL)"""

SQL = {
    "p1_found": f"WITH {DELIVERIES_SQL} SELECT delivery_id FROM found",
    "p1_admitted": f"WITH {DELIVERIES_SQL} SELECT delivery_id FROM numbered WHERE copy = 1",
    "p2_found": f"WITH {DELIVERIES_SQL} SELECT delivery_id, kind FROM timed WHERE kind IN ('cut', 'late')",
    "p2_daily": f"WITH {DELIVERIES_SQL}{_CHANGES} SELECT org_id, CAST(pane AS VARCHAR) AS day, count(*) AS revision, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total FROM changes GROUP BY org_id, pane",
    "p2_weekly_revisions": f"""WITH {DELIVERIES_SQL}{_CHANGES}, covered AS (
      SELECT org_id, CAST(pane + CAST(k.k AS INTEGER) AS DATE) AS window_end, arrived, sum(n) AS n, sum(total) AS total FROM changes, range(7) k(k) GROUP BY ALL)
      SELECT org_id, CAST(window_end AS VARCHAR) AS window_end, CAST(arrived AS VARCHAR) AS arrived, row_number() OVER w AS revision, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(total) OVER w AS BIGINT) AS total
      FROM covered WINDOW w AS (PARTITION BY org_id, window_end ORDER BY arrived)""",
    "p5_found": f"WITH {DELIVERIES_SQL}{_ROLLING} SELECT org_id, CAST(day AS VARCHAR) AS day FROM rolled WHERE total_30 > 0 AND 2 * total_7 >= total_30",
    "p5_rolling": f"""WITH {DELIVERIES_SQL}{_ROLLING} SELECT org_id, CAST(day AS VARCHAR) AS day, total_7, n_7, total_30, n_30, round(total_7 / 7, 6) AS avg_day_7, round(total_30 / 30, 6) AS avg_day_30,
      round(total_7 / nullif(n_7, 0), 6) AS avg_row_7, round(total_30 / nullif(n_30, 0), 6) AS avg_row_30 FROM rolled""",
}
