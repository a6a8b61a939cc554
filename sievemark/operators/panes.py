"""Late and out-of-order events: figures by event time that late rows correct, up to a cut-off.

Stream slicing: the time line is cut into non-overlapping panes at the windows' boundaries (here: UTC days).
A row changes one pane. Windows are sums of successive panes, and only those covering a changed pane are composed
again from the panes and emitted, as a new revision. Panes, emissions and the report of late and cut rows are kept in a folder
of versions (PaneStore); each batch of arrivals makes one version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timing import DAY_MS, event_time_ms, ntz_micros, utc_day
from .versions import Versions, merged


def lateness(event_ms: Column, created_us: Column, cut_hours: int = 72, grace_hours: int = 1) -> Column:
    """'cut' beyond cut_hours after the event, 'late' beyond grace_hours after the end of its UTC day, else 'in_time'; null if a time is missing."""
    closed_ms = (F.floor(event_ms / F.lit(DAY_MS)) + 1) * F.lit(DAY_MS) + F.lit(grace_hours * 3_600_000)
    return (
        F.when(event_ms.isNull() | created_us.isNull(), F.lit(None).cast("string"))
        .when(created_us > (event_ms + F.lit(cut_hours * 3_600_000)) * 1000, "cut")
        .when(created_us > closed_ms * 1000, "late")
        .otherwise("in_time")
    )


def sliced(rows: DataFrame, stamp: str = "timestamp", created: str = "created_at", cut_hours: int = 72, grace_hours: int = 1) -> DataFrame:
    """rows with `pane` (UTC day of the event), `arrived` (UTC day of storing) and `kind` (see lateness).

    Rows without an event time have a null pane; rows without created_at have a null arrived; either gives a
    null kind. A pane or kind column that rows already have is replaced. Narrow: no shuffle.
    """
    ms, us = event_time_ms(F.col(stamp)), ntz_micros(F.col(created))
    return rows.select(
        *(F.col(c) for c in rows.columns if c not in ("pane", "arrived", "kind")),
        utc_day(ms).alias("pane"),
        F.col(created).cast("date").alias("arrived"),
        lateness(ms, us, cut_hours, grace_hours).alias("kind"),
    )


def pane_changes(rows: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """keys, pane, arrived, n, total: what each arrival period changed in each pane. Cut rows and rows without a kind change none; null amounts count as 0."""
    return rows.where(F.col("kind").isin("in_time", "late")).groupBy(*keys, "pane", "arrived").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(amount), F.lit(0))).cast("bigint").alias("total"))


def _covering(panes: DataFrame, size: int) -> DataFrame:
    """A row for each window of `size` panes that covers the pane: window_end in place of pane. At most `size` of them."""
    return panes.withColumn("window_end", F.explode(F.expr(f"sequence(pane, date_add(pane, {size - 1}))"))).drop("pane")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, (a[c].eqNullSafe(b[c]) for c in names))


class PaneStore:
    """Panes and windows of `size` successive panes under `root`, a folder that all executors share. keys: the columns that set series apart, nulls being a value."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], size: int = 1):
        self.spark, self.versions, self.keys, self.size = spark, Versions(spark, root), keys, size

    def apply(self, rows: DataFrame, amount: str, order: str | None = None, tag: tuple[str, int] | None = None) -> int:
        """Takes in a batch of sliced rows and gives the version that it makes.

        Runs. rows is read twice, so cut its lineage before. order: the column that names a row; then late and cut rows are
        kept for reported(). Within a batch each arrival period (UTC day) makes revisions of its own, in their order. Batches
        are to come in the order of arrival; one that doesn't is taken in all the same, as the next revisions. tag: who sends the
        batch, and its number; one that was committed before isn't taken in again. An empty batch makes an empty version.
        One writer at a time: a second one gets a Conflict.
        """
        version = self.versions.latest()
        state = self.versions.manifest(version)
        if tag and state.get("sources", {}).get(tag[0], -1) >= tag[1]:
            return version
        read, folder, keys = self.spark.read.parquet, self.versions.attempt(), self.keys
        save = lambda df, part: df.write.option("compression", "zstd").parquet(f"{folder}/{part}")
        save(pane_changes(rows, keys, amount), "panes")
        panes, windows, reported = state.get("panes", []), state.get("windows", []), state.get("reported", [])
        changes = read(f"{folder}/panes")
        changed = _covering(changes, self.size).groupBy(*keys, "window_end", "arrived").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        history = Window.partitionBy(*keys, "window_end").orderBy("arrived")
        out = changed.select(*keys, "window_end", "arrived", F.row_number().over(history).cast("bigint").alias("revision"), F.sum("n").over(history).alias("n"), F.sum("total").over(history).alias("total"))
        if panes:
            # the windows concerned, composed again from the panes as they were, and how often they were emitted
            names = [*keys, "window_end"]
            touched = _covering(changes.select(*keys, "pane").distinct(), self.size).distinct()
            before = _covering(read(*(p for _, p in panes)).select(*keys, "pane", "n", "total"), self.size)
            before = before.join(touched, _same(before, touched, names), "left_semi").groupBy(*names).agg(F.sum("n").alias("n0"), F.sum("total").alias("total0"))
            emitted = read(*(p for _, p in windows)).select(*names, "revision")
            emitted = emitted.join(touched, _same(emitted, touched, names), "left_semi").groupBy(*names).agg(F.max("revision").alias("revision0"))
            out = out.join(before, _same(out, before, names), "left").drop(*(before[c] for c in names))
            out = out.join(emitted, _same(out, emitted, names), "left").drop(*(emitted[c] for c in names))
            old = lambda c: F.col(c) + F.coalesce(f"{c}0", F.lit(0))
            out = out.select(*names, "arrived", *(old(c).alias(c) for c in ("revision", "n", "total")))
        save(out, "windows")
        if order:
            save(rows.where(F.col("kind").isin("late", "cut")).select(order, "kind"), "reported")
            reported = [*reported, [0, f"{folder}/reported"]]

        def panes_of(level: int, paths: list[str]) -> str:
            save(read(*paths).groupBy(*keys, "pane").agg(F.max("arrived").alias("arrived"), F.sum("n").alias("n"), F.sum("total").alias("total")), f"panes-{level}")
            return f"{folder}/panes-{level}"

        def windows_of(level: int, paths: list[str]) -> str:
            save(read(*paths), f"windows-{level}")
            return f"{folder}/windows-{level}"

        state = {"panes": merged(panes, [0, f"{folder}/panes"], panes_of), "windows": merged(windows, [0, f"{folder}/windows"], windows_of), "reported": reported, "last": folder, "sources": {**state.get("sources", {}), **({tag[0]: tag[1]} if tag else {})}}
        self.versions.commit(version + 1, state)
        return version + 1

    def _part(self, part: str, version: int | None) -> DataFrame:
        folders = self.versions.manifest(self.versions.latest() if version is None else version).get(part)
        if not folders:
            raise ValueError("nothing was taken in yet")
        return self.spark.read.parquet(*(p for _, p in folders))

    def panes(self, version: int | None = None) -> DataFrame:
        """keys, pane, n, total of every pane, in a version or now."""
        return self._part("panes", version).groupBy(*self.keys, "pane").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def emissions(self, version: int | None = None) -> DataFrame:
        """keys, window_end, arrived, revision, n, total: all that was emitted up to a version; revisions count from 1."""
        return self._part("windows", version)

    def emitted_by(self, version: int) -> DataFrame:
        """What one version emitted: the windows that cover a pane it changed, and no others."""
        return self.spark.read.parquet(f"{self.versions.manifest(version)['last']}/windows")

    def current(self, version: int | None = None) -> DataFrame:
        """keys, window_end, revision, n, total: the last revision of each window."""
        newest = self.emissions(version).groupBy(*self.keys, "window_end").agg(F.max("revision").alias("revision"), F.max_by(F.struct("n", "total"), "revision").alias("_"))
        return newest.select(*self.keys, "window_end", "revision", "_.n", "_.total")

    def reported(self, version: int | None = None) -> DataFrame:
        """order, kind of the late and cut rows taken in with an order."""
        return self._part("reported", version)
