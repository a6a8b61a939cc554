"""Rolling totals over trailing periods, as versioned daily state.

The state of an entity on a day holds, for each period of W days, the total and the number of rows of the W
days ending with it. The next day's state is yesterday's plus today's arrivals minus the amounts of the day
that expires. A correction of a past day changes only the W days from it on; those get a new version.
All amounts are integers, so the recurrence is exact. RollingStore keeps amounts and state in a folder of versions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import Versions, merged

PERIODS = (7, 30)


def kinds(periods: tuple[int, ...]) -> list[str]:
    return [f"{k}_{w}" for w in periods for k in ("total", "n")]


def spine(entities: DataFrame, entity: str, first: Column, last: Column) -> DataFrame:
    """entity, day: each distinct non-null entity on each day from first to last."""
    return entities.select(F.col(entity).alias("entity")).where("entity IS NOT NULL").distinct().select("entity", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day"))


def advance(yesterday: DataFrame | None, daily: DataFrame, days: DataFrame, first: dt.date, last: dt.date, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """entity, day, total_W and n_W of each entity and day of `days`, from the state of the day before `first`: the recurrence over the days from first to last, one or many.

    yesterday: entity, total_W, n_W; None for zeros. daily: entity, day, total, n: what arrived, of the days that are taken in
    and of those that expire meanwhile; others are left out. On its day an amount comes in, W days later it goes out; the state is
    yesterday's and the running sum of that, in one shuffle on entity and day. Entities without any amount have zeros; those outside
    `days` don't come out.
    """
    zero, names = F.lit(0).cast("bigint"), kinds(periods)
    span = F.col("day").between(F.lit(first), F.lit(last))
    amounts = daily.where(F.col("day").between(F.lit(first - dt.timedelta(days=max(periods))), F.lit(last)))
    moves = [days.where(span).select("entity", "day", F.lit(True).alias("wanted"), *(zero.alias(c) for c in names))]
    if yesterday is not None:
        moves.append(yesterday.select("entity", F.lit(first).alias("day"), F.lit(False).alias("wanted"), *(F.col(c).cast("bigint").alias(c) for c in names)))
    signed = lambda c, w, sign: (sign * F.col(c.split("_")[0]).cast("bigint")) if c.endswith(f"_{w}") else zero
    moves.append(amounts.where(span).select("entity", "day", F.lit(False).alias("wanted"), *(F.col(c.split("_")[0]).cast("bigint").alias(c) for c in names)))
    for w in periods:
        gone = amounts.select("entity", F.date_add("day", w).alias("day"), F.lit(False).alias("wanted"), *(signed(c, w, -1).alias(c) for c in names)).where(span)
        if yesterday is None:  # what came before the first day isn't in the zeros
            gone = gone.where(F.col("day") >= F.lit(first + dt.timedelta(days=w)))
        moves.append(gone)
    rows = moves[0]
    for m in moves[1:]:
        rows = rows.unionByName(m)
    net = rows.groupBy("entity", "day").agg(F.max("wanted").alias("wanted"), *(F.sum(c).alias(c) for c in names))
    so_far = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return net.select("entity", "day", "wanted", *(F.sum(c).over(so_far).alias(c) for c in names)).where("wanted").drop("wanted")


class RollingStore:
    """Daily amounts and state of entities under `root`, a folder that all executors share.

    Before the day `start` everything is zero. The parts are `daily` (what arrived, by entity and day; several rows add up)
    and `state` (entity, day, total_W, n_W, version; of several the highest version holds).
    """

    def __init__(self, spark: SparkSession, root: str, start: dt.date, periods: tuple[int, ...] = PERIODS):
        self.spark, self.versions, self.start, self.periods = spark, Versions(spark, root), start, periods

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        version = self.versions.latest() if version is None else version
        return version, self.versions.manifest(version)

    def _read(self, state: dict, part: str) -> DataFrame | None:
        return self.spark.read.parquet(*(p for _, p in state[part])) if state.get(part) else None

    def last_day(self) -> dt.date:
        """The last day whose state is there; the day before `start` if none is."""
        given = self._manifest()[1].get("day")
        return dt.date.fromisoformat(given) if given else self.start - dt.timedelta(days=1)

    def _commit(self, version: int, before: dict, folder: str, day: dt.date) -> None:
        read = self.spark.read.parquet

        def daily_of(level: int, paths: list[str]) -> str:
            read(*paths).groupBy("entity", "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).write.parquet(to := f"{folder}/daily-{level}")
            return to

        def state_of(level: int, paths: list[str]) -> str:
            read(*paths).write.parquet(to := f"{folder}/state-{level}")
            return to

        parts = {"daily": merged(before.get("daily", []), [0, f"{folder}/daily"], daily_of), "state": merged(before.get("state", []), [0, f"{folder}/state"], state_of)}
        self.versions.commit(version, {**parts, "day": day.isoformat()})

    def advance(self, arrivals: DataFrame, entities: DataFrame, last: dt.date) -> int:
        """Takes in the days after last_day() up to `last`; gives the version that it makes.

        arrivals: entity, day, total, n; those of other days are left out: earlier ones are for correct(). entities: entity, all that
        are to have a state on these days. Nothing to do if `last` is no new day. Runs.
        """
        version, before = self._manifest()
        first, folder = self.last_day() + dt.timedelta(days=1), self.versions.attempt()
        if last < first:
            return version
        arrivals.where(F.col("entity").isNotNull() & F.col("day").between(F.lit(first), F.lit(last))).select("entity", "day", "total", "n").write.parquet(f"{folder}/daily")
        daily, yesterday, past = self.spark.read.parquet(f"{folder}/daily"), None, self._read(before, "daily")
        if past is not None:
            daily = daily.unionByName(past)
            yesterday = self.state().where(F.col("day") == F.lit(first - dt.timedelta(days=1)))
        out = advance(yesterday, daily, spine(entities, "entity", F.lit(first), F.lit(last)), first, last, self.periods)
        out.withColumn("version", F.lit(1)).write.parquet(f"{folder}/state")
        self._commit(version + 1, before, folder, last)
        return version + 1

    def correct(self, late: DataFrame) -> int:
        """Puts late daily amounts into days that are there already; gives the version that it makes.

        late: entity, day, total, n (negative amounts take back); days before `start` or after last_day() are left out. Only the
        days that a correction reaches, at most max(periods) for each, are computed again and written, with the next version. Runs.
        """
        version, before = self._manifest()
        last, folder, far = self.last_day(), self.versions.attempt(), max(self.periods)
        late.where(F.col("entity").isNotNull() & F.col("day").between(F.lit(self.start), F.lit(last))).select("entity", "day", "total", "n").write.parquet(f"{folder}/daily")
        reached = self.spark.read.parquet(f"{folder}/daily").select("entity", F.col("day").alias("_from"), "total", "n", F.explode(F.expr(f"sequence(day, date_add(day, {far - 1}))")).alias("day"))
        inside = lambda w: F.col("day") < F.date_add("_from", w)
        change = reached.where(F.col("day") <= F.lit(last)).groupBy("entity", "day").agg(*(F.sum(F.when(inside(w), F.col(k)).otherwise(0)).cast("bigint").alias(f"d_{k}_{w}") for w in self.periods for k in ("total", "n")))
        out = self.state().join(change, ["entity", "day"]).select("entity", "day", *((F.col(c) + F.col(f"d_{c}")).alias(c) for c in kinds(self.periods)), (F.col("version") + 1).alias("version"))
        out.write.parquet(f"{folder}/state")
        self._commit(version + 1, before, folder, last)
        return version + 1

    def state(self, version: int | None = None) -> DataFrame:
        """entity, day, total_W, n_W, version of every entity and day, as of a version of the store or now."""
        rows = self._read(self._manifest(version)[1], "state")
        if rows is None:
            raise ValueError("nothing was taken in yet")
        names = [*kinds(self.periods), "version"]
        return rows.groupBy("entity", "day").agg(F.max_by(F.struct(*names), "version").alias("_")).select("entity", "day", "_.*")
