"""Messages delivered more than once: exactly one delivery of each comes out.

Identifiers are dictionary-encoded exactly: a key (scope, identifier) gets a shard and a dense code in it. A shard is what
one task of one batch numbers, so codes need neither a sort nor a shuffle of their own, and the number of shards follows the
number of keys. A shard's seen-bitmap has one bit for each code, in buckets of 32,768 bits that Parquet compresses (full
buckets shrink to a few bytes). A batch is admitted so:

1. pre-aggregate it to one row a key, its first delivery (the map side combines, so a key that holds a third of all rows
   sends one row a task). This is the one shuffle of the batch;
2. look the keys up in the dictionary. A small batch is sent to the dictionary's tasks, so that the dictionary isn't shuffled;
   the planner decides that by the size it measured;
3. keys that are not in it get the next codes, in the same tasks;
4. of known keys, those whose bit is unset are admitted too;
5. the union of old and new bits of the buckets concerned is written, and all of it counts by one atomic commit.

If another writer commits meanwhile, the batch is admitted again on top of that. Folders of the dictionary and the bitmaps are
merged by levels, so their number stays logarithmic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Conflict, Versions, merged

#: Spark's bitmap functions use buckets of so many bits.
BUCKET_BITS = 32_768
#: How often a batch is admitted anew because other writers came first.
TRIES = 20


def bit_is_set(bits: Column, position: Column) -> Column:
    """Whether bit `position` (from 0) of a bucket made by bitmap_construct_agg is set; false for a null bucket."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def _bucket(code: str = "code") -> list[Column]:
    return [F.shiftright(code, 15).alias("bucket"), (F.col(code) % BUCKET_BITS).alias("position")]


class SeenBitmaps:
    """Dictionary and bitmaps under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def _read(self, state: dict, part: str) -> DataFrame | None:
        folders = [path for _, path in state.get(part, [])]
        return self.spark.read.parquet(*folders) if folders else None

    def dictionary(self, version: int | None = None) -> DataFrame | None:
        """scope, ident, shard, code of each key of a version, the last one if not given; None before the first."""
        codes = self._read(self.versions.manifest(self.versions.latest() if version is None else version), "codes")
        return codes if codes is None else codes.select("scope", "ident", "shard", "code")

    def bitmaps(self, version: int | None = None) -> DataFrame | None:
        """shard, bucket, bits: the state of each bucket in a version, the last one if not given."""
        return self._newest(self.versions.manifest(self.versions.latest() if version is None else version))

    def _newest(self, state: dict) -> DataFrame | None:
        bits = self._read(state, "bits")
        return bits if bits is None else bits.groupBy("shard", "bucket").agg(F.max_by("bits", "version").alias("bits"))

    def _admitted(self, folder: str, order: str) -> DataFrame:
        """What the attempt in a folder admitted."""
        fresh, again = (self.spark.read.parquet(f"{folder}/{part}").select(F.col("first").alias(order)) for part in ("codes", "again"))
        return fresh.unionByName(again)

    def _repeated(self, version: int, source: str, number: int) -> str | None:
        """The folder in which a batch of this source and number was committed."""
        while version:
            mine = self.versions.manifest(version).get("sources", {}).get(source)
            if mine is None or mine[0] <= number:
                return mine[1] if mine and mine[0] == number else None
            version = mine[2] - 1  # the version before the one that has the later number
        return None

    def admit(self, batch: DataFrame, scope: str, ident: str, order: str, tag: tuple[str, int] | None = None) -> DataFrame:
        """Of each key (scope, ident) not seen before, the value of `order` of its first delivery in this batch.

        Runs: what it admits is committed before this returns. Rows whose ident is null have no key: they are not
        in the result, and the caller keeps each. A null scope is a scope of its own. Ties on `order` give that
        value once. An empty batch commits an empty version. Other columns of the batch, whatever their names,
        aren't looked at. tag: who sends the batches, and the number of this one; numbers of a sender don't decrease. A
        batch of a sender and number that was committed before is a repetition, and what was admitted then is given again.
        """
        for _ in range(TRIES):
            version = self.versions.latest()
            state = self.versions.manifest(version)
            if tag and (folder := self._repeated(version, *tag)):
                return self._admitted(folder, order)
            folder = self.versions.attempt()
            state = self._write(batch, scope, ident, order, version + 1, state, folder)
            if tag:
                state["sources"] = {**state["sources"], tag[0]: [tag[1], folder, version + 1]}
            try:
                self.versions.commit(version + 1, state)
            except Conflict:
                continue
            return self._admitted(folder, order)
        raise Conflict(f"other writers came first {TRIES} times")

    def _write(self, batch: DataFrame, scope: str, ident: str, order: str, version: int, state: dict, folder: str) -> dict:
        """Writes what a batch adds to a state; gives the state after it."""
        save = lambda df, to: df.write.option("compression", "zstd").parquet(to)
        read, known = self.spark.read.parquet, self._read(state, "codes")
        keys = batch.where(F.col(ident).isNotNull()).select(F.col(scope).alias("scope"), F.col(ident).alias("ident"), F.col(order).alias("first"))
        fresh = keys.groupBy("scope", "ident").agg(F.min("first").alias("first"))
        same = lambda a, b: a["scope"].eqNullSafe(b["scope"]) & (a["ident"] == b["ident"])
        if known is not None:
            save(fresh, f"{folder}/keys")
            fresh = read(f"{folder}/keys")
            save(known.join(fresh, same(known, fresh)).select(known["scope"], known["ident"], "shard", "code", fresh["first"]), f"{folder}/known")
            hit = read(f"{folder}/known")
            fresh = fresh.join(hit, same(fresh, hit), "left_anti")
        # a task numbers its rows from 0: the upper bits of the number are the task, the lower ones the row
        place = F.monotonically_increasing_id()
        shard = F.shiftleft(F.lit(version).cast("bigint"), 31) + F.shiftright("place", 33)
        save(fresh.withColumn("place", place).select("scope", "ident", shard.alias("shard"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("code"), "first"), f"{folder}/codes")
        codes, bits = read(f"{folder}/codes").select("shard", *_bucket()), self._newest(state)
        unseen = self.spark.createDataFrame([], "shard bigint, code bigint, first bigint")
        if known is not None:
            hit = hit.select("shard", "code", "first", *_bucket())
            hit = hit.join(bits, ["shard", "bucket"], "left").where(~bit_is_set(F.col("bits"), F.col("position")))
            unseen = hit.select("shard", "code", "first")
        save(unseen.withColumn("first", F.col("first").cast(batch.schema[order].dataType)), f"{folder}/again")
        again = read(f"{folder}/again").select("shard", *_bucket())
        new = codes.unionByName(again).groupBy("shard", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        if bits is not None:
            old = bits.join(again.select("shard", "bucket").distinct(), ["shard", "bucket"], "left_semi")
            new = new.unionByName(old).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        save(new.withColumn("version", F.lit(version)), f"{folder}/bits")

        def codes_of(level: int, paths: list[str]) -> str:
            save(read(*paths), to := f"{folder}/codes-{level}")
            return to

        def bits_of(level: int, paths: list[str]) -> str:
            save(read(*paths).groupBy("shard", "bucket").agg(F.max_by("bits", "version").alias("bits"), F.max("version").alias("version")), to := f"{folder}/bits-{level}")
            return to

        return {"codes": merged(state.get("codes", []), [0, f"{folder}/codes"], codes_of), "bits": merged(state.get("bits", []), [0, f"{folder}/bits"], bits_of), "sources": state.get("sources", {})}

    def count(self) -> int:
        """How many keys have been admitted."""
        bits = self.bitmaps()
        return 0 if bits is None else bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]


def further_copies(batch: DataFrame, admitted: DataFrame, ident: str, order: str) -> DataFrame:
    """The values of `order` of the rows of a batch that have an identifier and weren't admitted."""
    return batch.where(F.col(ident).isNotNull()).select(order).join(admitted.select(order), order, "left_anti")


def first_deliveries(deliveries: DataFrame, scope: str, ident: str, order: str) -> DataFrame:
    """The value of `order` of the first delivery of each message, without state and in one shuffle of keys.

    A row without identifier is a message of its own. The map side combines, so hot keys stay small.
    """
    own = F.when(F.col(ident).isNull(), F.col(order))
    return deliveries.groupBy(F.col(scope).alias("_s"), F.col(ident).alias("_i"), own.alias("_o")).agg(F.min(order).alias(order)).select(order)
