"""The search for leaks where the items are too many to be sent to the tasks: the n-grams of items are a table, and joins take the place of lookups.

1. The items' n-grams with their places make a table. A Bloom filter of at most MOST_BITS bits, made of it by tasks, is all that is broadcast.
2. One pass over the documents counts in how many the n-grams stand alone; what passes the filter by accident is dropped by the join with the table.
3. Each piece of an item weighs its n-grams (see leakage.Matcher), pieces being groups of bounded size.
4. A second pass emits which distinct text has which of these; joined with the table by n-gram and summed up by text and piece they give the candidate pairs.
   Of a hot n-gram the planner splits the documents' side.
5. Only candidate texts are joined with their items and aligned, each distinct text once; the documents with that text follow by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from . import leakage as L

#: Bits of the filter for each n-gram, and the most in all (128 MB).
BITS_EACH, MOST_BITS = 64, 1 << 30
_FACTOR = np.uint64(6_364_136_223_846_793_005)


def _grams(texts: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some lists of words as numbers, and where they begin in all words taken together; those that reach into the next list left out."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.array([*chain.from_iterable(texts)], dtype=object)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(flat) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = pd.util.hash_array(flat)
    code = np.full(n, size, np.uint64)
    for k in range(size):
        code = code * _FACTOR + ids[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return code[at].view(np.int64), at


class Filter:
    """A Bloom filter with two bits for each n-gram: the upper bits of the number, and its lower bits."""

    def __init__(self, grams: DataFrame):
        n = grams.count()
        self.bits = int(min(MOST_BITS, max(1 << 16, 1 << int(np.ceil(np.log2(BITS_EACH * max(1, n)))))))
        width = self.bits.bit_length() - 1
        self.shift, self.low = np.uint64(64 - width), np.uint64(self.bits - 1)
        places = grams.select(F.explode(F.array(F.shiftrightunsigned("gram", 64 - width), F.col("gram").bitwiseAND(F.lit(self.bits - 1)))).alias("p"))
        marks = places.groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % 32_768).alias("bits"))
        self.bytes = np.zeros(self.bits // 8, np.uint8)
        for bucket, part in marks.toLocalIterator():
            part = np.frombuffer(bytes(part), np.uint8)
            self.bytes[bucket * 4096 : bucket * 4096 + len(part)] = part

    def holds(self, grams: np.ndarray) -> np.ndarray:
        x = grams.view(np.uint64)
        bit = lambda p: (self.bytes[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return (bit(x >> self.shift) & bit(x & self.low)).astype(bool)


class _Given(L.Matcher):
    """Aligns pairs that are known already."""

    def __init__(self, items: L.Items, least: int, pairs: list[tuple[int, int]]):
        self.items, self.least, self.masks, self.pairs = items, least, {}, sorted(pairs)

    def candidates(self, texts: list[str | None]) -> list[tuple[int, int]]:
        return self.pairs


def leaked(given: DataFrame, items: DataFrame, schema: T.StructType, copies: dict[int, int], least: int, least_matched: float) -> DataFrame:
    """schema's columns, as of leakage.leaked. given: key, _text; items: item, text; copies: the hashes of the most copied texts."""
    spark, (key, item) = given.sparkSession, schema.names[:2]
    items = items.toDF("item", "text").where(F.col("text").isNotNull())
    texts = given.select(F.xxhash64("_text").alias("hash"), "_text").where("_text <> ''")
    item_type = items.schema["item"].dataType.simpleString()

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = L.Items(list(enumerate(b.column(1).to_pylist())), least)
            starts = np.cumsum([0, *map(len, own.words)])
            for size in (L.SEED, L.LONG):
                code, at = _grams(own.words, size)
                piece = np.searchsorted(starts, at, side="right") - 1
                rows = np.array(own.ids, np.int64)[piece]
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.full(len(code), size, np.int32)), b.column(0).take(pa.array(rows)), pa.array(np.array(own.offsets, np.int32)[piece]), pa.array((at - starts[piece]).astype(np.int32))], names=["gram", "size", "item", "offset", "place"])

    places = checkpointed(items.mapInArrow(table, f"gram bigint, size int, item {item_type}, offset int, place int"))
    known = spark.sparkContext.broadcast(Filter(places.select("gram").distinct()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.array([1 / copies.get(h, 1) for h in b.column(0).to_pylist()])
            all_words = list(map(L.words, b.column(1).to_pylist()))
            owner = np.repeat(np.arange(len(all_words)), list(map(len, all_words)))
            code, at = _grams(all_words, L.SEED)
            hit = known.value.holds(code)
            long_code, long_at = _grams(all_words, L.LONG)
            alone = L.stands_alone(owner, at[hit], long_at[known.value.holds(long_code)])
            rows = pd.DataFrame({"gram": code[hit][alone], "owner": owner[at[hit][alone]]}).drop_duplicates()
            sums = rows.assign(n=part[rows["owner"]]).groupby("gram")["n"].sum()
            yield pa.RecordBatch.from_arrays([pa.array(sums.index.to_numpy(np.int64)), pa.array(sums.to_numpy(float))], names=["gram", "n"])

    total = max(1, given.count())
    frequency = texts.mapInArrow(count, "gram bigint, n double").groupBy("gram").agg((F.sum("n") / F.lit(total)).alias("share"))

    def weigh(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("place").reset_index(drop=True)
        weight = L.weights(piece["share"].fillna(0.0).to_numpy(), least)
        return piece.assign(weight=weight)[["gram", "item", "offset", "place", "weight"]]

    kind = f"gram bigint, item {item_type}, offset int, place int, weight double"
    seeds = places.where(F.col("size") == L.SEED).join(frequency, "gram", "left").select("gram", "item", "offset", "place", "share")
    seeds = seeds.groupBy("item", "offset").applyInPandas(weigh, kind).where("weight > 0")
    sure = places.where(F.col("size") == L.LONG).select("gram", "item", "offset", "place", F.lit(L.EVIDENCE).alias("weight"))
    used = checkpointed(seeds.unionByName(sure))
    wanted = spark.sparkContext.broadcast(Filter(used.select("gram").distinct()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_words = list(map(L.words, b.column(1).to_pylist()))
            owner = np.repeat(np.arange(len(all_words)), list(map(len, all_words)))
            for size in (L.SEED, L.LONG):
                code, at = _grams(all_words, size)
                hit = wanted.value.holds(code)
                rows = pd.DataFrame({"owner": owner[at[hit]], "gram": code[hit]}).drop_duplicates()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows["owner"].to_numpy(np.int64))), pa.array(rows["gram"].to_numpy(np.int64))], names=["hash", "gram"])

    found = texts.mapInArrow(emit, "hash bigint, gram bigint").join(used, "gram")
    # a place of an item counts once, whatever the copies of a text and the repetitions in it
    pairs = found.groupBy("hash", "item", "offset").agg(F.collect_set(F.struct("place", "weight")).alias("at"))
    near = lambda p, q: (q["place"] <= p["place"]) & (q["place"] >= p["place"] - L.SPREAD)
    sums = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, q: a + q["weight"])
    enough = (sums(F.col("at")) >= L.EVIDENCE - 1e-6) & F.exists("at", lambda p: sums(F.filter("at", lambda q: near(p, q))) >= L.EVIDENCE - 1e-6)
    pairs = checkpointed(pairs.where(enough).groupBy("hash", "item").agg(F.collect_set("offset").alias("offsets")))
    own_texts = texts.join(pairs.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
    rows = pairs.join(own_texts, "hash").join(items, pairs["item"].eqNullSafe(items["item"])).select("hash", pairs["item"], "offsets", "_text", "text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, pages, passages = (b.column(k).to_pylist() for k in (2, 3, 4))
            own = L.Items(list(enumerate(passages)), least)
            todo = [(i, k) for k, (i, o) in enumerate(zip(own.ids, own.offsets)) if o in offsets[i]]
            got = list(_Given(own, least, todo)._matches(pages, least_matched))
            i, _, score, n, hits = zip(*got) if got else [()] * 5
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int32()), pa.array(hits, pa.int32()), pa.array(score, pa.float64())], names=["hash", *schema.names[1:]])

    aligned = rows.mapInArrow(align, f"hash bigint, `{item}` {item_type}, words int, matched int, score double")
    return given.select(F.col(key), F.xxhash64("_text").alias("hash")).join(aligned, "hash").select(*schema.names)
