"""Items that appear together: counts of pairs over all baskets, and how much more often than chance.

Equal baskets are counted first, so each distinct basket makes its pairs once, with a weight. A basket of up to
CHUNK items makes its pairs in place. A larger one is split into chunks, a row each; the pairs of chunks are made as numbers,
a task at a time for each chunk, and then joined with the items of their two chunks, each pair going to a task by hash. It makes the
product there, so that no task holds the pairs of a whole huge basket, nor a row all of its chunks. Both kinds are summed
together by pair, with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a chunk: a row makes at most CHUNK * CHUNK pairs.
CHUNK = 64


def normal_items(items: Column) -> Column:
    """The sorted distinct items of a list: those holding '|' split, trimmed, in upper case, '-' and inner spaces turned into '_', nulls and empty ones dropped. Null for a null list."""
    parts = F.flatten(F.transform(items, lambda x: F.split(F.coalesce(x, F.lit("")), r"\|")))
    clean = F.transform(parts, lambda x: F.translate(F.upper(F.trim(x)), "- ", "__"))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def distinct_baskets(baskets: DataFrame, items: str) -> DataFrame:
    """items, weight: each distinct non-empty basket and how many rows hold it. `items` holds sorted distinct items; null and empty lists don't count."""
    return baskets.where(F.size(items) > 0).groupBy(F.col(items).alias("items")).agg(F.count(F.lit(1)).alias("weight"))


def _within(items: Column) -> Column:
    """All pairs of a sorted list."""
    n = F.size(items)
    rest = lambda a, i: F.transform(F.slice(items, i + 2, n), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(items, rest))


def pair_counts(baskets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b, n_ab with a < b: the rows that hold both items. baskets: items, weight as of distinct_baskets."""
    small = baskets.where((F.size("items") > 1) & (F.size("items") <= chunk)).select("weight", F.explode(_within(F.col("items"))).alias("p"))
    # baskets are distinct, so their contents name them; a chunk's row holds its own items only
    name = F.sha2(F.to_json("items"), 256)
    large = baskets.where(F.size("items") > chunk).select(name.alias("name"), "weight", "items", ((F.size("items") - 1) / chunk).cast("int").alias("last"))
    chunks = large.select("name", F.explode(F.expr(f"transform(sequence(0, last), k -> struct(k AS k, slice(items, k * {chunk} + 1, {chunk}) AS part))")).alias("c")).select("name", F.col("c.k").alias("k"), F.col("c.part").alias("part"))
    left = large.select("name", "weight", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")).repartition("name", "i")
    ids = left.select("name", "weight", "i", F.explode(F.sequence(F.col("i"), F.col("last"))).alias("j"))
    ids = ids.join(chunks.select("name", F.col("k").alias("i"), F.col("part").alias("left")), ["name", "i"])
    both = ids.join(chunks.select("name", F.col("k").alias("j"), F.col("part").alias("right")), ["name", "j"])
    product = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    large = both.select("weight", F.explode(F.when(F.col("i") == F.col("j"), _within(F.col("left"))).otherwise(product)).alias("p"))
    return small.unionByName(large).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("weight").alias("n_ab"))


def associations(baskets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b, n_ab, n_a, n_b, n and lift = n_ab * n / (n_a * n_b) of all pairs that occur. Empty for no baskets.

    baskets: items, weight; read three times, so cut its lineage first. Counts are joined on the item: nothing
    is broadcast unless the planner knows its size.
    """
    single = baskets.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("k"))
    total = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).scalar()
    pairs = pair_counts(baskets, chunk)
    pairs = pairs.join(single.select(F.col("item").alias("a"), F.col("k").alias("n_a")), "a").join(single.select(F.col("item").alias("b"), F.col("k").alias("n_b")), "b")
    pairs = pairs.select("a", "b", "n_ab", "n_a", "n_b", total.alias("n"))
    return pairs.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / F.col("n_a") / F.col("n_b"))
