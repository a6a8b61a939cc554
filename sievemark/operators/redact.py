"""Merging of spans and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import BLOCK, blocks, islands, let
from .detect import SPAN


def merge_spans(spans: Column) -> Column:
    """Disjoint spans by start; those that share a character become one, with the placeholder of the severest, of the first on a tie (by start, end, seq). Touching spans stay apart. Null for null."""
    order = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["seq"].alias("seq"), x["placeholder"].alias("placeholder"), x["score"].alias("score")))

    def one(group: Column) -> Column:
        worst = F.array_max(F.transform(group, lambda x, i: F.struct(F.coalesce(x["score"], F.lit(0)).alias("s"), (-i).alias("i"))))["i"]
        last = F.array_max(F.transform(group, lambda x: x["end"]))
        return let(F.get(group, -worst), lambda w: F.struct(group[0]["start"].alias("start"), last.alias("end"), w["placeholder"].alias("placeholder"), w["score"].alias("score"), group[0]["seq"].alias("seq")))

    merged = let(F.array_sort(order), lambda x: F.transform(islands(x), one))
    return F.when(F.size(spans) < 2, spans.cast(SPAN)).otherwise(merged.cast(SPAN))


def redact(text: Column, merged: Column) -> Column:
    """The text with each of the disjoint sorted spans replaced by its placeholder. The text is cut at some spans first, as a cut within it costs as much as what lies before. merged: a column, not an expression, which would be computed for each span."""

    def part(group: Column, k: Column) -> Column:
        begin = F.coalesce(F.try_element_at(merged, F.nullif(k * BLOCK, F.lit(0)))["end"], F.lit(0))

        def filled(own: Column) -> Column:
            since = lambda i: F.coalesce(F.try_element_at(group, F.nullif(i, F.lit(0)))["end"], own["from"])
            piece = lambda x, i: let(since(i), lambda p: F.concat(F.substring(own["t"], p - own["from"] + 1, x["start"] - p), x["placeholder"]))
            return F.array_join(F.transform(group, piece), "")

        return let(begin, lambda p: let(F.struct(p.alias("from"), F.substring(text, p + 1, F.try_element_at(group, F.lit(-1))["end"] - p).alias("t")), filled))

    rest = F.substring(text, F.try_element_at(merged, F.lit(-1))["end"] + 1, F.length(text))
    return F.when(F.size(merged) > 0, F.concat(F.array_join(F.transform(blocks(merged), part), ""), rest)).otherwise(text)


def merge_span_rows(spans: DataFrame, key: str) -> DataFrame:
    """The same on rows: key, start, end, placeholder, score, seq in; key, start, end, placeholder out. Islands of a running maximum of the ends, one shuffle on the key."""
    order = Window.partitionBy(key).orderBy("start", "end", "seq")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(order))
    worst = F.min_by("placeholder", F.struct(-F.coalesce("score", F.lit(0)), "start", "end", "seq"))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), worst.alias("placeholder")).drop("_island")


def without_overlap(spans: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows of spans (key, start, end, more) that share no character with one of others of the same key: an anti-join on the key with a range condition."""
    a, b = spans.alias("a"), others.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end")).alias("b")
    hit = (F.col(f"a.{key}") == F.col("_key")) & (F.col("a.start") < F.col("_end")) & (F.col("_start") < F.col("a.end"))
    return a.join(b, hit, "left_anti")
