"""A dictionary of words with a value each, as a table: exact lookups, prefixes, values, size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary(rows: DataFrame, word: str, meta: str, order: str) -> DataFrame:
    """word, meta: of rows that give a word several values the last by `order` holds. Null and empty words are no words."""
    given = rows.where(F.col(word).isNotNull() & (F.col(word) != "")).select(F.col(word).alias("word"), F.struct(F.col(order).alias("o"), F.col(meta).alias("m")).alias("_"))
    return given.groupBy("word").agg(F.max("_").alias("_")).select("word", F.col("_.m").alias("meta"))


def looked_up(asked: DataFrame, words: DataFrame, query: str = "q") -> DataFrame:
    """asked, each text once, with has (it is a word), starts (a word begins with it) and meta (its value). Equal joins on the words and on their distinct beginnings, so either side may be large. A null text is nowhere; every word begins with an empty one."""
    texts = asked.select(F.col(query).alias("_q")).distinct()
    exact = words.select(F.col("word").alias("_w"), "meta", F.lit(True).alias("has"))
    parts = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.left("word", n))).alias("_p")).distinct().withColumn("starts", F.lit(True))
    out = texts.join(exact, texts["_q"] == exact["_w"], "left").join(parts, texts["_q"] == parts["_p"], "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select(F.col("_q").alias(query), no("has"), no("starts"), "meta")
