"""Patterns of the organisations themselves: all of them at once, each text against those of its own organisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import plain_spaces, to_java

FOUND = "array<struct<id:string,name:string,category:string,score:int,count:int>>"


def parsed(given: str) -> tuple[str, bool]:
    """The regular expression of a custom pattern and whether case counts for nothing: a keyword, unless it holds characters that only a regular expression would."""
    keyword, any_case = not re.search(r"[\\\[\](){}|*+?^$]", given), False
    if given.startswith("(?i)"):
        given, any_case, keyword = given[4:], True, False
    return (re.sub(r"([.^$*+?{}\[\]\\|()/-])", r"\\\1", given) if keyword else given), any_case or keyword


def translated(given: str) -> str | None:
    """A custom pattern for Java; null if it is no regular expression."""
    regex, any_case = parsed(given)
    try:
        re.compile(regex)
    except re.error:
        return None
    return to_java(regex, any_case)


def _java(patterns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in patterns:
        yield part.map(translated)


def active(custom: DataFrame) -> DataFrame:
    """org_id, patterns: the active patterns of each organisation, by id, their expressions translated once for each pattern. Null and empty patterns, and those that are no regular expressions, don't count; a null score is 50, a null name the id, a null category CUSTOM."""
    rows = custom.where(F.col("is_active") & (F.col("pattern") != ""))
    rows = rows.select("org_id", F.struct(F.col("id").cast("string").alias("id"), F.coalesce("name", F.col("id").cast("string")).alias("name"), F.coalesce("category", F.lit("CUSTOM")).alias("category"), F.coalesce(F.col("score").cast("int"), F.lit(50)).alias("score"), F.pandas_udf(_java, T.StringType())("pattern").alias("java")).alias("p"))
    return rows.where("p.java IS NOT NULL").groupBy("org_id").agg(F.array_sort(F.collect_list("p")).alias("patterns"))


def custom_threats(rows: DataFrame, custom: DataFrame, text: str = "text", org: str = "org_id") -> DataFrame:
    """rows and `custom`: of the active patterns of its organisation those that a text holds, with the number of matches, by id.

    One join on the organisation, of which the small side is the patterns; no limit on their number, nothing is collected to
    the driver. A null text or organisation has none. A column `custom` that rows already have is replaced. Matches of the empty text don't count.
    """
    own = active(custom).withColumnRenamed("org_id", "_org")
    joined = rows.drop("custom").join(own, F.col(org) == F.col("_org"), "left")
    shown = plain_spaces(F.col(text))

    def found(p: Column) -> Column:
        hits = F.filter(F.regexp_extract_all(shown, p["java"], F.lit(0)), lambda v: v != "")
        return F.struct(p["id"].alias("id"), p["name"].alias("name"), p["category"].alias("category"), p["score"].alias("score"), F.size(hits).alias("count"))

    hits = F.filter(F.transform("patterns", found), lambda x: x["count"] > 0)
    return joined.withColumn("custom", F.coalesce(hits.cast(FOUND), F.array().cast(FOUND))).drop("_org", "patterns")
