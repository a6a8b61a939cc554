"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.delivered import kept
from ..plans.events import DELIVERIES_SQL
from ..session import checkpointed, spread
from ..sources.tables import table
from . import cooccurrence, languages, leakage, quantiles, tokenizer


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    rows = kept(spark, folder, "threat_categories").select(cooccurrence.normal_items(F.col("threat_categories")).alias("items"))
    return checkpointed(cooccurrence.distinct_baskets(rows, "items"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of categories in at least 5 rows and one row of 1000, at least three times as often as by chance."""
    pairs = cooccurrence.associations(_baskets(spark, folder))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    hit = (F.col("n_ab") >= 5) & (1000 * F.col("n_ab") >= F.col("n")) & (wide("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))
    return pairs.where(hit).select(F.col("a").alias("category_a"), F.col("b").alias("category_b"))


def p3_associations(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of categories that occurs, its counts and its ratio to chance."""
    return cooccurrence.associations(_baskets(spark, folder)).select(F.col("a").alias("category_a"), F.col("b").alias("category_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p3_active_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which the same organisations have events: baskets of up to 120 days, so chunks and their products are needed."""
    rows = table(spark, folder, "sync_events", "org_id", "created_at").where("org_id IS NOT NULL AND created_at IS NOT NULL")
    days = rows.select("org_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).distinct()
    # an organisation has as many items as there are days, whatever the number of its rows
    baskets = days.groupBy("org_id").agg(F.array_sort(F.collect_set("day")).alias("items"))
    pairs = cooccurrence.associations(checkpointed(cooccurrence.distinct_baskets(baskets, "items")))
    return pairs.select(F.col("a").alias("day_a"), F.col("b").alias("day_b"), "n_ab", "n_a", "n_b", "n")


def _times(spark: SparkSession, folder: str) -> DataFrame:
    rows = kept(spark, folder, "llm", "processing_time_ms").where("llm IS NOT NULL AND processing_time_ms >= 0")
    return rows.select("org_id", F.lower(F.trim("llm")).alias("llm"), "processing_time_ms")


def _sketches(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.merge(quantiles.build(_times(spark, folder), ["org_id", "llm"], "processing_time_ms"), ["org_id", "llm"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of at least 40 rows whose 95th percentile is above 50."""
    return quantiles.quantiles(_sketches(spark, folder), ["org_id", "llm"], [0.95]).where("n >= 40 AND value > 50").select("org_id", "llm")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and high percentiles of each group, within the stated error."""
    long = quantiles.quantiles(_sketches(spark, folder), ["org_id", "llm"], [0.5, 0.9, 0.95, 0.99])
    return long.select("org_id", "llm", "n", "fraction", "value")


def p4_rank_error(spark: SparkSession, folder: str) -> DataFrame:
    """Of each answer of p4_percentiles: whether its rank is within the stated error, 1 % of n, of the one asked for. Counts the rows below and up to each answer, exactly."""
    answers = p4_percentiles(spark, folder)
    rows = _times(spark, folder).groupBy("org_id", "llm", F.col("processing_time_ms").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    both = answers.alias("a").join(rows.alias("r"), F.col("a.org_id").eqNullSafe(F.col("r.org_id")) & (F.col("a.llm") == F.col("r.llm")))
    sums = both.groupBy("a.org_id", "a.llm", "n", "fraction").agg(F.sum(F.when(F.col("v") < F.col("value") - 5e-4, F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value") + 5e-4, F.col("k")).otherwise(0)).alias("upto"), F.sum("k").alias("rows"))
    wanted = F.ceil(F.round(F.col("fraction") * F.col("n"), 9))
    within = (F.col("rows") == F.col("n")) & (wanted > F.col("below") - 0.01 * F.col("n")) & (wanted <= F.col("upto") + 0.01 * F.col("n") + 1)
    return sums.select("org_id", "llm", "n", "fraction", within.alias("within"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document's text by byte_bpe_50k."""
    return tokenizer.encode_column(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text")


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and the items of whose text they reproduce at least 24 successive words."""
    return _leaked(spark, folder).select("doc_id", "item_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the length of the passage and how well it was recognised."""
    return _leaked(spark, folder).select("doc_id", "item_id", "words", "matched", F.round("score", 1).alias("score"))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "documents", "doc_id", "text", "lang", "source"))
    return languages.page_languages(pages, table(spark, folder, "lang_codes"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose label is not their only language, a row for each language."""
    return languages.mislabelled(_languages(spark, folder))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every page with its language and confidence."""
    return _languages(spark, folder).select("doc_id", F.explode("segments").alias("s")).select("doc_id", F.col("s.first").alias("first_line"), F.col("s.last").alias("last_line"), F.col("s.lang").alias("lang"), F.round("s.confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (p3_found, p3_associations, p3_active_days, p4_found, p4_percentiles, p4_rank_error, p6_ids, p7_found, p7_report, p8_found, p8_segments)}

_PAIRS = f"""WITH {DELIVERIES_SQL}, named AS (
  SELECT DISTINCT delivery_id, translate(upper(trim(p.part)), '- ', '__') AS item
  FROM (SELECT delivery_id, unnest(threat_categories) AS raw FROM kept) r, unnest(string_split(r.raw, '|')) p(part)
  WHERE trim(p.part) <> ''),
single AS (SELECT item, count(*) AS k FROM named GROUP BY item),
total AS (SELECT count(DISTINCT delivery_id) AS n FROM named),
pairs AS (SELECT a.item AS category_a, b.item AS category_b, count(*) AS n_ab FROM named a JOIN named b ON a.delivery_id = b.delivery_id AND a.item < b.item GROUP BY ALL),
scored AS (SELECT category_a, category_b, n_ab, s.k AS n_a, t.k AS n_b, n FROM pairs JOIN single s ON s.item = category_a JOIN single t ON t.item = category_b, total)"""

SQL = {
    "p3_active_days": """WITH d AS (SELECT DISTINCT org_id, strftime(created_at, '%Y-%m-%d') AS day FROM sync_events WHERE org_id IS NOT NULL AND created_at IS NOT NULL),
      s AS (SELECT day, count(*) AS k FROM d GROUP BY day), p AS (SELECT a.day AS day_a, b.day AS day_b, count(*) AS n_ab FROM d a JOIN d b ON a.org_id = b.org_id AND a.day < b.day GROUP BY ALL)
      SELECT day_a, day_b, n_ab, x.k AS n_a, y.k AS n_b, (SELECT count(DISTINCT org_id) FROM d) AS n FROM p JOIN s x ON x.day = day_a JOIN s y ON y.day = day_b""",
    "p4_rank_error": f"""WITH {DELIVERIES_SQL}, groups AS (SELECT org_id, lower(trim(llm)) AS llm, count(*) AS n FROM kept WHERE llm IS NOT NULL AND processing_time_ms >= 0 GROUP BY ALL)
      SELECT org_id, llm, n, CAST(f AS DOUBLE) AS fraction, true AS within FROM groups, (VALUES (0.5), (0.9), (0.95), (0.99)) q(f)""",
    "p3_found": f"{_PAIRS} SELECT category_a, category_b FROM scored WHERE n_ab >= 5 AND 1000 * n_ab >= n AND n_ab * n >= 3 * n_a * n_b",
    "p3_associations": f"{_PAIRS} SELECT category_a, category_b, n_ab, n_a, n_b, n, round(n_ab::DOUBLE * n / n_a / n_b, 6) AS lift FROM scored",
    "p4_found": f"""WITH {DELIVERIES_SQL}, ranked AS (
      SELECT org_id, lower(trim(llm)) AS llm, processing_time_ms AS v, row_number() OVER (PARTITION BY org_id, lower(trim(llm)) ORDER BY processing_time_ms) AS k,
        count(*) OVER (PARTITION BY org_id, lower(trim(llm))) AS n FROM kept WHERE llm IS NOT NULL AND processing_time_ms >= 0)
      SELECT org_id, llm FROM ranked WHERE n >= 40 AND k = (95 * n + 99) // 100 AND v > 50""",
}
