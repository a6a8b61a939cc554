"""Uploads of events: requests as JSON, their validation, and the organisation behind a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most events of one request.
BATCH_LIMIT = 1_000
EVENT = "struct<timestamp:bigint,llm:string,riskLevel:string,riskScore:int,threatCategories:array<string>,threatCount:int,userDecision:string,processingTimeMs:double>"
REQUEST = f"api_key string, events array<{EVENT}>"
#: Names on the wire and in the store.
NAMES = {"riskLevel": "risk_level", "riskScore": "risk_score", "threatCategories": "threat_categories", "threatCount": "threat_count", "userDecision": "user_decision", "processingTimeMs": "processing_time_ms"}


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """request_id, api_key, events of files with one JSON request a line. A line that isn't one gives null events, which no organisation gets in."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", f"struct<api_key:string,events:array<{EVENT}>>").alias("r"), F.sha2("value", 256).alias("h"))
    return parsed.select(F.col("h").alias("request_id"), "r.api_key", "r.events")


def valid(level: Column, score: Column, stamp: Column, llm: Column, decision: Column) -> Column:
    """Whether an event may be stored: a time, a service, a decision, a level of SAFE, CAUTION, HIGH, a score from 0 to 100. Nulls are not valid, empty texts are."""
    return F.coalesce(stamp.isNotNull() & llm.isNotNull() & decision.isNotNull() & level.isin("SAFE", "CAUTION", "HIGH") & score.between(0, 100), F.lit(False))


def key_hash(api_key: Column) -> Column:
    """What is stored of a key."""
    return F.sha2(api_key, 256)


def with_organisation(rows: DataFrame, organisations: DataFrame, hash_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with org_id of the organisation whose key hash they carry; rows whose hash is null or unknown. Broadcast only if the planner knows the organisations to be few."""
    orgs = organisations.where("api_key_hash IS NOT NULL").select(F.col("api_key_hash").alias("_hash"), F.col("id").alias("org_id"))
    joined = rows.drop("org_id").join(orgs, rows[hash_column] == orgs["_hash"], "left").drop("_hash")
    return joined.where("org_id IS NOT NULL"), joined.where("org_id IS NULL")


def checked(requests: DataFrame, batch: str, level: str, score: str, stamp: str, llm: str, decision: str, limit: int = BATCH_LIMIT) -> DataFrame:
    """batch, n, bad, accepted of each request: one bad event, or more than `limit` events, reject the whole. Partial sums before the shuffle."""
    out = requests.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(~valid(*map(F.col, (level, score, stamp, llm, decision)))).alias("bad"))
    return out.withColumn("accepted", (F.col("bad") == 0) & (F.col("n") <= limit))


def stored_form(events: DataFrame) -> DataFrame:
    """Events of the wire as stored: snake_case names, lists and counts without nulls, times as decimals."""
    out = events.withColumnsRenamed({k: v for k, v in NAMES.items() if k in events.columns})
    return out.withColumns({"threat_categories": F.coalesce("threat_categories", F.array().cast("array<string>")), "threat_count": F.coalesce("threat_count", F.lit(0)), "processing_time_ms": F.coalesce(F.col("processing_time_ms"), F.lit(0.0)).cast("decimal(8,3)")})


def accepted_events(requests: DataFrame, organisations: DataFrame) -> DataFrame:
    """org_id, request_id and the stored form of the events of read_requests that are let in."""
    known, _ = with_organisation(requests.withColumn("_hash_of", key_hash(F.col("api_key"))), organisations, "_hash_of")
    whole = known.where((F.size("events") <= BATCH_LIMIT) & F.forall("events", lambda e: valid(e["riskLevel"], e["riskScore"], e["timestamp"], e["llm"], e["userDecision"])))
    return stored_form(whole.select("org_id", "request_id", F.inline("events")))


def list_to_text(items: Column) -> Column:
    """A list as one text, joined by '|'."""
    return F.array_join(items, "|")


def text_to_list(text: Column) -> Column:
    """Back again: empty items are lost and items that hold '|' are split."""
    return F.filter(F.split(text, r"\|"), lambda x: x != "")


def events_from_range(spark: SparkSession, n: int = 140, now_ms: int = 1_750_000_000_000) -> DataFrame:
    """n made-up events of the last 30 days, the same each time, newest first."""
    r = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000)) / 1_000_000
    pick = lambda x, k: F.element_at(F.array(*map(F.lit, x)), (F.floor(r(k) * len(x)) + 1).cast("int"))
    score = F.when(r(1) < 0.6, 0).otherwise(F.floor(r(2) * 101)).cast("int")
    some = pick(["CLOUD_API_KEY", "DB_CREDENTIALS", "SERVICE_TOKEN", "PERSONAL_CONTACT", "CREDIT_CARD"], 3)
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), (F.lit(now_ms) - F.floor(r(4) * 30 * 86_400_000)).cast("bigint").alias("timestamp"), pick(["ChatGPT", "Claude", "Gemini"], 5).alias("llm"),
        F.when(score <= 30, "SAFE").when(score <= 60, "CAUTION").otherwise("HIGH").alias("risk_level"), score.alias("risk_score"), F.when(score > 0, F.array(some)).otherwise(F.array().cast("array<string>")).alias("threat_categories"),
        F.when(score > 0, 1).otherwise(0).alias("threat_count"), F.when(score > 0, pick(["REDACTED", "SENT_ANYWAY", "CANCELLED"], 6)).otherwise("ALLOWED").alias("user_decision"), F.round(r(7) * 10, 3).alias("processing_time_ms"),
    ).orderBy(F.desc("timestamp"))
