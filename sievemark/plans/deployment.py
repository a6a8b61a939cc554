"""Queries that run a deployment's tables: uploads, the store, its figures, streams, custom patterns, each with its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import EXOTIC_SPACES, SPACES
from ..functions.words import dictionary, looked_up
from ..operators import retention, scoring
from ..operators.seen import SeenBitmaps
from ..session import scratch, spread
from ..sources import ingest
from ..sources.store import Store
from ..sources.tables import table
from ..streaming.store import events_of_texts, ingest_once
from .custom import custom_threats
from .delivered import stored
from .scan import prompts
from .scanning import _SCAN, PLANTED, _case, planted, quoted

QUERIES, SQL = {}, {}
NOW = 1_751_328_000_000


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SPACE = f"[{SPACES}{EXOTIC_SPACES}]"
_TRIMMED = "regexp_replace({0}, " + quoted(rf"\A{_SPACE}+|{_SPACE}+\z") + ", '', 'g')"


@_query(f"SELECT * FROM (SELECT doc_id, md5({_TRIMMED.format('text')}) AS prompt FROM documents WHERE {_TRIMMED.format('text')} <> '')")
def s1_prompts(spark, folder):
    """Texts as they are handed to a scan: trimmed, those without anything dropped."""
    return prompts(spread(table(spark, folder, "documents", "doc_id", "text"))).select("doc_id", F.md5("text").alias("prompt"))


_TRIMMED_SCAN = _SCAN.replace(f"coalesce(text, '') || {_case(PLANTED)} AS given,", f"{_TRIMMED.format("(coalesce(text, '') || " + _case(PLANTED) + ")")} AS given,")


@_query(f"""{_TRIMMED_SCAN} SELECT CAST(doc_id AS VARCHAR) AS id, level AS risk_level, score AS risk_score, categories, threat_count, CASE WHEN threat_count = 0 THEN 'ALLOWED' ELSE 'REDACTED' END AS user_decision, CAST(NULL AS DOUBLE) AS processing_time_ms, pattern_match_count
  FROM result JOIN fit USING (doc_id) WHERE given <> ''""")
def k9_scan_events(spark, folder):
    """What is stored of a scan of every document: no text, no value, no time."""
    rows = planted(spark, folder).select(F.col("doc_id").alias("id"), "text", "sensitivity", F.lit("Claude").alias("llm"), F.lit("REDACTED").alias("user_decision"), F.lit(NOW).alias("timestamp"), F.lit("o").alias("org_id"), F.col("doc_id").alias("arrival"))
    out = events_of_texts(rows, sensitivity=F.col("sensitivity"))
    return out.select("id", "risk_level", "risk_score", F.array_join("threat_categories", "|").alias("categories"), "threat_count", "user_decision", "processing_time_ms", "pattern_match_count")


def _loaded(spark: SparkSession, folder: str, parts: int = 2) -> Store:
    """A store with all of sync_events, appended in parts by delivery number; the first part is sent twice under its number."""
    store = Store(spark, scratch(spark, "store"))
    rows = table(spark, folder, "sync_events").withColumns({"arrival": F.col("delivery_id"), "risk_score": F.col("risk_score").cast("int"), "threat_count": F.col("threat_count").cast("int")})
    for k in (0, *range(parts)):
        store.append(rows.where(F.col("delivery_id") % parts == k), NOW, source=("load", k))
    return store


_STORED = f"stored AS (SELECT delivery_id, org_id, id, coalesce(\"timestamp\", {NOW}) AS ts, llm, risk_level, risk_score, coalesce(threat_categories, []) AS cats, coalesce(threat_count, 0) AS threat_count, user_decision FROM sync_events)"


@_query(f"WITH {_STORED} SELECT delivery_id AS arrival, org_id, id, ts AS \"timestamp\", threat_count, array_to_string(cats, '|') AS categories FROM stored WHERE id IS NOT NULL")
def s3_stored_events(spark, folder):
    """Every event of the store, with its defaults."""
    rows = _loaded(spark, folder).events()
    given = table(spark, folder, "sync_events", F.col("delivery_id").alias("arrival")).where("id IS NOT NULL")  # others got a random id
    return rows.join(given, "arrival", "left_semi").select("arrival", "org_id", "id", "timestamp", "threat_count", F.array_join("threat_categories", "|").alias("categories"))


@_query("SELECT delivery_id AS arrival, llm FROM sync_events WHERE org_id = (SELECT arg_min(org_id, delivery_id) FROM sync_events WHERE id <> '') AND id = (SELECT arg_min(id, delivery_id) FROM sync_events WHERE id <> '')")
def s4_one_event(spark, folder):
    """The event of a key, read from its organisation's folders only."""
    first = table(spark, folder, "sync_events").where("id <> ''").agg(F.min_by(F.struct("org_id", "id"), "delivery_id").alias("k")).select("k.*").first()
    return _loaded(spark, folder).event(first["org_id"], first["id"]).select("arrival", "llm")


@_query(f"WITH {_STORED}, counted AS (SELECT org_id, count(*) AS total FROM stored GROUP BY org_id) SELECT org_id, total + (SELECT count(*) FROM stored s WHERE s.org_id = c.org_id AND delivery_id % 2 = 1) AS total, (SELECT count(*) FROM stored s WHERE s.org_id = c.org_id AND delivery_id % 2 = 1) AS stored_events FROM counted c")
def k4_cleared(spark, folder):
    """After the store is cleared and half the events come again: what it holds, and what the lifetime counter says."""
    store = _loaded(spark, folder)
    store.clear()
    store.append(table(spark, folder, "sync_events").withColumn("arrival", F.col("delivery_id")).where("delivery_id % 2 = 1"), NOW)
    held = store.events().groupBy("org_id").agg(F.count(F.lit(1)).alias("k"))
    return store.total_scans().join(held, "org_id", "left").select("org_id", "total", F.coalesce("k", F.lit(0)).alias("stored_events"))


@_query("""SELECT org_id, id, coalesce("timestamp", 1751328000000) AS ts, array_to_string(coalesce(threat_categories, []), '|') AS categories, CAST(coalesce(threat_count, 0) AS INTEGER) AS threat_count, 0 AS pattern_match_count FROM sync_events WHERE id IS NOT NULL""")
def k1_defaults(spark, folder):
    """Events with the defaults of the store."""
    out = retention.with_defaults(table(spark, folder, "sync_events").where("id IS NOT NULL"), NOW)
    return out.select("org_id", "id", F.col("timestamp").alias("ts"), F.array_join("threat_categories", "|").alias("categories"), "threat_count", "pattern_match_count")


@_query("SELECT count(*) AS n, count(*) AS distinct_ids, true AS well_formed FROM sync_events WHERE id IS NULL")
def f8_new_ids(spark, folder):
    """Ids that events without one get: each its own, of the usual form."""
    made = retention.with_defaults(table(spark, folder, "sync_events", "id").where("id IS NULL"))
    form = F.coalesce(F.bool_and(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), F.lit(True))
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct_ids"), form.alias("well_formed"))


@_query("SELECT id, sha256(id) AS hash, 'trial' AS plan, 10 AS max_users FROM organizations")
def s10_bootstrap(spark, folder):
    """Organisations added twice, half of them before: each is there once, its key as a hash."""
    store = Store(spark, scratch(spark, "store"))
    rows = table(spark, folder, "organizations").select("id", "name", F.col("id").alias("api_key"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for part in (rows.where(half), rows, rows):
        store.bootstrap(part)
    return store.organisations().select("id", F.col("api_key_hash").alias("hash"), "plan", "max_users")


_SINCE = NOW - NOW % 86_400_000


@_query(f"""WITH {_STORED}, last AS (SELECT org_id, max(delivery_id) AS l, count(*) AS total_scans FROM stored GROUP BY org_id),
  r AS (SELECT s.*, l, total_scans, row_number() OVER (PARTITION BY s.org_id, delivery_id = l ORDER BY ts DESC, id DESC) AS k FROM stored s JOIN last USING (org_id)), b AS (SELECT * FROM r WHERE delivery_id = l OR k <= 499),
  o AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY ts DESC, delivery_id) AS place FROM b)
  SELECT org_id, max(total_scans) AS total_scans, count(*) AS stored_events, count(*) FILTER (ts >= {_SINCE}) AS today_scans, count(*) FILTER (ts >= {_SINCE} AND threat_count > 0) AS today_threats, count(*) FILTER (threat_count > 0) AS threats_caught,
    coalesce(min(place) FILTER (threat_count <> 0) - 1, count(*)) AS clean_streak FROM o GROUP BY org_id""")
def s11_stats_message(spark, folder):
    """The answer to a message that asks for the figures of what the bounded store holds."""
    answer = _loaded(spark, folder).handle({"type": "STATS"}, NOW)
    return answer["stats"].select("org_id", "total_scans", "stored_events", "today_scans", "today_threats", "threats_caught", "clean_streak")


_ORG = "(SELECT org_id FROM sync_events GROUP BY org_id ORDER BY count(*) DESC, org_id LIMIT 1)"


@_query(f"""WITH {_STORED}, mine AS (SELECT * FROM stored WHERE org_id = {_ORG}), named AS (SELECT delivery_id, unnest(cats) AS c FROM mine), top AS (SELECT c, count(*) AS n FROM named GROUP BY c ORDER BY n DESC, min(delivery_id), c LIMIT 8)
  SELECT 'total' AS figure, '' AS key, count(*) AS n FROM mine UNION ALL SELECT 'threats', '', count(*) FILTER (threat_count > 0) FROM mine
  UNION ALL SELECT 'redaction_rate', '', CAST(round_even(count(*) FILTER (user_decision = 'REDACTED') / count(*) FILTER (threat_count > 0) * 100, 0) AS BIGINT) FROM mine
  UNION ALL SELECT 'by_risk', coalesce(risk_level, ''), count(*) FROM mine GROUP BY 2 UNION ALL SELECT 'by_llm', coalesce(llm, ''), count(*) FROM mine GROUP BY 2 UNION ALL SELECT 'top', c, n FROM top""")
def u5_summary(spark, folder):
    """The summary of the organisation with the most events, as the store gives it."""
    org = table(spark, folder, "sync_events", "org_id").groupBy("org_id").count().orderBy(F.desc("count"), "org_id").first()["org_id"]
    s = _loaded(spark, folder).summary(org)
    rows = [(k, "", s[k]) for k in ("total", "threats", "redaction_rate")] + [(k, v or "", n) for k in ("by_risk", "by_llm") for v, n in s[k].items()] + [("top", c, n) for c, n in s["top_categories"]]
    return spark.createDataFrame(rows, "figure string, key string, n bigint")


@_query(f"""WITH {_STORED}, d AS (SELECT strftime(CAST(DATE '1970-01-01' + CAST(floor(ts / 86400000) AS INTEGER) AS DATE), '%m-%d') AS label, sum(coalesce(risk_score, 0)) / count(*) AS m FROM stored WHERE org_id = {_ORG} AND ts BETWEEN 1000000000000 AND 2000000000000 GROUP BY 1)
  SELECT label, CAST(round_even(m, 0) AS BIGINT) AS value FROM d ORDER BY label DESC LIMIT 7""")
def u5_trend(spark, folder):
    """The last seven days of an organisation in the store, of events whose clock counts in milliseconds."""
    org = table(spark, folder, "sync_events", "org_id").groupBy("org_id").count().orderBy(F.desc("count"), "org_id").first()["org_id"]
    store = Store(spark, scratch(spark, "store"))
    rows = retention.with_defaults(table(spark, folder, "sync_events"), NOW).where("timestamp BETWEEN 1000000000000 AND 2000000000000")
    store.append(rows.withColumns({"arrival": F.col("delivery_id"), "risk_score": F.col("risk_score").cast("int")}))
    return store.trend(org, 7)


@_query("""WITH j AS (SELECT e.*, o.id AS org_id FROM event_in e JOIN organizations o ON o.api_key_hash = e.api_key_hash),
  good AS (SELECT batch_id, org_id FROM j GROUP BY ALL HAVING count(*) <= 1000 AND bool_and(coalesce("timestamp" IS NOT NULL AND llm IS NOT NULL AND userdecision IS NOT NULL AND risklevel IN ('SAFE', 'CAUTION', 'HIGH') AND riskscore BETWEEN 0 AND 100, false)))
  SELECT org_id, count(*) AS n, CAST(sum(riskscore) AS BIGINT) AS scores, CAST(sum(coalesce(len(threatcategories), 0)) AS BIGINT) AS categories FROM j JOIN good USING (batch_id, org_id) GROUP BY org_id""")
def s8_requests(spark, folder):
    """Uploads written as JSON, one request of one organisation a line, read back, validated and let in whole or not at all."""
    orgs = table(spark, folder, "organizations", "id", "api_key_hash")
    event = F.struct(*(F.col(k.lower()).alias(k) for k in ("timestamp", "llm", "riskLevel", "riskScore", "threatCategories", "threatCount", "userDecision", "processingTimeMs")))
    # a request has as many events as its batch, which uploads bound; its key is the organisation's id here
    sent = table(spark, folder, "event_in").join(orgs, "api_key_hash").groupBy("batch_id", F.col("id").alias("api_key")).agg(F.collect_list(event).alias("events"))
    sent.select(F.to_json(F.struct("api_key", "events", "batch_id"), {"ignoreNullFields": "false"}).alias("value")).write.text(to := scratch(spark, "requests"))
    keys = orgs.select("id", ingest.key_hash(F.col("id")).alias("api_key_hash"))
    out = ingest.accepted_events(ingest.read_requests(spark, to), keys)
    return out.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("scores"), F.sum(F.size("threat_categories").cast("bigint")).alias("categories"))


@_query()
def s9_made_events(spark, folder):
    """Made-up events, the same each time."""
    return ingest.events_from_range(spark, 140)


@_query("""WITH m AS (SELECT org_id, CASE WHEN id IS NULL OR id = '' THEN CAST(delivery_id AS VARCHAR) ELSE '#' || regexp_replace(lower(id), '[^0-9a-f]', '', 'g') END AS k, delivery_id FROM sync_events)
  SELECT org_id, count(*) AS n, CAST(sum(delivery_id) AS BIGINT) AS ids FROM (SELECT org_id, k, min(delivery_id) AS delivery_id FROM m GROUP BY ALL) GROUP BY org_id""")
def t5_ingested(spark, folder):
    """sync_events as a stream of files, each message taken in once: what the sink holds."""
    stored(spark, folder).write.parquet(source := scratch(spark, "arrivals"))
    schema = spark.read.parquet(source).schema
    store, sink = SeenBitmaps(spark, scratch(spark, "seen")), scratch(spark, "sink")
    ingest_once(spark.readStream.schema(schema).parquet(source), store, sink, scratch(spark, "stream")).awaitTermination()
    return spark.read.schema("delivery_id bigint, org_id string").parquet(f"{sink}/query=*/batch=*").groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.sum("delivery_id").alias("ids"))


@_query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM custom_patterns WHERE org_id IS NOT NULL AND pattern <> '')
  SELECT org_id, coalesce(name, '') AS name, pattern FROM p WHERE k BETWEEN 2 AND 3""")
def k8_patterns(spark, folder):
    """Three patterns added to the store, the first made inactive: what is active."""
    store = Store(spark, scratch(spark, "store"))
    rows = table(spark, folder, "custom_patterns").where("org_id IS NOT NULL AND pattern <> ''").orderBy("id").limit(3).collect()
    ids = [store.add_pattern(r["org_id"], r["name"] or "", r["pattern"], r["category"] or "CUSTOM") for r in rows]
    store.remove_pattern(rows[0]["org_id"], ids[0])
    return store.patterns().select("org_id", "name", "pattern")


SAID = (" payroll no. 12 and PAYR-1234", " the merger file of Project Linmoor", " TENDER-7, tender file", " PATIENT-9 PATIENT-10", " ROST-123 Project Brasket", "")


@_query(f"""WITH orgs AS (SELECT id AS org_id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM organizations),
  d AS (SELECT doc_id, org_id, translate(coalesce(text, '') || {_case(SAID)}, {quoted(EXOTIC_SPACES)}, repeat(chr(11), {len(EXOTIC_SPACES)})) AS text FROM documents JOIN orgs ON doc_id % n = k),
  p AS (SELECT org_id, id, category, coalesce(score, 50) AS score, CASE WHEN regexp_matches(pattern, '[\\\\\\[\\](){{}}|*+?^$]') THEN replace(pattern, '\\s', '[{SPACES}]') ELSE '(?i)' || regexp_escape(pattern) END AS r FROM custom_patterns WHERE is_active AND pattern <> ''),
  hits AS (SELECT doc_id, p.id, category, score, len(string_split_regex(text, r)) - 1 AS c FROM d JOIN p USING (org_id) WHERE regexp_matches(text, r))
  SELECT doc_id, string_agg(id || ':' || c, '|' ORDER BY id) AS found, CAST(least(100, max(score) + 5 * (count(*) - 1)) AS INTEGER) AS score FROM hits GROUP BY doc_id""")
def u2_custom_patterns(spark, folder):
    """Every document against the active patterns of its organisation; the documents belong to the organisations in turn."""
    orgs = table(spark, folder, "organizations", "id").orderBy("id").toPandas()["id"].tolist()  # fixed, sixty rows
    own = F.element_at(F.array(*map(F.lit, orgs)), (F.col("doc_id") % len(orgs) + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    docs = spread(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", own.alias("org_id"), F.concat(F.coalesce("text", F.lit("")), said).alias("text"))
    out = custom_threats(docs, table(spark, folder, "custom_patterns")).where(F.size("custom") > 0)
    shown = F.array_join(F.transform("custom", lambda x: F.concat(x["id"], F.lit(":"), x["count"].cast("string"))), "|")
    return out.select("doc_id", shown.alias("found"), scoring.composite_score(F.transform("custom", lambda x: x["score"])).alias("score"))


@_query("""WITH words AS (SELECT lower(category) AS word, arg_max(name, id) AS meta FROM custom_patterns WHERE category <> '' GROUP BY 1), asked AS (SELECT DISTINCT left(lower(category), n) AS q FROM custom_patterns, (VALUES (3), (7), (99)) v(n) WHERE category IS NOT NULL UNION SELECT 'zzz')
  SELECT q, coalesce(bool_or(word = q), false) AS has, coalesce(bool_or(starts_with(word, q)), false) AS starts, max(meta) FILTER (word = q) AS meta FROM asked LEFT JOIN words ON true GROUP BY q""")
def x4_lookups(spark, folder):
    """Words, beginnings of words and values in a dictionary of the categories."""
    rows = table(spark, folder, "custom_patterns").withColumn("word", F.lower("category"))
    asked = rows.where("category IS NOT NULL").select(F.explode(F.array(*(F.left("word", F.lit(n)) for n in (3, 7, 99)))).alias("q")).unionByName(spark.createDataFrame([("zzz",)], "q string"))
    return looked_up(asked, dictionary(rows, "word", "name", "id"))


@_query("""SELECT delivery_id, CASE risk_level WHEN 'HIGH' THEN 'HIGH RISK' ELSE risk_level END || ' · ' || risk_score || '/100' AS risk, CASE WHEN threat_count > 1 THEN '×' || threat_count ELSE '' END AS count, CAST(greatest(4, risk_score + 0) AS INTEGER) AS width FROM sync_events WHERE risk_score IS NOT NULL""")
def f12_labels(spark, folder):
    """What a dialog shows of an event."""
    rows = table(spark, folder, "sync_events", "delivery_id", "risk_level", "risk_score", "threat_count").where("risk_score IS NOT NULL")
    return rows.select("delivery_id", scoring.risk_label(F.col("risk_level"), F.col("risk_score")).alias("risk"), scoring.count_label(F.col("threat_count")).alias("count"), scoring.bar_width(F.col("risk_score")).alias("width"))
