"""Queries of the scan and of the event figures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionary import VALIDATORS, llm_of_host
from ..functions.entropy import shannon_entropy
from ..functions.idents import hex_ident
from ..functions.spans import find_literals, has_literal
from ..functions.timing import event_time_ms
from ..operators import analytics, automaton, detect, redact, retention, scoring
from ..sources import export, ingest
from ..session import spread
from ..sources.tables import table
from .scanning import PLANTED, _case, planted

def events(spark: SparkSession, folder: str) -> DataFrame:
    """sync_events with the event time as ms."""
    return table(spark, folder, "sync_events").withColumn("ms", event_time_ms(F.col("timestamp")))


_EVENTS_SQL = """events_ AS (SELECT *, CASE WHEN "timestamp" <= 0 THEN NULL WHEN "timestamp" < 100000000000 THEN "timestamp" * 1000
  WHEN "timestamp" >= 100000000000000 THEN "timestamp" // 1000 ELSE "timestamp" END AS ms FROM sync_events)"""
_DAY = "CAST(DATE '1970-01-01' + CAST(ms // 86400000 AS INTEGER) AS DATE)"
QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ── parts of the scan ──


LITERALS = ("the", "he", "here", "er", "ana", "ssi")


@_query("WITH words(p) AS (VALUES " + ", ".join(f"('{x}')" for x in LITERALS) + """), hits AS (
  SELECT doc_id, p, unnest(list_filter(range(1, CAST(length(text) AS BIGINT) - length(p) + 2), lambda i: substring(text, i, length(p)) = p)) AS i FROM documents, words WHERE contains(text, p))
  SELECT p AS pattern, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(sum(i - 1) AS BIGINT) AS starts, CAST(sum(i - 1 + length(p)) AS BIGINT) AS ends FROM hits GROUP BY p""")
def x2_literals(spark, folder):
    """Every occurrence of some literals, overlapping ones too."""
    rows = spread(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", F.inline(find_literals(F.col("text"), list(LITERALS))))
    # the number of documents: a row a document and literal first, then a row a literal
    per = rows.groupBy("pattern", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("s"), F.sum("end").alias("e"))
    return per.groupBy("pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.sum("s").alias("starts"), F.sum("e").alias("ends"))


WORDS = (*LITERALS, "erf", "age", "and", "an", "n", "und", "der", "les", "que", "ou", "tion", "ing", "é", "ß", ".\n")


@_query("WITH words(p) AS (VALUES " + ", ".join(f"('{x}')" for x in WORDS) + """), hits AS (
  SELECT doc_id, p, len(list_filter(range(1, CAST(length(text) AS BIGINT) - length(p) + 2), lambda i: substring(text, i, length(p)) = p)) AS k FROM documents, words WHERE contains(text, p))
  SELECT p AS word, 'w:' || p AS meta, CAST(sum(k) AS BIGINT) AS n, count(*) AS docs FROM hits GROUP BY p""")
def x1_automaton(spark, folder):
    """Many words at once, by one automaton, with a value each."""
    return automaton.word_counts(spread(table(spark, folder, "documents", "text")), [(w, f"w:{w}") for w in WORDS])


@_query(f"SELECT doc_id, contains(text, 'ghp_') OR contains(text, 'system prompt') AS hit FROM (SELECT doc_id, coalesce(text, '') || {_case(PLANTED)} AS text FROM documents)")
def x3_any_literal(spark, folder):
    return planted(spark, folder).select("doc_id", has_literal(F.col("text"), ["ghp_", "system prompt"]).alias("hit"))


@_query("""WITH words AS (SELECT DISTINCT lower(category) AS word FROM custom_patterns WHERE category IS NOT NULL), asked(q) AS (VALUES ('payroll_draft'), ('merger'), ('roster_'), ('zzz'))
  SELECT q, bool_or(word = q) AS has, bool_or(starts_with(word, q)) AS starts, count(*) AS size FROM asked, words GROUP BY q""")
def x4_dictionary(spark, folder):
    """A dictionary of words: whether it has a word, a word that begins so, and its size."""
    words = table(spark, folder, "custom_patterns").where("category IS NOT NULL").select(F.lower("category").alias("word")).distinct()
    asked = ("payroll_draft", "merger", "roster_", "zzz")
    answers = F.array(*(F.struct(F.lit(q).alias("q"), F.bool_or(F.col("word") == q).alias("has"), F.bool_or(F.startswith("word", F.lit(q))).alias("starts")) for q in asked))
    return words.agg(answers.alias("a"), F.count(F.lit(1)).alias("size")).select(F.inline("a"), "size")


@_query("""WITH numbers AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') || ' ' || lpad(CAST(o_custkey * 104729 % 1000000 AS VARCHAR), 6, '0') AS number FROM orders),
  digits AS (SELECT o_orderkey, list_reverse(list_transform(string_split(replace(number, ' ', ''), ''), lambda c: CAST(c AS INTEGER))) AS d FROM numbers)
  SELECT o_orderkey, list_sum(list_transform(range(1, CAST(len(d) + 1 AS BIGINT)), lambda i: CASE WHEN i % 2 = 1 THEN d[i] WHEN d[i] > 4 THEN 2 * d[i] - 9 ELSE 2 * d[i] END)) % 10 = 0 AS valid FROM digits""")
def x6_luhn(spark, folder):
    number = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919 % 1_000_000_000).cast("string"), 9, "0"), F.lit(" "), F.lpad((F.col("o_custkey") * 104_729 % 1_000_000).cast("string"), 6, "0"))
    return table(spark, folder, "orders", "o_orderkey", "o_custkey").select("o_orderkey", VALIDATORS["luhn"](number).alias("valid"))


@_query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), k AS (SELECT p_partkey, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL), t AS (SELECT p_partkey, sum(n) AS t FROM k GROUP BY ALL)
  SELECT p_partkey, round(sum(-(n / t) * log2(n / t)), 9) AS bits FROM k JOIN t USING (p_partkey) GROUP BY p_partkey""")
def x7_entropy(spark, folder):
    return table(spark, folder, "part", "p_partkey", "p_name").where("p_name <> ''").select("p_partkey", F.round(shannon_entropy(F.col("p_name")), 9).alias("bits"))


@_query("SELECT delivery_id, CASE WHEN risk_score <= 30 THEN 'SAFE' WHEN risk_score <= 60 THEN 'CAUTION' WHEN risk_score > 60 THEN 'HIGH' END AS level FROM sync_events")
def x21_levels(spark, folder):
    return table(spark, folder, "sync_events", "delivery_id", "risk_score").select("delivery_id", scoring.risk_level(F.col("risk_score")).alias("level"))


@_query("SELECT l_orderkey, CAST(least(100, max(l_linenumber * 12) + 5 * (count(*) - 1)) AS INTEGER) AS score FROM lineitem GROUP BY l_orderkey")
def x22_composite(spark, folder):
    """Scores of sets of threats, which the lines of an order stand for."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.collect_list((F.col("l_linenumber") * 12).cast("int")).alias("s"))
    return lines.select("l_orderkey", scoring.composite_score(F.col("s")).alias("score"))


_SPANS_SQL = """spans AS (SELECT l_orderkey, l_linenumber AS seq, CAST(l_partkey % 60 AS INTEGER) AS s, CAST(l_partkey % 60 + 1 + l_suppkey % 9 AS INTEGER) AS e, CAST(l_partkey % 7 AS INTEGER) AS score, 'P' || l_linenumber AS placeholder FROM lineitem)"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    start = (F.col("l_partkey") % 60).cast("int")
    return lines.select("l_orderkey", start.alias("start"), (start + 1 + F.col("l_suppkey") % 9).cast("int").alias("end"), F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("placeholder"), (F.col("l_partkey") % 7).cast("int").alias("score"), F.col("l_linenumber").cast("int").alias("seq"))


_ISLANDS = f"""WITH {_SPANS_SQL}, m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e, seq ROWS UNBOUNDED PRECEDING) AS island FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, island ORDER BY score DESC, s, e, seq) AS k FROM i)
  SELECT l_orderkey, min(s) AS "start", max(e) AS "end", max(placeholder) FILTER (k = 1) AS placeholder FROM r GROUP BY l_orderkey, island"""


@_query(_ISLANDS)
def x27_merge_spans(spark, folder):
    """Overlapping spans of a row merged within the row."""
    held = _spans(spark, folder).groupBy("l_orderkey").agg(F.collect_list(F.struct("start", "end", "placeholder", "score", "seq")).alias("s"))
    return held.select("l_orderkey", F.inline(redact.merge_spans(F.col("s")))).select("l_orderkey", "start", "end", "placeholder")


@_query(_ISLANDS)
def w2_span_islands(spark, folder):
    """The same on rows, by a window."""
    return redact.merge_span_rows(_spans(spark, folder), "l_orderkey")


@_query(f"""WITH {_SPANS_SQL} SELECT l_orderkey, seq FROM spans m WHERE NOT EXISTS (
  SELECT 1 FROM spans o WHERE o.l_orderkey = m.l_orderkey AND o.seq <> m.seq AND o.s <= m.s AND o.e >= m.e AND o.e - o.s > m.e - m.s AND o.score >= m.score)""")
def j4_without_contained(spark, folder):
    """Spans that lie in no longer, at least as severe one."""
    held = _spans(spark, folder).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("seq").alias("ord"), "start", "end", "score")).alias("s"))
    return held.select("l_orderkey", F.inline(detect.without_contained(F.col("s")))).select("l_orderkey", F.col("ord").alias("seq"))


@_query(f"""WITH {_SPANS_SQL} SELECT a.l_orderkey, a.seq FROM spans a WHERE a.seq > 2 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.l_orderkey = a.l_orderkey AND b.seq <= 2 AND a.s < b.e AND b.s < a.e)""")
def j5_without_overlap(spark, folder):
    """Later spans that overlap none of the first two: an anti-join on the key with a range condition."""
    spans = _spans(spark, folder)
    return redact.without_overlap(spans.where("seq > 2"), spans.where("seq <= 2"), "l_orderkey").select("l_orderkey", "seq")


@_query("SELECT delivery_id, CASE regexp_replace(h, '^www\\.', '') WHEN 'chatgpt.com' THEN 'ChatGPT' WHEN 'chat.openai.com' THEN 'ChatGPT' WHEN 'claude.ai' THEN 'Claude' WHEN 'gemini.google.com' THEN 'Gemini' END AS llm FROM (SELECT delivery_id, CASE delivery_id % 5 WHEN 0 THEN 'www.claude.ai' WHEN 1 THEN 'chatgpt.com' WHEN 2 THEN 'gemini.google.com' WHEN 3 THEN 'chat.openai.com' ELSE 'example.org' END AS h FROM event_in)")
def s2_hosts(spark, folder):
    host = F.element_at(F.array(*map(F.lit, ("www.claude.ai", "chatgpt.com", "gemini.google.com", "chat.openai.com", "example.org"))), (F.col("delivery_id") % 5 + 1).cast("int"))
    return table(spark, folder, "event_in", "delivery_id").select("delivery_id", llm_of_host(host).alias("llm"))


# ── the store and the uploads ──


@_query("SELECT delivery_id, id FROM sync_events WHERE org_id = (SELECT min(id) FROM organizations)")
def s7_one_organisation(spark, folder):
    """The events of one organisation: an equality that reaches the scan."""
    org = table(spark, folder, "organizations", "id").agg(F.min("id")).scalar()
    return table(spark, folder, "sync_events", "delivery_id", "id", "org_id").where(F.col("org_id") == org).select("delivery_id", "id")


@_query(f"WITH {_EVENTS_SQL} SELECT delivery_id, ms FROM events_ WHERE ms IS NOT NULL ORDER BY ms, delivery_id LIMIT 1")
def s5_oldest(spark, folder):
    return analytics.oldest(events(spark, folder), ms="ms").select("delivery_id", "ms")


@_query("SELECT count(*) AS n FROM sync_events")
def s6_count(spark, folder):
    return table(spark, folder, "sync_events").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH j AS (SELECT e.*, o.id AS org_id FROM event_in e LEFT JOIN organizations o ON o.api_key_hash = e.api_key_hash)
  SELECT batch_id, count(*) AS n, count(*) FILTER (NOT coalesce("timestamp" IS NOT NULL AND llm IS NOT NULL AND userdecision IS NOT NULL AND risklevel IN ('SAFE', 'CAUTION', 'HIGH') AND riskscore BETWEEN 0 AND 100, false)) AS bad,
    count(*) FILTER (NOT coalesce("timestamp" IS NOT NULL AND llm IS NOT NULL AND userdecision IS NOT NULL AND risklevel IN ('SAFE', 'CAUTION', 'HIGH') AND riskscore BETWEEN 0 AND 100, false)) = 0 AND count(*) <= 1000 AS accepted FROM j WHERE org_id IS NOT NULL GROUP BY batch_id""")
def s8_checked_batches(spark, folder):
    """Uploads with a known key: which are let in whole."""
    known, _ = ingest.with_organisation(table(spark, folder, "event_in"), table(spark, folder, "organizations"), "api_key_hash")
    return ingest.checked(known, "batch_id", "risklevel", "riskscore", "timestamp", "llm", "userdecision")


@_query("SELECT e.delivery_id FROM event_in e WHERE NOT EXISTS (SELECT 1 FROM organizations o WHERE o.api_key_hash = e.api_key_hash)")
def flt11_unknown_keys(spark, folder):
    _, unknown = ingest.with_organisation(table(spark, folder, "event_in"), table(spark, folder, "organizations"), "api_key_hash")
    return unknown.select("delivery_id")


@_query("SELECT id, sha256(id) AS hash FROM organizations")
def flt11_key_hashes(spark, folder):
    return table(spark, folder, "organizations", "id").select("id", ingest.key_hash(F.col("id")).alias("hash"))


@_query("""SELECT delivery_id, llm, risklevel AS risk_level, riskscore AS risk_score, array_to_string(coalesce(threatcategories, []), '|') AS categories, coalesce(threatcount, 0) AS threat_count, userdecision AS user_decision, round(coalesce(processingtimems, 0), 3)::DOUBLE AS ms FROM event_in""")
def k5_stored_form(spark, folder):
    """Uploaded events in the form of the store."""
    wire = table(spark, folder, "event_in").withColumnsRenamed({k.lower(): k for k in ingest.NAMES})
    out = ingest.stored_form(wire)
    return out.select("delivery_id", "llm", "risk_level", "risk_score", ingest.list_to_text(F.col("threat_categories")).alias("categories"), "threat_count", "user_decision", F.col("processing_time_ms").cast("double").alias("ms"))


@_query("SELECT delivery_id, list_filter(string_split(array_to_string(threat_categories, '|'), '|'), lambda x: x <> '') AS items FROM sync_events WHERE threat_categories IS NOT NULL")
def d12_list_codec(spark, folder):
    """Lists as text and back: what is lost."""
    rows = table(spark, folder, "sync_events", "delivery_id", "threat_categories").where("threat_categories IS NOT NULL")
    return rows.select("delivery_id", ingest.text_to_list(ingest.list_to_text(F.col("threat_categories"))).alias("items"))


@_query(f"""WITH {_EVENTS_SQL}, last AS (SELECT org_id, max(delivery_id) AS l FROM events_ GROUP BY org_id),
  r AS (SELECT e.org_id, e.delivery_id, l, row_number() OVER (PARTITION BY e.org_id, e.delivery_id = l ORDER BY ms DESC NULLS LAST, e.delivery_id DESC) AS k FROM events_ e JOIN last USING (org_id))
  SELECT org_id, delivery_id FROM r WHERE delivery_id = l OR k <= 499""")
def t1_bounded_store(spark, folder):
    """What a store of 500 events holds for each organisation."""
    return retention.bounded_store(events(spark, folder).select("org_id", "delivery_id", "ms"), "org_id", stamp="ms").select("org_id", "delivery_id")


@_query("SELECT org_id, count(*) AS total FROM sync_events GROUP BY org_id")
def t3_lifetime_count(spark, folder):
    return table(spark, folder, "sync_events", "org_id").groupBy("org_id").agg(F.count(F.lit(1)).alias("total"))


@_query(f"""WITH {_EVENTS_SQL} SELECT coalesce(strftime({_DAY}, '%Y-%m-%d') || 'T' || lpad(CAST(ms // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z', '')
  || ',' || coalesce(llm, '') || ',' || coalesce(risk_level, '') || ',' || coalesce(CAST(risk_score AS VARCHAR), '') || ',"' || coalesce(array_to_string(threat_categories, '|'), '') || '",' || coalesce(CAST(threat_count AS VARCHAR), '') || ',' || coalesce(user_decision, '') || ',' || coalesce(CAST(processing_time_ms AS VARCHAR), '') AS line FROM events_""")
def k6_csv(spark, folder):
    return export.csv_lines(events(spark, folder), "ms")


@_query("SELECT id, org_id, CASE WHEN id = (SELECT min(id) FROM custom_patterns) AND org_id = (SELECT min_by(org_id, id) FROM custom_patterns) THEN false ELSE is_active END AS is_active FROM custom_patterns")
def k7_soft_delete(spark, folder):
    patterns = table(spark, folder, "custom_patterns")
    first = patterns.orderBy("id").select("id", "org_id").first()
    return retention.soft_deleted(patterns, first["org_id"], first["id"]).select("id", "org_id", "is_active")


@_query("SELECT org_id, id, name, coalesce(score, 50) AS score FROM custom_patterns WHERE is_active")
def flt9_active_patterns(spark, folder):
    return table(spark, folder, "custom_patterns").where("is_active").select("org_id", "id", "name", F.coalesce("score", F.lit(50)).alias("score"))


# ── the figures ──


@_query("""SELECT org_id, count(*) AS total, count(*) FILTER (coalesce(threat_count, 0) > 0) AS threats, CAST(CASE WHEN count(*) FILTER (coalesce(threat_count, 0) > 0) > 0
  THEN round_even(count(*) FILTER (user_decision = 'REDACTED') / count(*) FILTER (coalesce(threat_count, 0) > 0) * 100, 0) ELSE 0 END AS BIGINT) AS redaction_rate FROM sync_events GROUP BY org_id""")
def a1_summary(spark, folder):
    return analytics.summary(table(spark, folder, "sync_events", "org_id", "threat_count", "user_decision"), "org_id")


@_query("SELECT org_id, risk_level, count(*) AS n FROM sync_events GROUP BY ALL")
def a2_by_risk(spark, folder):
    return analytics.counts_by(table(spark, folder, "sync_events", "org_id", "risk_level"), "risk_level", "org_id")


@_query("SELECT org_id, llm, count(*) AS n FROM sync_events GROUP BY ALL")
def a3_by_llm(spark, folder):
    return analytics.counts_by(table(spark, folder, "sync_events", "org_id", "llm"), "llm", "org_id")


_NAMED = "named AS (SELECT org_id, delivery_id, unnest(threat_categories) AS category FROM sync_events), per AS (SELECT org_id, category, count(*) AS n, min(delivery_id) AS seen FROM named GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY n DESC, seen, category) AS place FROM per)"


@_query(f"WITH {_NAMED} SELECT org_id, category, n, place FROM placed WHERE place <= 8")
def a4_top_categories(spark, folder):
    return analytics.top_categories(table(spark, folder, "sync_events", "org_id", "delivery_id", "threat_categories"), "delivery_id", "org_id")


@_query(f"""WITH {_EVENTS_SQL}, d AS (SELECT org_id, strftime({_DAY}, '%m-%d') AS label, sum(coalesce(risk_score, 0)) / count(*) AS m FROM events_ WHERE ms IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY label DESC) AS k FROM d) SELECT org_id, label, CAST(round_even(m, 0) AS BIGINT) AS value FROM r WHERE k <= 30""")
def a5_trend(spark, folder):
    return analytics.trend(events(spark, folder).select("org_id", "ms", "risk_score"), "org_id", ms="ms")


_STREAK_CTE = f"""WITH {_EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY ms DESC NULLS LAST, delivery_id) AS k FROM events_),
  f AS (SELECT org_id, min(k) FILTER (threat_count IS NULL OR threat_count <> 0) AS stop, count(*) AS total, count(*) FILTER (threat_count > 0) AS threats, count(*) FILTER (user_decision = 'REDACTED') AS red FROM o GROUP BY org_id)"""
_STREAK = f"""{_STREAK_CTE}
  SELECT org_id, total, threats AS threats_caught, CAST(CASE WHEN threats > 0 THEN floor(red / threats * 100 + 0.5) ELSE 0 END AS BIGINT) AS redaction_rate, coalesce(stop - 1, total) AS clean_streak FROM f"""


@_query(_STREAK)
def a6_stats(spark, folder):
    return analytics.stats(events(spark, folder).select("org_id", "ms", "delivery_id", "threat_count", "user_decision"), "org_id", ms="ms")


@_query(f"""WITH {_EVENTS_SQL}, d AS (SELECT org_id, {_DAY} AS day, floor(sum(coalesce(risk_score, 0)) / count(*) + 0.5) AS v FROM events_ WHERE ms IS NOT NULL GROUP BY ALL),
  s AS (SELECT o.org_id, CAST(r.day AS DATE) AS day FROM (SELECT DISTINCT org_id FROM d) o, range(DATE '2025-06-01', DATE '2025-07-01', INTERVAL 1 DAY) r(day))
  SELECT s.org_id, strftime(s.day, '%m-%d') AS label, CAST(coalesce(v, 0) AS BIGINT) AS value FROM s LEFT JOIN d USING (org_id, day)""")
def a7_dense_trend(spark, folder):
    return analytics.dense_trend(events(spark, folder).select("org_id", "ms", "risk_score"), "2025-06-30", "org_id", ms="ms")


@_query(f"""WITH {_NAMED}, meta(c, label, color) AS (VALUES ('PROMPT_INJECTION', 'Prompt Injection', '#c84fff'), ('CLOUD_API_KEY', 'Cloud / API Key', '#f74f4f'), ('PRIVATE_KEY', 'Private Key', '#f74f4f'), ('DB_CREDENTIALS', 'Database Credentials', '#f74f4f'), ('SERVICE_TOKEN', 'Service Token', '#f5a623'),
  ('HIGH_ENTROPY_SECRET', 'High-Entropy Secret', '#f74f4f'), ('ENCODED_SECRET', 'Encoded Secret', '#f74f4f'), ('CREDIT_CARD', 'Credit Card', '#f5a623'), ('GOV_ID', 'Government ID', '#f5a623'), ('PERSONAL_CONTACT', 'Personal Contact', '#4f8ef7'))
  SELECT org_id, category, n, place, coalesce(label, category) AS label, coalesce(color, '#8899aa') AS color FROM placed LEFT JOIN meta ON c = category""")
def a8_breakdown(spark, folder):
    return analytics.breakdown(table(spark, folder, "sync_events", "org_id", "delivery_id", "threat_categories"), "delivery_id", "org_id")


SINCE = 1_749_945_600_000


@_query(f"""{_STREAK_CTE}, t AS (SELECT *, row_number() OVER (PARTITION BY org_id, coalesce(threat_count, 0) > 0 ORDER BY ms DESC NULLS LAST, delivery_id) AS k FROM events_),
  c AS (SELECT org_id, count(*) AS stored_events, count(*) FILTER (ms >= {SINCE}) AS today_scans, count(*) FILTER (ms >= {SINCE} AND threat_count > 0) AS today_threats, count(*) FILTER (threat_count > 0) AS threats_caught,
    max(ms) FILTER (k = 1 AND threat_count > 0) AS last_threat_at, max(array_to_string(threat_categories, '|')) FILTER (k = 1 AND threat_count > 0) AS last_categories FROM t GROUP BY org_id)
  SELECT c.*, stored_events + 7 AS total_scans, coalesce(stop - 1, total) AS clean_streak FROM c JOIN f USING (org_id)""")
def a9_popup_stats(spark, folder):
    """The figures of the popup; seven more scans than are stored stand for a lifetime counter."""
    rows = events(spark, folder).select("org_id", "ms", "delivery_id", "threat_count", "threat_categories", "user_decision")
    ever = rows.groupBy("org_id").agg((F.count(F.lit(1)) + 7).alias("total"))
    out = analytics.popup_stats(rows, SINCE, "org_id", ms="ms", totals=ever)
    return out.select("*", F.array_join("last_threat_categories", "|").alias("last_categories")).drop("last_threat_categories")


@_query("""WITH r AS (SELECT org_id, CAST(processing_time_ms AS DOUBLE) AS v, row_number() OVER (PARTITION BY org_id ORDER BY processing_time_ms) - 1 AS k, count(*) OVER (PARTITION BY org_id) AS n FROM sync_events WHERE processing_time_ms IS NOT NULL)
  SELECT org_id, p, v AS value FROM r, (VALUES (50), (95), (99)) q(p) WHERE k = least(p * n // 100, n - 1)""")
def a12_percentiles(spark, folder):
    return analytics.exact_percentiles(table(spark, folder, "sync_events", "org_id", "processing_time_ms"), "processing_time_ms", [50, 95, 99], "org_id").withColumn("value", F.col("value").cast("double"))


@_query("""WITH v AS (SELECT org_id, CAST(processing_time_ms AS DOUBLE) AS v, row_number() OVER (PARTITION BY org_id ORDER BY processing_time_ms) - 1 AS k, count(*) OVER (PARTITION BY org_id) AS n, sum(processing_time_ms) OVER (PARTITION BY org_id) AS s FROM sync_events WHERE processing_time_ms IS NOT NULL)
  SELECT org_id, n, max(v) FILTER (k = n // 2) AS p50, max(v) FILTER (k = 95 * n // 100) AS p95, max(v) FILTER (k = 99 * n // 100) AS p99, round(CAST(s AS DOUBLE) / n, 6) AS mean FROM v GROUP BY org_id, n, s""")
def a12_timings(spark, folder):
    """Percentiles and mean of the times of each organisation."""
    out = analytics.timings(table(spark, folder, "sync_events", "org_id", "processing_time_ms"), "processing_time_ms", "org_id")
    return out.select("org_id", "n", *(F.col(c).cast("double").alias(c) for c in ("p50", "p95", "p99")), F.round("mean", 6).alias("mean"))


@_query("SELECT delivery_id FROM sync_events WHERE risk_level = 'HIGH' AND llm = 'Claude'")
def flt7_filter_history(spark, folder):
    return analytics.filtered(table(spark, folder, "sync_events", "delivery_id", "risk_level", "llm"), "HIGH", "Claude").select("delivery_id")


@_query("SELECT 'llm' AS asked, delivery_id FROM sync_events WHERE llm = 'Claude' UNION ALL SELECT 'risk', delivery_id FROM sync_events WHERE risk_level = 'HIGH' UNION ALL SELECT 'all', delivery_id FROM sync_events")
def flt7_filters_with_all(spark, folder):
    """The filters with ALL for one of them, or both."""
    rows = table(spark, folder, "sync_events", "delivery_id", "risk_level", "llm")
    some = {"llm": ("ALL", "Claude"), "risk": ("HIGH", "ALL"), "all": ("ALL", "ALL")}
    parts = [analytics.filtered(rows, *f).select(F.lit(k).alias("asked"), "delivery_id") for k, f in some.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(f"WITH {_EVENTS_SQL} SELECT CAST(row_number() OVER (ORDER BY ms DESC NULLS LAST, delivery_id) AS INTEGER) AS place, delivery_id FROM events_ ORDER BY place LIMIT 20")
def o1_first_page(spark, folder):
    """The first twenty events of the history, newest first, with their places."""
    page = analytics.recent(events(spark, folder).select("delivery_id", "ms"), 20, ms="ms")
    return page.agg(F.collect_list("delivery_id").alias("x")).select(F.posexplode("x").alias("place", "delivery_id")).withColumn("place", F.col("place") + 1)


@_query(f"WITH {_EVENTS_SQL} SELECT delivery_id FROM events_ ORDER BY ms DESC NULLS LAST, delivery_id LIMIT 10")
def o2_recent(spark, folder):
    return analytics.recent(events(spark, folder).select("delivery_id", "ms"), ms="ms").select("delivery_id")


@_query("SELECT delivery_id, array_to_string(threat_categories, ',') AS shown FROM event_in_ ORDER BY shown".replace("event_in_", "sync_events"))
def o1_sorted_history(spark, folder):
    """Events in the order of their lists."""
    out = analytics.sorted_history(table(spark, folder, "sync_events", "delivery_id", "threat_categories"), "threat_categories", descending=False)
    return out.select("delivery_id", F.array_join("threat_categories", ",").alias("shown"))


@_query(f"""WITH {_EVENTS_SQL}, m AS (SELECT delivery_id, (1751328000000 - ms) // 60000 AS m FROM events_ WHERE ms <= 1751328000000)
  SELECT delivery_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS short,
    CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m // 60 = 1 THEN '1 hour ago' WHEN m < 1440 THEN m // 60 || ' hours ago' ELSE m // 1440 || ' day(s) ago' END AS long FROM m""")
def f1_ago(spark, folder):
    now = F.lit(1_751_328_000_000)
    rows = events(spark, folder).where(F.col("ms") <= now)
    return rows.select("delivery_id", analytics.ago(F.col("ms"), now).alias("short"), analytics.ago(F.col("ms"), now, "long").alias("long"))


@_query(f"WITH {_EVENTS_SQL} SELECT org_id, CAST({_DAY} AS VARCHAR) AS day, count(*) AS n FROM events_ WHERE ms IS NOT NULL GROUP BY ALL")
def t6_days(spark, folder):
    day = F.date_from_unix_date(F.floor(F.col("ms") / 86_400_000).cast("int")).cast("string")
    return events(spark, folder).where("ms IS NOT NULL").groupBy("org_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT delivery_id, CASE WHEN id IS NULL OR id = '' THEN NULL ELSE regexp_replace(lower(id), '[^0-9a-f]', '', 'g') END AS ident FROM sync_events")
def f2_identifiers(spark, folder):
    return table(spark, folder, "sync_events", "delivery_id", "id").select("delivery_id", hex_ident(F.col("id")).alias("ident"))
