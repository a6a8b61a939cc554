"""The whole scan of a text column: one narrow projection, no shuffle and no UDF."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import EXOTIC_SPACES, SPACES, plain_spaces
from ..functions.dictionary import CATEGORIES, PATTERNS, Pattern
from ..operators import detect
from ..operators.redact import merge_spans, redact
from ..operators.scoring import by_severity, composite_score, risk_level
from .custom import parsed

THREAT = "struct<ord:int,id:string,category:string,label:string,score:int,count:int,confidence:double,signals:array<string>>"
RESULT = ("score", "level", "threats", "threat_categories", "threat_count", "redacted_text", "pattern_match_count", "injection")


def _threat(k: int, id: str, category: str, label: str, score: int, count: Column, confidence: Column | None = None, signals: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(k).alias("ord"), F.lit(id).alias("id"), F.lit(category).alias("category"), F.lit(label).alias("label"), F.lit(score).alias("score"), count.cast("int").alias("count"), (null if confidence is None else confidence).cast("double").alias("confidence"), (null if signals is None else signals).cast("array<string>").alias("signals")).cast(THREAT)


@lru_cache(maxsize=16)
def _steps(context: int, patterns: tuple[Pattern, ...]) -> tuple[tuple[dict[str, Column], ...], dict[str, Column]]:
    """The columns that are added in turn, and those of the result. They name their inputs only, so they are built once for each context (building takes seconds, as every node is a call to the JVM)."""
    t = F.col("_text")
    names = F.array(*(F.lit(p.placeholder) for p in patterns)) if patterns else F.array().cast("array<string>")
    turn = F.array(*(F.lit(k if p.always else len(patterns) + k) for k, p in enumerate(patterns))) if patterns else F.array().cast("array<int>")
    own = F.transform("_kept", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), names[m["ord"]].alias("placeholder"), m["score"].alias("score"), turn[m["ord"]].alias("seq")))
    listed = F.array(*(_threat(k, p.id, p.category, p.label, p.score, F.lit(0)) for k, p in enumerate(patterns)))
    counted = F.transform(listed, lambda p: p.withField("count", F.size(F.filter("_kept", lambda m: m["ord"] == p["ord"]))))
    none = F.array().cast(f"array<{THREAT}>")
    by_pattern = F.when(F.size("_kept") > 0, F.filter(counted, lambda p: p["count"] > 0)).otherwise(none) if patterns else none
    n_entropy, n_encoded = F.size("_two") - F.size("_own"), F.size("_spans") - F.size("_two")
    label = lambda c: CATEGORIES[c][0]
    others = [
        F.when(n_entropy > 0, _threat(1000, "HIGH_ENTROPY_SECRET", "HIGH_ENTROPY_SECRET", label("HIGH_ENTROPY_SECRET"), detect.ENTROPY_SCORE, n_entropy)),
        F.when(n_encoded > 0, _threat(1001, "ENCODED_SECRET", "ENCODED_SECRET", label("ENCODED_SECRET"), detect.ENCODED_SCORE, n_encoded)),
        F.when(F.col("injection.detected"), _threat(1002, "PROMPT_INJECTION", "PROMPT_INJECTION", label("PROMPT_INJECTION"), detect.INJECTION_SCORE, F.lit(1), F.col("injection.confidence"), F.col("injection.signals"))),
    ]
    steps = (
        {"_text": plain_spaces(F.col("_given")), "_folded": detect.folded(F.col("_given"))},
        {"_lower": F.lower(t), "_folded": detect.without_hidden(F.col("_folded"))},
        {"_plain": detect.plain_form(F.col("_folded"), t != F.col("_given")), "_open": detect.open_patterns(F.col("_lower"), patterns), "_long": detect.long_run(t)},
        {"_raw": F.when(t != "", detect.pattern_matches(t, F.col("_open"), patterns)).otherwise(F.array().cast(detect.MATCH)), "_plain": detect.joined_singles(F.col("_plain"))},
        {"_kept": F.when(F.size("_raw") > 1, detect.without_contained(F.col("_raw"))).otherwise(F.col("_raw")), "_entropy": detect.high_entropy(t, F.col("_lower"), F.col("_long")), "_encoded": detect.encoded_secrets(t, patterns, F.col("_long")), "_suspect": detect.suspect(F.col("_plain"))},
        {"_own": own.cast(detect.SPAN), "_phrases": detect.injection_phrases(F.col("_plain"), F.col("_suspect")), "_flags": detect.injection_flags(t, F.col("_plain"), F.col("_suspect"), F.col("_lower"))},
        {"_two": F.when(F.size("_entropy") > 0, detect.add_spans(F.col("_own"), F.col("_entropy"), "[SECRET]", detect.ENTROPY_SCORE, 1000)).otherwise(F.col("_own")), "injection": F.when(t != "", detect.injection(F.col("_phrases"), F.col("_flags"), F.col("_sensitivity")))},
        {"_spans": F.when(F.size("_encoded") > 0, detect.add_spans(F.col("_two"), F.col("_encoded"), "[ENCODED_SECRET]", detect.ENCODED_SCORE, 1001)).otherwise(F.col("_two"))},
        {"_threats": by_severity(F.concat(by_pattern, F.array_compact(F.array(*others)))), "_merged": merge_spans(F.col("_spans"))},
    )
    score = composite_score(F.transform("_threats", lambda x: x["score"]))
    result = {
        "score": score,
        "level": risk_level(score),
        "threats": F.transform("_threats", lambda x: x.dropFields("ord")),
        "threat_categories": F.array_distinct(F.transform("_threats", lambda x: x["category"])),
        "threat_count": F.size("_threats"),
        "redacted_text": redact(F.col("_given"), F.col("_merged")),
        "pattern_match_count": F.size("_spans"),
        "injection": F.col("injection"),
    }
    return steps, result


def scan(rows: DataFrame, text: str = "text", sensitivity: str | Column = "MEDIUM", patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """rows and the columns of RESULT.

    A null or empty text is SAFE with score 0 and has a null injection; its redacted text is empty. Columns of
    rows that are named like one of RESULT are replaced. Threats are sorted by score, then by their place in
    the dictionary. The time a text takes isn't reported: rows are processed together.
    """
    level = sensitivity if isinstance(sensitivity, Column) else F.lit(sensitivity)
    keep = [c for c in rows.columns if c not in RESULT]
    steps, result = _steps(id(rows.sparkSession.sparkContext), tuple(patterns))
    step = rows.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_given"), level.alias("_sensitivity"))
    for columns in steps:
        step = step.withColumns(columns)
    # A filter on a result would be pushed below the steps with all of them written out in it, over and over. It
    # stops at what isn't deterministic, so each result is wrapped in a test that is always true and counts as such.
    once = F.monotonically_increasing_id() >= 0
    return step.select(*keep, *(F.when(once, c).alias(k) for k, c in result.items()))


def prompts(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with their texts trimmed of white space, also beyond ASCII, on both sides; those without anything else, and nulls, are dropped."""
    space = f"[{SPACES}{EXOTIC_SPACES}]"
    trimmed = F.regexp_replace(F.col(text), rf"\A{space}+|{space}+\z", "")
    return rows.withColumn(text, trimmed).where(F.col(text) != "")


def event_of(scanned: DataFrame, id: str, stamp: Column, llm: Column, decision: Column, *more: str) -> DataFrame:
    """What may be stored of a scan, and the columns `more`: never a text, a value or a redacted text. The time that a text took is not known, as rows are processed together: null."""
    return scanned.select(F.col(id).cast("string").alias("id"), stamp.alias("timestamp"), llm.alias("llm"), F.col("level").alias("risk_level"), F.col("score").alias("risk_score"), "threat_categories", "threat_count", decision.alias("user_decision"), F.lit(None).cast("double").alias("processing_time_ms"), "pattern_match_count", *more)


def pattern_of_row(row) -> Pattern:
    """A Pattern from a row of custom patterns (see custom.parsed)."""
    regex, any_case = parsed(row["pattern"])
    return Pattern(row["id"], row["category"] or "CUSTOM", row["name"] or row["id"], int(row["score"] if row["score"] is not None else 50), f"[{row['category'] or 'CUSTOM'}]", (), regex, ignore_case=any_case, always=True)


#: The most custom patterns of one organisation that become part of a scan's expressions; custom.custom_threats takes any number, of all organisations.
MOST_CUSTOM = 1_000


def organisation_patterns(custom: DataFrame, org: str) -> tuple[Pattern, ...]:
    """The active patterns of an organisation, by id. Collects them; more than MOST_CUSTOM are an error. Null and empty patterns don't count."""
    rows = custom.where((F.col("org_id") == org) & F.col("is_active") & (F.col("pattern") != "")).orderBy("id").limit(MOST_CUSTOM + 1).collect()
    if len(rows) > MOST_CUSTOM:
        raise ValueError(f"more than {MOST_CUSTOM} patterns: use custom_threats")
    return tuple(map(pattern_of_row, rows))
