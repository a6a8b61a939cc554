"""Tables of a deployment: organisations, events, custom patterns, and the lifetime counter, in one folder of versions.

Every change is written into a folder of its own and counts by one atomic commit (see operators.versions), so events and
the counter never disagree, and two writers never both add what only one may add: the second works again on top of the first.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from ..operators.retention import bounded_store, soft_deleted, with_defaults
from ..operators.versions import Conflict, Versions, merged

ORGANISATIONS = "id string, name string, api_key_hash string, plan string, max_users int, created_at timestamp_ntz"
EVENTS = "id string, timestamp bigint, llm string, risk_level string, risk_score int, threat_categories array<string>, threat_count int, user_decision string, processing_time_ms double, pattern_match_count int, arrival bigint, org_id string"
PATTERNS = "id string, org_id string, name string, pattern string, category string, score int, created_by string, is_active boolean, created_at timestamp_ntz, version bigint"
COUNTER = "org_id string, n bigint"
_SCHEMAS = {"organisations": ORGANISATIONS, "events": EVENTS, "patterns": PATTERNS, "counter": COUNTER}
#: How often a change is made anew because other writers came first.
TRIES = 20


class Store:
    """Reads give empty tables where nothing was written yet. A repeated append repeats its rows unless it names its source (see operators.seen for messages that come more than once)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def _read(self, name: str, state: dict | None = None) -> DataFrame:
        state = self.versions.manifest(self.versions.latest()) if state is None else state
        return self._folders(name, [path for _, path in state.get(name, [])])

    def _folders(self, name: str, paths: list[str]) -> DataFrame:
        # each has partitions of its own; merging keeps the number of folders logarithmic
        rows = [self.spark.read.schema(_SCHEMAS[name]).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], _SCHEMAS[name])

    def _change(self, make: Callable[[dict, int], dict | None]) -> bool:
        """Commits what `make` gives for the state and the number of the new version; false if that is None. A conflict makes it anew."""
        for _ in range(TRIES):
            version = self.versions.latest()
            state = self.versions.manifest(version)
            new = make(state, version + 1)
            if new is None:
                return False
            try:
                self.versions.commit(version + 1, {**state, **new})
                return True
            except Conflict:
                continue
        raise Conflict(f"other writers came first {TRIES} times")

    def _added(self, state: dict, name: str, rows: DataFrame, folder: str, *parts: str) -> list:
        """The folders of a table after rows were written into one more."""
        save = lambda df, to: (df.write.partitionBy(*parts) if parts else df.write).parquet(to)

        def merge(level: int, paths: list[str]) -> str:
            save(self._folders(name, paths), to := f"{folder}/{name}-{level}")
            return to

        save(rows, f"{folder}/{name}")
        return merged(state.get(name, []), [0, f"{folder}/{name}"], merge)

    # ── organisations ──

    def organisations(self) -> DataFrame:
        return self._read("organisations")

    def bootstrap(self, organisations: DataFrame) -> None:
        """Adds those of organisations (id, name, api_key and what else of ORGANISATIONS they have) whose id isn't there yet, also if another writer adds the same at once. Keys are stored as hashes. Of rows with one id any one is added."""
        have = lambda c, d: F.coalesce(F.col(c), d) if c in organisations.columns else d
        rows = organisations.select("id", "name", F.sha2("api_key", 256).alias("api_key_hash"), have("plan", F.lit("trial")).alias("plan"), have("max_users", F.lit(10)).alias("max_users"), F.current_timestamp().cast("timestamp_ntz").alias("created_at")).dropDuplicates(["id"])
        self._change(lambda state, _: {"organisations": self._added(state, "organisations", rows.join(self._read("organisations", state).select("id"), "id", "left_anti"), self.versions.attempt())})

    # ── events ──

    def events(self, org: str | None = None) -> DataFrame:
        """All events, or those of an organisation: then only its folders are read."""
        rows = self._read("events")
        return rows if org is None else rows.where(F.col("org_id") == org)

    def event(self, org: str, id: str) -> DataFrame:
        """The event of an organisation with an id; the filter on the id reaches the scan of that organisation's folders."""
        return self.events(org).where(F.col("id") == id)

    def append(self, events: DataFrame, now_ms: int | None = None, source: tuple[str, int] | None = None) -> bool:
        """Adds events (org_id, arrival and what else they have), with defaults for what is missing, under the folders of their organisations, and counts them in the lifetime counter, in one commit.

        source: who sends the events, and a number that grows; one that was appended before is not appended again, and false is given.
        """
        rows = with_defaults(events, now_ms)
        fields = [f.strip().split(" ") for f in EVENTS.split(", ")]
        rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields))

        def make(state: dict, _: int) -> dict | None:
            sources = state.get("sources", {})
            if source and sources.get(source[0], -1) >= source[1]:
                return None
            folder = self.versions.attempt()
            out = {"events": self._added(state, "events", rows, folder, "org_id")}
            # counted from what was written, so that both say the same
            written = self.spark.read.schema(EVENTS).parquet(f"{folder}/events").groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
            out["counter"] = self._added(state, "counter", written, folder)
            return {**out, "sources": {**sources, **({source[0]: source[1]} if source else {})}}

        return self._change(make)

    def bounded(self, org: str | None = None) -> DataFrame:
        """What a store of limited size would hold of each organisation."""
        return bounded_store(self.events(org), "org_id", arrival="arrival", stamp="timestamp", id="id")

    def total_scans(self) -> DataFrame:
        """org_id, total: all events ever appended, cleared ones too."""
        return self._read("counter").groupBy("org_id").agg(F.sum("n").alias("total"))

    def clear(self) -> None:
        """Removes the events; the counter stays, and so do earlier versions."""
        self._change(lambda state, _: {"events": []})

    # ── figures ──

    def stats(self, since_ms: int) -> DataFrame:
        """The figures of analytics.popup_stats of what the bounded store holds, with the lifetime counter; today begins at since_ms."""
        return analytics.popup_stats(self.bounded(), since_ms, "org_id", order="arrival", totals=self.total_scans())

    def summary(self, org: str) -> dict:
        """The summary of one organisation: total, threats, redaction rate, numbers by level and by service, the eight most frequent categories. At most a row a level, service or place comes to the driver."""
        rows = self.events(org)
        head = analytics.summary(rows).first()
        by = lambda c: {r[c]: r["n"] for r in analytics.counts_by(rows, c).toLocalIterator()}
        top = analytics.top_categories(rows, "arrival").orderBy("place").toLocalIterator()
        return {"total": head["total"], "threats": head["threats"], "redaction_rate": head["redaction_rate"], "by_risk": by("risk_level"), "by_llm": by("llm"), "top_categories": [(r["category"], r["n"]) for r in top]}

    def trend(self, org: str, days: int = 30) -> DataFrame:
        """label, value: the mean score of each of the last `days` (1 to 180) month-days of an organisation that have events."""
        return analytics.trend(self.events(org), days=days).orderBy("label")

    # ── custom patterns ──

    def patterns(self, org: str | None = None) -> DataFrame:
        """The active custom patterns, of all organisations or of one: of each id its last version."""
        rows = self._read("patterns")
        rows = rows if org is None else rows.where(F.col("org_id") == org)
        last = rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "id")), "version").alias("_")).select("id", "_.*")
        return last.where("is_active").drop("version")

    def add_pattern(self, org: str, name: str, pattern: str, category: str, score: int = 50, created_by: str | None = None) -> str:
        """Stores a pattern and gives its id. The score is from 0 to 100."""
        if not 0 <= score <= 100 or not pattern:
            raise ValueError("a pattern and a score from 0 to 100 are needed")
        id = hashlib.sha256(f"{org}/{name}/{pattern}/{time.time_ns()}".encode()).hexdigest()[:32]

        def make(state: dict, version: int) -> dict:
            row = self.spark.createDataFrame([(id, org, name, pattern, category, score, created_by, True, None, version)], PATTERNS)
            return {"patterns": self._added(state, "patterns", row.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).coalesce(1), self.versions.attempt())}

        self._change(make)
        return id

    def remove_pattern(self, org: str, id: str) -> bool:
        """Makes a pattern inactive by a new version; false if the organisation has no active one of this id."""

        def make(state: dict, version: int) -> dict | None:
            gone = soft_deleted(self.patterns(org).where(F.col("id") == id), org, id).withColumn("version", F.lit(version).cast("bigint"))
            return {"patterns": self._added(state, "patterns", gone.coalesce(1), self.versions.attempt())} if gone.count() else None

        return self._change(make)

    # ── messages ──

    def handle(self, message: dict, now_ms: int | None = None) -> dict | None:
        """Answers a message as the background service of a client does: EVENT stores its payload (one event of an organisation, with its arrival), STATS, EVENTS and CLEAR as their names say. None for any other message; a failure is told in the answer.

        now_ms: the present, for a missing time and for the begin of the UTC day; the clock's if not given. `stats` and `events` are DataFrames.
        """
        now = int(time.time() * 1000) if now_ms is None else now_ms
        try:
            match (message or {}).get("type"):
                case "EVENT":
                    payload = message["payload"]
                    fields = ", ".join(f for f in EVENTS.split(", ") if f.split(" ")[0] in payload)
                    self.append(self.spark.createDataFrame([tuple(payload[f.split(" ")[0]] for f in fields.split(", "))], fields), now)
                    return {"ok": True}
                case "STATS":
                    return {"ok": True, "stats": self.stats(now - now % 86_400_000)}
                case "EVENTS":
                    return {"ok": True, "events": self.events()}
                case "CLEAR":
                    self.clear()
                    return {"ok": True}
                case _:
                    return None
        except Exception as e:  # an answer in any case
            return {"ok": False, "error": str(e)}
