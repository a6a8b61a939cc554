"""The bounded store, the lifetime counter, the ingest and the daily figures as streams, and scans that feed a store."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import panes
from ..operators.retention import CAPACITY
from ..operators.seen import SeenBitmaps
from ..plans.scan import event_of, prompts, scan
from ..sources.store import Store

STATE = "stamps array<bigint>, ids array<string>, total bigint"
OUTPUT = "store_key string, stored int, total bigint, oldest bigint, newest bigint"


def _few(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """What can matter of the arrivals of one key: the last one, and of the others the capacity - 1 newest by (timestamp, id)."""
    last = rows["arrival"].to_numpy().argmax()
    rest = rows.drop(rows.index[last]).sort_values(["timestamp", "id"], kind="stable").tail(capacity - 1)
    return pd.concat([rest, rows.iloc[[last]]])


def bounded_stream(events: DataFrame, key: str = "org_id", capacity: int = CAPACITY) -> DataFrame:
    """After each micro-batch, for each key with arrivals: what its store holds and how many events it ever took. For the update output mode.

    events: key, arrival, timestamp, id. Within a batch arrivals are taken in the order of `arrival`. Events that come late are taken too: a full
    store drops its oldest by (timestamp, id) first, so a late one stays until the next arrival. The state of a key is bounded by the capacity.
    Of a key's arrivals in a micro-batch only the last one and the newest of the others can stay, so tasks drop the rest, counted, before the
    shuffle: a hot key sends its capacity for each Arrow batch, and the task that updates it holds two such batches at most.
    """

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, g in b.groupby("_key", dropna=False, sort=False):
                few = _few(g.reset_index(drop=True), capacity).assign(n=0)
                few.iloc[-1, few.columns.get_loc("n")] = len(g)
                out.append(few)
            yield pd.concat(out) if out else b.assign(n=0)

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, ids, total = state.get if state.exists else ([], [], 0)
        # what was there takes part as others, never as the last arrival
        held = pd.DataFrame({"arrival": [-(2**63)] * len(stamps), "timestamp": stamps, "id": ids})
        for b in batches:
            total += int(b["n"].sum())
            held = _few(pd.concat([held, b[["arrival", "timestamp", "id"]]], ignore_index=True), capacity)
        heap = [(int(s), str(i)) for s, i in held[["timestamp", "id"]].itertuples(index=False)]
        heapq.heapify(heap)
        times = [s for s, _ in heap]
        state.update((times, [i for _, i in heap], total))
        yield pd.DataFrame([(None if name[0] is None else str(name[0]), len(heap), total, min(times), max(times))], columns=["store_key", "stored", "total", "oldest", "newest"])

    given = events.select(F.col(key).alias("_key"), "arrival", F.coalesce(F.col("timestamp"), F.lit(-(2**62))).alias("timestamp"), F.col("id").cast("string").alias("id"))
    fewer = given.mapInPandas(reduce, f"_key {given.schema['_key'].dataType.simpleString()}, arrival bigint, timestamp bigint, id string, n bigint")
    return fewer.groupBy("_key").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint folder; a query that begins anew in another or an emptied one has another id."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    read = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(read.readAllBytes()).decode())["id"]
    finally:
        read.close()


def _each_batch(stream: DataFrame, checkpoint: str, write):
    """A started query that hands each micro-batch, the query's id and the batch's number to `write`."""
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(lambda batch, number: write(batch, stream_id(spark, checkpoint), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(stream: DataFrame, store: SeenBitmaps, sink: str, checkpoint: str, scope: str = "org_id", ident: str = "ident", order: str = "delivery_id"):
    """A started query that appends each message's first delivery to the Parquet folder `sink`.

    A micro-batch is admitted against the seen-bitmaps under the query's id and its number, and written to a folder of these. One
    that is repeated after a failure gets the same rows admitted again and overwrites that folder; another query's batch of the
    same number is another batch. Several queries may share a store and a sink. Rows without identifier are all kept. `order` is unique.
    """

    def write(batch: DataFrame, query: str, number: int) -> None:
        admitted = store.admit(batch, scope, ident, order, tag=(query, number))
        kept = batch.where(F.col(ident).isNotNull()).join(admitted, order, "left_semi").unionByName(batch.where(F.col(ident).isNull()))
        kept.write.mode("overwrite").parquet(f"{sink}/query={query}/batch={number}")

    return _each_batch(stream, checkpoint, write)


def panes_stream(events: DataFrame, store: panes.PaneStore, checkpoint: str, amount: str = "risk_score", order: str | None = None, stamp: str = "timestamp", created: str = "created_at"):
    """A started query that takes each micro-batch into a PaneStore, whose late and cut rows are told by the same rule as in a batch: by created_at less the time of the event. Each batch is taken in once, also if it is repeated after a failure."""

    def write(batch: DataFrame, query: str, number: int) -> None:
        rows = panes.sliced(batch, stamp, created).persist()
        try:
            store.apply(rows, amount, order, tag=(query, number))
        finally:
            rows.unpersist()

    return _each_batch(events, checkpoint, write)


def daily_stream(events: DataFrame, key: str = "org_id", stamp: str = "timestamp", created: str = "created_at") -> DataFrame:
    """key, pane, n, total by the UTC day of the event, corrected as late events come. For the update output mode: a batch emits the days that it changes and no others.

    events: key, timestamp, created_at, risk_score. Cut rows (see panes.lateness) don't count; nothing is dropped by a watermark, which a single
    wrong clock would move. The state is one row a key and day.
    """
    rows = panes.sliced(events, stamp, created).where("kind IN ('in_time', 'late')")
    return rows.groupBy(key, "pane").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("risk_score", F.lit(0))).alias("total"))


def scan_into_store(texts: DataFrame, store: Store, checkpoint: str, llm: str = "llm", decision: str = "user_decision", id: str = "id", stamp: str = "timestamp", org: str = "org_id", arrival: str = "arrival", text: str = "text", sensitivity: str | Column = "MEDIUM"):
    """A started query that scans each text that arrives and appends what may be stored of it to a Store; never the text.

    Texts are trimmed and empty ones dropped first (scan.prompts). Where the scan found nothing, the decision stored is ALLOWED; otherwise it is that of the column.
    """

    def write(batch: DataFrame, query: str, number: int) -> None:
        store.append(events_of_texts(batch, llm, decision, id, stamp, org, arrival, text, sensitivity), source=(query, number))

    return _each_batch(texts, checkpoint, write)


def events_of_texts(texts: DataFrame, llm: str = "llm", decision: str = "user_decision", id: str = "id", stamp: str = "timestamp", org: str = "org_id", arrival: str = "arrival", text: str = "text", sensitivity: str | Column = "MEDIUM") -> DataFrame:
    """The events to be stored of texts: those of scan.event_of with org_id and arrival. Texts without any but white space give none."""
    scanned = scan(prompts(texts, text), text, sensitivity)
    chosen = F.when(F.col("threat_count") == 0, F.lit("ALLOWED")).otherwise(F.col(decision))
    return event_of(scanned, id, F.col(stamp), F.col(llm), chosen, org, arrival)
