import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievemark.functions.idents import hex_ident, ident_key
from sievemark.functions.timing import event_time_ms, ntz_micros
from sievemark.operators import panes, rolling
from sievemark.operators.seen import SeenBitmaps, bit_is_set, first_deliveries, further_copies
from sievemark.operators.versions import Conflict, Versions

ROW = "delivery_id bigint, org_id string, ident string"


def admitted(store, spark, rows, **kw):
    return sorted(r[0] for r in store.admit(spark.createDataFrame(rows, ROW), "org_id", "ident", "delivery_id", **kw).collect())


def test_seen_over_batches(spark, tmp_path):
    """More batches than are kept apart, so that folders are merged too; earlier versions stay readable."""
    random.seed(4)
    store, seen, n, sizes = SeenBitmaps(spark, str(tmp_path)), set(), 0, [0]
    for batch in range(10):
        rows = []
        for _ in range(60):
            n += 1
            ident = random.choice([None, "hot", f"{random.randrange(150):032x}"])
            rows.append((n, random.choice(["o1", "o2", None]), ident))
        first = {}
        for d, o, i in rows:
            if i is not None:
                first.setdefault((o, i), d)
        want = sorted(d for k, d in first.items() if k not in seen)
        assert admitted(store, spark, rows) == want
        seen |= set(first)
        sizes.append(len(seen))
    assert store.count() == len(seen) and len(store.versions.manifest(10)["codes"]) == 3
    assert store.dictionary().count() == len(seen) == store.dictionary().select("shard", "code").distinct().count()
    assert [store.dictionary(v).count() for v in (1, 5, 9)] == [sizes[v] for v in (1, 5, 9)] and store.dictionary(0) is None
    assert store.versions.vacuum(0) == 0  # every folder is named by some version


def test_seen_repeats_and_empty(spark, tmp_path):
    store = SeenBitmaps(spark, str(tmp_path))
    rows = [(1, "o", "a"), (2, "o", "a"), (3, "o", None), (4, "o", "b")]
    assert admitted(store, spark, rows, tag=("q", 0)) == [1, 4]
    assert admitted(store, spark, rows, tag=("q", 0)) == [1, 4]  # a repetition of the last batch
    assert admitted(store, spark, [(7, "o", "c")], tag=("r", 0)) == [7]  # another sender's first batch
    assert admitted(store, spark, rows, tag=("q", 1)) == []
    assert admitted(store, spark, rows, tag=("q", 0)) == [1, 4]  # a repetition of an earlier one
    assert admitted(store, spark, []) == [] and store.count() == 3
    batch = spark.createDataFrame(rows, ROW)
    found = further_copies(batch, spark.createDataFrame([(1,), (4,)], "delivery_id bigint"), "ident", "delivery_id")
    assert [r[0] for r in found.collect()] == [2]


def test_two_writers(spark, tmp_path):
    """A writer that is overtaken while it works admits its batch again, on top of the other's."""
    slow, fast = SeenBitmaps(spark, str(tmp_path)), SeenBitmaps(spark, str(tmp_path))
    assert admitted(fast, spark, [(1, "o", "a")]) == [1]
    commit, got = slow.versions.commit, []

    def overtaken(version, state):
        if not got:
            got.append(admitted(fast, spark, [(2, "o", "b"), (3, "o", "c")]))
        commit(version, state)

    slow.versions.commit = overtaken
    assert admitted(slow, spark, [(4, "o", "a"), (5, "o", "b"), (6, "o", "d")]) == [6] and got == [[2, 3]]
    assert fast.versions.committed() == [1, 2, 3] and fast.count() == 4
    with pytest.raises(Conflict):
        fast.versions.commit(2, {})
    assert fast.versions.vacuum(0) == 1  # what the slow writer wrote first


@pytest.mark.parametrize("links", [True, False, None])
def test_commits_are_exclusive(spark, tmp_path, links):
    """By link or by rename: a number that is taken stays as it is."""
    own = Versions(spark, str(tmp_path), links)
    own.commit(1, {"a": [1]})
    for _ in range(2):
        with pytest.raises(Conflict):
            own.commit(1, {"a": [2]})
    own.commit(2, {})
    assert own.committed() == [1, 2] and own.manifest(1) == {"a": [1]} and own.manifest(2) == own.manifest(0) == {}
    assert not [p for p in (tmp_path / "commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_lost_writer_leaves_nothing(spark, tmp_path):
    store = SeenBitmaps(spark, str(tmp_path))
    store.versions.commit = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        admitted(store, spark, [(1, "o", "a")])
    again = SeenBitmaps(spark, str(tmp_path))
    assert again.count() == 0 and admitted(again, spark, [(1, "o", "a")]) == [1]


def test_unset_bits_of_known_keys(spark, tmp_path):
    """The bits decide: a key that the dictionary holds but whose bit is unset is admitted, once."""
    store = SeenBitmaps(spark, str(tmp_path))
    admitted(store, spark, [(1, "o", "a"), (2, "o", "b")])
    state = store.versions.manifest(1)
    code = {r.ident: r for r in store.dictionary().collect()}
    bits = spark.createDataFrame([(code["a"].shard, code["a"].code)], "shard bigint, code bigint").selectExpr("shard", "code div 32768 AS bucket", "code % 32768 AS position")
    bits.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("position").alias("bits")).withColumn("version", F.lit(2)).write.parquet(str(tmp_path / "bits"))
    store.versions.commit(2, {**state, "bits": [[0, str(tmp_path / "bits")]]})
    assert store.count() == 1
    assert admitted(store, spark, [(3, "o", "a"), (4, "o", "b")]) == [4]
    assert admitted(store, spark, [(5, "o", "b")]) == [] and store.count() == 2


def test_bits(spark):
    bits = spark.createDataFrame([(p,) for p in (0, 5, 8, 32767)], "p int").agg(F.bitmap_construct_agg("p").alias("b"))
    got = bits.select(*(bit_is_set(F.col("b"), F.lit(p)).alias(str(p)) for p in (0, 1, 5, 7, 8, 9, 32766, 32767)), bit_is_set(F.lit(None).cast("binary"), F.lit(3)).alias("none")).first()
    assert list(got) == [True, False, True, False, True, False, False, True, False]


def test_first_deliveries(spark):
    rows = spark.createDataFrame([(1, "o", "a"), (2, "o", "a"), (3, "o", None), (4, "o", None), (5, None, "a")], ROW)
    assert sorted(r.delivery_id for r in first_deliveries(rows, "org_id", "ident", "delivery_id").collect()) == [1, 3, 4, 5]
    assert first_deliveries(rows.limit(0), "org_id", "ident", "delivery_id").count() == 0


def test_identifiers_and_times(spark):
    ids = {"{5BD133E4-d589}": "5bd133e4d589", "": None, None: None, "zz": "=zz"}
    rows = spark.createDataFrame([(k,) for k in ids], "i string")
    assert {r.i: r.h for r in rows.select("i", hex_ident(F.col("i")).alias("h")).collect()} == ids
    keys = {r.i: r.k for r in spark.createDataFrame([(k,) for k in ("A" * 32, "{" + "a" * 32 + "}", "a" * 15, "a" * 31, "", None, "zz", "=" + "a" * 31)], "i string").select("i", ident_key(F.col("i")).alias("k")).collect()}
    assert keys["A" * 32] == keys["{" + "a" * 32 + "}"] == bytes([170] * 16) and keys[""] is keys[None] is None and len({bytes(k) for k in keys.values() if k}) == 5 - ("=" + "a" * 31 in keys and keys["a" * 31] == keys["=" + "a" * 31])
    stamps = {0: None, -1: None, None: None, 1_700_000_000: 1_700_000_000_000, 1_700_000_000_123: 1_700_000_000_123, 1_700_000_000_123_999: 1_700_000_000_123, 99_999_999_999: 99_999_999_999_000, 100_000_000_000: 100_000_000_000}
    rows = spark.createDataFrame([(k,) for k in stamps], "s bigint")
    assert {r.s: r.m for r in rows.select("s", event_time_ms(F.col("s")).alias("m")).collect()} == stamps
    at = dt.datetime(2025, 3, 3, 0, 58, 12, 373649)
    micros = spark.createDataFrame([(at,)], "t timestamp_ntz").select(ntz_micros(F.col("t"))).first()[0]
    assert micros == round((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def _made_events(spark, n=400):
    random.seed(9)
    base = dt.datetime(2025, 3, 1)
    rows = []
    for k in range(n):
        at = base + dt.timedelta(minutes=random.randrange(20 * 1440))
        delay = random.choice([dt.timedelta(minutes=1), dt.timedelta(hours=random.randrange(200))])
        rows.append((k, random.choice("ab"), int((at - dt.datetime(1970, 1, 1)).total_seconds() * 1000), at + delay if k % 50 else None, random.choice([None, 0, 10, 90])))
    return rows, spark.createDataFrame(rows, "delivery_id bigint, org_id string, timestamp bigint, created_at timestamp_ntz, risk_score smallint")


@pytest.mark.parametrize("size", [1, 7])
def test_panes_and_windows(spark, tmp_path, size):
    rows, df = _made_events(spark)
    sliced = panes.sliced(df).cache()
    kinds = {r.delivery_id: r.kind for r in sliced.collect()}
    came = defaultdict(list)
    for d, o, ms, created, score in rows:
        at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
        day = dt.datetime(at.year, at.month, at.day)
        want = None if created is None else "cut" if created > at + dt.timedelta(hours=72) else "late" if created > day + dt.timedelta(hours=25) else "in_time"
        assert kinds[d] == want
        if want in ("in_time", "late"):
            came[created.date()].append((o, day.date(), score or 0))
    store = panes.PaneStore(spark, str(tmp_path), ["org_id"], size)
    arrivals, have, count = sorted(came), defaultdict(list), defaultdict(int)
    emitted = {}
    for k in range(0, len(arrivals), 9):
        part = arrivals[k : k + 9]
        version = store.apply(sliced.where(F.col("arrived").isin(part)), "risk_score", "delivery_id", tag=("log", k))
        got = {(r.org_id, r.window_end, r.arrived): (r.revision, r.n, r.total) for r in store.emitted_by(version).collect()}
        want = {}
        for a in part:  # only windows that cover a changed pane are emitted, composed of all that came until then
            touched = set()
            for o, p, s in came[a]:
                for i in range(size):
                    w = (o, p + dt.timedelta(days=i))
                    have[w].append(s)
                    touched.add(w)
            for w in touched:
                count[w] += 1
                want[(*w, a)] = (count[w], len(have[w]), sum(have[w]))
        assert got == want
        emitted |= want
        assert store.apply(sliced, "risk_score", tag=("log", k)) == version  # a repetition
    assert {(r.org_id, r.window_end, r.arrived): (r.revision, r.n, r.total) for r in store.emissions().collect()} == emitted
    assert {(r.org_id, r.window_end): (r.revision, r.n, r.total) for r in store.current().collect()} == {w: (count[w], len(v), sum(v)) for w, v in have.items()}
    arrived = {d for d, _, _, c, _ in rows if c and c.date() in came}
    assert {(r.delivery_id, r.kind) for r in store.reported().collect()} == {(d, k) for d, k in kinds.items() if k in ("late", "cut") and d in arrived}
    assert store.emissions(1).count() < len(emitted)  # an earlier version


def test_a_late_row_changes_the_windows_of_its_pane(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2025, 3, day, hour)
    ms = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    frame = lambda x: panes.sliced(spark.createDataFrame(x, "delivery_id bigint, org_id string, timestamp bigint, created_at timestamp_ntz, risk_score smallint"))
    store = panes.PaneStore(spark, str(tmp_path), ["org_id"], 3)
    store.apply(frame([(k, org, ms(at(k, 5)), at(k, 6), 10) for k in range(1, 20) for org in ("a", None)]), "risk_score")
    version = store.apply(frame([(100, None, ms(at(8, 5)), at(10, 6), 7), (101, "a", ms(at(8)), at(20), 7)]), "risk_score", "delivery_id")
    assert sorted(tuple(r) for r in store.emitted_by(version).select("org_id", "window_end", "revision", "n", "total").collect()) == [(None, at(d).date(), 4, 4, 37) for d in (8, 9, 10)]
    assert [tuple(r) for r in store.reported().collect()] == [(100, "late"), (101, "cut")]
    assert store.apply(frame([]), "risk_score") == 3 and store.emitted_by(3).count() == 0


@pytest.mark.parametrize("step", [1, 9, 100])
def test_rolling_store(spark, tmp_path, step):
    """Day by day, some days at a time, or all at once: the same state; corrections make new versions of the days they reach and no others."""
    random.seed(3)
    start, n = dt.date(2025, 1, 1), 12 if step == 1 else 61
    periods = (2, 5) if step == 1 else (7, 30)
    day = lambda k: start + dt.timedelta(days=k)
    amounts = {(random.choice("ab"), day(random.randrange(n - 5))): (random.randrange(50), random.randrange(1, 5)) for _ in range(40)}
    late = {(random.choice("ab"), day(random.randrange(n - 2))): (random.randrange(50), 1) for _ in range(4)}
    frame = lambda x: spark.createDataFrame([(e, d, t, n) for (e, d), (t, n) in x.items()] + [(None, start, 5, 1), ("x", day(-1), 5, 1), ("x", day(n), 5, 1)], "entity string, day date, total bigint, n bigint").coalesce(2)
    people = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "entity string").coalesce(1)
    store = rolling.RollingStore(spark, str(tmp_path), start, periods)
    while store.last_day() < day(n - 1):
        store.advance(frame(amounts), people, min(day(n - 1), store.last_day() + dt.timedelta(days=step)))
    before = store.versions.latest()
    assert store.advance(frame(amounts), people, day(3)) == before and before == -(-n // step)
    store.correct(frame(late))

    def check(version, parts):
        both = defaultdict(lambda: [0, 0])
        for x in parts:
            for k, (t, m) in x.items():
                both[k][0] += t
                both[k][1] += m
        rows = {(r.entity, r.day): r for r in store.state(version).collect()}
        assert len(rows) == 3 * n
        for (e, d), r in rows.items():
            for w in periods:
                have = [both[e, d - dt.timedelta(days=k)] for k in range(w) if (e, d - dt.timedelta(days=k)) in both]
                assert (r[f"total_{w}"], r[f"n_{w}"]) == (sum(t for t, _ in have), sum(m for _, m in have))
            assert r.version == 1 + (len(parts) > 1 and any((e, d - dt.timedelta(days=k)) in late for k in range(max(periods))))

    check(None, [amounts, late])
    check(before, [amounts])  # the state as it was before the correction
    written = spark.read.parquet(store.versions.manifest(before + 1)["state"][-1][1]) if before < 7 else None
    if written is not None:
        reached = {(e, d + dt.timedelta(days=k)) for e, d in late for k in range(max(periods))}
        assert {(r.entity, r.day) for r in written.collect()} == {(e, d) for e, d in reached if d <= day(n - 1)}
