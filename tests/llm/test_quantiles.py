import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import quantiles

FRACTIONS = [0.01, 0.25, 0.5, 0.9, 0.95, 0.99]


def answers(df, **kw):
    parts = quantiles.build(df, ["g"], "v", **kw)
    return {(r.g, r.fraction): (r.n, r.value) for r in quantiles.quantiles(quantiles.merge(parts, ["g"]), ["g"], FRACTIONS).collect()}


def check(values, got, group, error=0.01):
    own = np.sort(np.array(values))
    for f in FRACTIONS:
        n, v = got[group, f]
        assert n == len(own)
        rank, low, high = np.ceil(f * n), np.searchsorted(own, v, "left"), np.searchsorted(own, v, "right")
        assert low - error * n - 1 <= rank <= high + error * n + 1, (group, f, v)


def test_rank_error_is_bounded(spark):
    rng = np.random.default_rng(1)
    groups = {"long": rng.lognormal(1, 1, 40_000), "flat": rng.uniform(0, 1000, 20_000), "same": np.full(30_000, 50.0), "few": rng.uniform(0, 9, 45), "one": np.array([7.0]), None: rng.uniform(0, 5, 300)}
    rows = [(g, float(round(v, 3))) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = answers(df)
    for g, x in groups.items():
        check(np.round(x, 3), got, g)
    assert got["same", 0.5][1] == 50.0 and got["one", 0.99][1] == 7.0


def test_deletions_and_merging(spark):
    rng = np.random.default_rng(2)
    keep, gone = np.round(rng.uniform(0, 100, 9_000), 3), np.round(rng.uniform(500, 900, 9_000), 3)
    rows = [("a", float(v), 1) for v in np.concatenate([keep, gone])] + [("a", float(v), -1) for v in gone]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(5)
    check(keep, answers(df, weight="w"), "a")
    day1, day2 = (quantiles.build(df.where(c), ["g"], "v", "w") for c in (F.col("v") < 50, F.col("v") >= 50))
    once = quantiles.merge(quantiles.merge(day1, ["g"]).unionByName(quantiles.merge(day2, ["g"])), ["g"], salts=1)
    check(keep, {(r.g, r.fraction): (r.n, r.value) for r in quantiles.quantiles(once, ["g"], FRACTIONS).collect()}, "a")


def test_parts_add_up_to_the_whole(spark):
    shape = quantiles.Shape()
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << shape.bits, 5000), rng.integers(0, 1 << shape.bits, 7000)
    both = shape.fold(np.concatenate([a, b]), np.ones(12_000))
    assert (shape.fold(a, np.ones(5000)) + shape.fold(b, np.ones(7000)) == both).all()
    for kind in (0, 1):
        at = np.flatnonzero(both)
        k, x, w = quantiles._unpack(quantiles._pack(kind, at, both[at]))
        assert k == kind and (x == at).all() and (w == both[at]).all()


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 1.0)], "g string, v double")
    assert {k[0] for k in answers(df)} == {"b"}
    assert answers(df.limit(0)) == {}


def test_values_of_any_size(spark):
    """Negative, tiny and very large values have codes in their order, exact up to the stated bound."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1e5, 400), rng.uniform(-1, 1, 100), 10 ** rng.uniform(5, 300, 200), -(10 ** rng.uniform(5, 300, 200)), [0.0, 134_217.727, 134_217.728, 134_218.0, -134_217.728, 1e304, -1e304]])
    shape = quantiles.Shape()
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", shape.encoded(F.col("v"), 1000).alias("c"))
    rows = sorted((r.v, r.c) for r in df.collect())
    codes = np.array([c for _, c in rows])
    assert (np.diff(codes) >= 0).all() and codes.min() >= 0 and codes.max() < 1 << shape.bits
    back = shape.decoded(codes, 1000)
    for (v, _), b in zip(rows, back):
        assert abs(b - v) <= (5.1e-4 if abs(v) <= 134_217.727 else 1e-5 * abs(v))
    far = spark.createDataFrame([("a", float(v)) for v in np.repeat([-5e9, 1.0, 7e12], 100)] + [("a", float("inf"))], "g string, v double")
    got = answers(far)
    assert got["a", 0.25][1] == pytest.approx(-5e9, rel=1e-5) and got["a", 0.5][1] == 1.0 and got["a", 0.95][1] == pytest.approx(7e12, rel=1e-5)
