import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sievemark.llm import cooccurrence


def test_normal_items(spark):
    given = [(["Personal Contact", "a|b-c", None, "", " x ", "X"], ["A", "B_C", "PERSONAL_CONTACT", "X"]), ([], []), (None, None), (["|", " "], [])]
    rows = spark.createDataFrame([(a,) for a, _ in given], "i array<string>")
    assert [r[0] for r in rows.select(cooccurrence.normal_items(F.col("i"))).collect()] == [w for _, w in given]


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_pairs_against_brute_force(spark, chunk):
    random.seed(chunk)
    baskets = [sorted(random.sample([f"i{k:02d}" for k in range(30)], random.choice([0, 1, 2, 3, 20, 29]))) for _ in range(60)] + [None, ["i01", "i02"], ["i01", "i02"]]
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, items_n int")
    got = cooccurrence.associations(cooccurrence.distinct_baskets(df, "items").cache(), chunk).collect()
    full = [b for b in baskets if b]
    pairs, single = Counter(p for b in full for p in combinations(b, 2)), Counter(i for b in full for i in b)
    assert {(r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == {p: (k, single[p[0]], single[p[1]], len(full)) for p, k in pairs.items()}
    assert all(r.lift == pytest.approx(r.n_ab * r.n / r.n_a / r.n_b) for r in got)


def test_a_huge_basket(spark):
    """Its pairs are made in many tasks, none of which holds more than some chunks."""
    df = spark.createDataFrame([([f"i{k:04d}" for k in range(1000)],), (["i0001", "i0999"],), (["i0001"],)], "items array<string>")
    baskets = cooccurrence.distinct_baskets(df, "items").cache()
    pairs = cooccurrence.pair_counts(baskets)
    assert pairs.count() == 1000 * 999 // 2 and pairs.where("n_ab > 1").collect() == [("i0001", "i0999", 2)]


def test_no_baskets(spark):
    df = spark.createDataFrame([([],), (None,)], "items array<string>")
    assert cooccurrence.associations(cooccurrence.distinct_baskets(df, "items")).count() == 0
