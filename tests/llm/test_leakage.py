import random

import pytest

from sievemark.llm import leakage

WORDS = [f"{a}{b}{c}" for a in ("bra", "ket", "lom", "vis", "dru", "pel") for b in ("no", "ta", "ri", "mu") for c in ("s", "lk", "nd", "x")]


def text(n, seed):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def page(words, width=6):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


ITEM = text(60, 1)


def damaged(words, seed, share=0.08):
    rng = random.Random(seed)
    return [w[:1] + "c" + w[2:] if rng.random() < share else w for w in words]


def cases():
    noise = lambda s, n=60: page(text(n, s))
    yield 1, "\n".join(noise(2) + page(ITEM) + noise(3)), True
    yield 2, "\n".join(noise(4) + page(damaged(ITEM[10:40], 5)) + noise(6)), True
    yield 3, "\n".join(noise(7) + page([w.upper() for w in ITEM[20:50]]) + noise(8)), True
    p = page(ITEM[5:45])
    yield 4, "\n".join(p[:3] + ["BARGAINS ! ! !", "No. 7 street"] + p[3:]), True
    other = page(text(60, 9))
    yield 5, "\n".join(x for pair in zip(page(ITEM), other) for x in pair), True
    flat = " ".join(ITEM[8:44])
    yield 6, "-\n".join([flat[:50], flat[50:101], flat[101:150], flat[150:]]), True
    yield 7, "\n".join(noise(10) + page(ITEM[10:24]) + noise(11)), False
    yield 8, "\n".join(noise(12, 200)), False
    yield 9, "", False
    yield 10, None, False
    yield 11, "\n".join(page(random.Random(3).sample(ITEM, 60))), False
    yield 12, " ".join(text(6000, 13) + ITEM + text(3000, 14)), True


def test_cases(spark):
    rows = list(cases())
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(100 + k, "\n".join(page(text(80, 100 + k))), 0) for k in range(200)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, " ".join(ITEM)), (8, "Now choose the best answer. " + " ".join(ITEM)), (9, " ".join(text(70, 77))), (10, None), (11, ""), (12, "one two")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(docs, items).collect()}
    assert got == {(i, k) for i, _, hit in rows if hit for k in (7, 8)}
    assert leakage.leaked(docs.limit(0), items).count() == 0 and leakage.leaked(docs, items.limit(0)).count() == 0


def test_reprinted_passages(spark):
    """A passage that stands in a third of all documents or more, damaged or in equal copies, is found in each."""
    other = " ".join(text(70, 77)).split()
    numbers = lambda n, seed: [str(random.Random(seed + k).randrange(10**6)) for k in range(0, 10_000 * n, 10_000)]
    mixed = "\n".join(x for pair in zip(page(other[10:60], 4), page(numbers(60, 9), 4)) for x in pair)
    pages = [(k, "\n".join(page(numbers(60, 1000 + k)) + page(damaged(ITEM[10:40], k)) + page(numbers(60, 2000 + k))), 7) for k in range(250)]
    pages += [(k, mixed, 9) for k in range(250, 500)] + [(k, "\n".join(page(numbers(120, 3000 + k))), None) for k in range(500, 700)]
    docs = spark.createDataFrame(pages, "doc_id bigint, text string, given bigint").drop("given")
    items = spark.createDataFrame([(7, " ".join(ITEM)), (9, " ".join(other))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(docs, items).collect()}
    assert got == {(i, k) for i, _, k in pages if k}


def test_passages_across_stretches(spark):
    """A passage of a long text without line breaks is found wherever it stands."""
    rows = [(k, " ".join(text(k, k) + ITEM[10:50] + text(2200 - k, k + 1))) for k in range(700, 2100, 35)] + [(1, " ".join(text(980, 21) + ITEM[10:50] + text(900, 22)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(ITEM))], "item_id bigint, text string")
    assert sorted(r.doc_id for r in leakage.leaked(docs, items).collect()) == sorted(k for k, _ in rows)
    assert leakage._stretches([["a"] * 1000]) == [[["a"] * 50] * 20] and leakage._stretches([]) == []
    # the same for texts of three long lines
    rows = [(k, "\n".join(" ".join(w[i : i + 734]) for i in (0, 734, 1468))) for k in range(720, 1500, 60) for w in [text(k, k) + ITEM[10:50] + text(2162 - k, k + 1)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in leakage.leaked(docs, items).collect()) == sorted(k for k, _ in rows)


def test_passages_beside_unreadable_words(spark):
    """Parts of a page that are long enough count, whatever stands between them or gives a better alignment."""
    item = text(96, 31)
    other = lambda n: [str(k) * 3 for k in range(n)]
    rows = [(1, item[:30] + other(11) + item[41:71]), (2, item[:40] + other(16) + item[56:]), (3, item[:20] + other(12) + item[32:52])]
    docs = spark.createDataFrame([(k, "\n".join(page(w))) for k, w in rows], "doc_id bigint, text string")
    got = leakage.leaked(docs, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and all(r.matched >= 0.85 * r.words and r.words >= 24 for r in got)


def test_next_best_alignment(monkeypatch):
    """The second alignment is found where the first has no passage; the first one scores as in align."""
    item = text(90, 33)
    lines = [item[60:84], ["0"] * 90, item[:20] + ["1"] * 12 + item[32:52]]
    got = list(leakage.paths(item, lines))
    assert got[0][0] == leakage.align([(item, lines)])[0][0]
    assert [bool(leakage.passage(p, 24, 0.85)) for _, p in got[:2]] == [False, True]


def test_long_items(spark):
    """A passage of an item of several pieces is found wherever it stands, once, with its whole length, whatever the pieces and stretches."""
    long = text(1500, 50)
    docs = [(k, "\n".join(page(text(50, 60 + k)) + page(long[k : k + 40]) + page(text(50, 90 + k)))) for k in range(0, 1450, 61)]
    docs += [(9999, "\n".join(page(long))), (9998, "\n".join(page(long[200:800]))), (9997, " ".join(text(700, 3) + long[100:1300] + text(300, 4)))]
    items = spark.createDataFrame([(1, " ".join(long))], "item_id bigint, text string")
    got = {r.doc_id: r for r in leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert sorted(got) == sorted(k for k, _ in docs)
    size = {9999: 1500, 9998: 600, 9997: 1200} | {k: 40 for k in got if k < 9000}
    assert all(size[k] - 4 <= r.matched <= r.words <= size[k] + 20 for k, r in got.items())  # words at the borders may be alike
    # longer passages may be asked for than the pieces usually share
    got = leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), items, least=300).collect()
    assert sorted(r.doc_id for r in got) == [9997, 9998, 9999]
    with pytest.raises(ValueError):
        leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), items, least=leakage.MOST_ASKED + 1)


def numbers(n, rng):
    return [str(rng.randrange(10**6)) for _ in range(n)]


@pytest.mark.parametrize("share", [0.01, 0.05, 0.5])
def test_corpora_of_any_size(share):
    """A damaged passage that stands in any share of the documents is found in each, in small and large corpora alike."""
    for size in (100, 1_000, 20_000):
        rng = random.Random(6)
        pages, want = [], []
        for k in range(size):
            hit = k % round(1 / share) == 0
            middle = damaged(ITEM[10:40], k, 0.1) if hit else numbers(6, rng)
            pages.append("\n".join(page(numbers(6, rng)) + page(middle) + page(numbers(6, rng))))
            want += [k] * hit
        items = leakage.Items([(7, " ".join(ITEM))])
        alone = [set(zip(*map(lambda x: x.tolist(), items.alone(pages[i : i + 1000])))) for i in range(0, size, 1000)]
        count = [0] * len(items.known)
        for part in alone:
            for _, g in part:
                count[g] += 1
        matcher = leakage.Matcher(items, leakage.np.array(count) / size)
        got = [t for t, *_ in matcher.matches(pages, 0.85)]
        assert set(got) <= set(want) and len(got) >= 0.98 * len(want)


def test_candidates_against_all_pairs():
    """Every passage that an alignment of all pairs finds is a candidate."""
    rng = random.Random(8)
    items = leakage.Items([(k, " ".join(text(60, 500 + k))) for k in range(8)] + [(8, ""), (9, "one two three")])
    pages = []
    for k in range(60):
        words = leakage.words("; ".join(items.words[k % 8]))
        pages.append("\n".join(page(text(60, k)) + page(damaged(words[5 : 5 + rng.randrange(10, 50)], k, 0.1)) + page(text(60, k + 1))) if k % 3 else "")
    share = leakage.np.zeros(len(items.known))
    for t, g in set(zip(*map(lambda x: x.tolist(), items.alone(pages)))):
        share[g] += 1 / len(pages)
    some = leakage.Matcher(items, share)
    every = leakage.Matcher(items, share)
    every.candidates = lambda texts: [(t, k) for t, x in enumerate(texts) if x for k in range(9) if items.words[k]]
    pick = lambda m: {(t, i) for t, i, *_ in m.matches(pages, 0.85)}
    assert pick(some) == pick(every) and len(pick(some)) > 15


def test_items_beyond_the_bound(spark, monkeypatch):
    """Where the items are joined instead of sent, the pairs are the same, in every document with the text, whatever its key."""
    long = text(900, 50)
    rows = [(i, t) for i, t, _ in cases()] + [(1, cases().__next__()[1]), (None, cases().__next__()[1]), (50, "\n".join(page(text(40, 4) + long[100:700] + text(40, 5)))), (51, "\n".join(page(long[250:310])))]
    rows += [(100 + k, "\n".join(page(text(80, 100 + k)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame([(7, " ".join(ITEM)), (9, " ".join(text(70, 77))), (8, " ".join(ITEM[:50])), (10, None), (11, ""), (12, "one two"), (13, " ".join(long)), (None, " ".join(ITEM[5:]))], "item_id bigint, text string").repartition(2)
    pairs = lambda d, i: sorted(map(tuple, leakage.leaked(d, i).collect()), key=repr)
    whole = pairs(docs, items)
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 1)
    joined = pairs(docs, items)
    assert len(whole) > 25 and joined == whole
    assert pairs(docs.limit(0), items) == [] and pairs(docs, items.where("item_id > 9 AND item_id < 13")) == []
    strings = items.select(leakage.F.concat(leakage.F.lit("i"), "item_id").alias("item_id"), "text")
    assert len(pairs(docs, strings.where("item_id IS NOT NULL"))) == len([r for r in whole if r[1] is not None])


def test_filter(spark):
    from sievemark.llm.leakjoin import Filter

    rng = leakage.np.random.default_rng(3)
    inside, outside = (rng.integers(-(1 << 63), (1 << 63) - 1, 3000) for _ in range(2))
    own = Filter(spark.createDataFrame([(int(x),) for x in inside], "gram bigint"))
    assert own.holds(inside).all() and own.holds(outside).mean() < 0.02


@pytest.mark.parametrize("seed", range(5))
def test_alignment_against_a_plain_one(seed):
    """The alignments side by side give the score of one written out cell by cell."""
    rng = random.Random(seed)
    pairs = [(text(rng.randrange(5, 25), rng.random()), page(text(rng.randrange(1, 40), rng.random()), rng.randrange(2, 7))) for _ in range(4)]
    pairs = [(item, p + page(item[: len(item) // 2], 3)) for item, p in pairs]

    def plain(item, lines):
        m = len(item)
        state, held, best = [0.0] * (m + 1), [-1e9] * (m + 1), 0.0
        for line in lines:
            state = [max(a, b) for a, b in zip(state, held)]
            for w in line.split():
                new = [0.0] * (m + 1)
                for j in range(m + 1):
                    new[j] = state[j] + leakage.MISS
                    if j:
                        like = bool(leakage._alike(leakage._masks([w]), leakage._masks([item[j - 1]]))[0, 0])
                        new[j] = max(new[j], state[j - 1] + (leakage.MATCH if like else leakage.MISS))
                for _ in range(2):
                    new = [new[0]] + [max(new[j], new[j - 1] + leakage.LEFT_OUT) for j in range(1, m + 1)]
                state = [max(0.0, x) for x in new]
                best = max(best, *state)
            held = [max(h + leakage.LINE, s + leakage.SKIP) for h, s in zip(held, state)]
        return best

    got = leakage.align([(item, [x.split() for x in lines]) for item, lines in pairs])
    assert [round(g[0], 1) for g in got] == [round(plain(*p), 1) for p in pairs]
