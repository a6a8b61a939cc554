import random

from pyspark.sql import functions as F

from sievemark.llm import languages

VOCABULARY = {
    "en": "the a of in and was house river while morning council opened closed bridge with great care people".split(),
    "de": "der die das und war Haus Fluss während Morgen Rat öffnete schloss Brücke mit großer Sorgfalt Leute".split(),
    "es": "el la los y fue casa río mientras mañana consejo abrió cerró puente con mucho cuidado gente".split(),
}
CODES = [("en", "eng", "English"), ("de", "deu", "German"), ("es", "spa", "Spanish")]


def lines(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(VOCABULARY[lang]) for _ in range(6)) for _ in range(n)]


def tables(spark):
    pages = [(1, lines("en", 10, 1), "en", "Morning Herald"), (2, lines("de", 10, 2), "en", "Morning Herald"), (3, lines("en", 8, 3) + lines("es", 9, 4), "en", None), (4, lines("es", 10, 5), " SPANISH ", "El Diario"), (5, lines("es", 10, 6), "es_MX", "El Diario"),
             (6, lines("en", 6, 7) + lines("de", 2, 8) + lines("en", 6, 9), "eng", "x"), (7, ["12 45 .... 33"] * 9, "en", "x"), (8, None, "en", "x"), (9, [], "en", "x"), (10, lines("de", 9, 10), None, "x"), (11, lines("de", 9, 11), "??", None)]
    docs = spark.createDataFrame([(i, None if t is None else "\n".join(t), label, s, "clash") for i, t, label, s in pages], "doc_id bigint, text string, lang string, source string, languages string")
    clean = spark.createDataFrame([(" ".join(lines(k, 20, k)), k) for k in VOCABULARY] + [(None, "en"), ("x", None)], "text string, lang string")
    return docs, spark.createDataFrame(CODES, "lang string, iso3 string, english_name string"), clean


def test_pages_and_segments(spark):
    docs, codes, clean = tables(spark)
    got = {r.doc_id: r for r in languages.page_languages(docs, codes, clean).collect()}
    assert {k: r.languages for k, r in got.items()} == {1: ["en"], 2: ["de"], 3: ["en", "es"], 4: ["es"], 5: ["es"], 6: ["en"], 7: [], 8: [], 9: [], 10: ["de"], 11: ["de"]}
    assert [(s["first"], s["last"], s["lang"]) for s in got[3].segments] == [(0, 7, "en"), (8, 16, "es")]
    assert all(0 < s["confidence"] <= 1 for r in got.values() for s in r.segments) and got[7].segments == [] and got[8].confidence is None
    found = languages.mislabelled(languages.page_languages(docs, codes, clean))
    assert {tuple(r) for r in found.collect()} == {(2, "de"), (3, "en"), (3, "es"), (10, "de"), (11, "de")}


def test_all_letters_of_long_words_count():
    model = languages.Model(["en", "de"]).add((" ".join(lines(k, 20, k)), k) for k in ("en", "de")).fit()
    begin = "q" * 40
    alone, english, german = model.line_likelihoods([[[begin], [begin + "through" * 9 + "people"], [begin + "schlossundbrücke" * 4]]])[0]
    assert english[0] > english[1] + 3 and german[1] > german[0] + 10 and german.max() < alone.min()


def test_empty_tables(spark):
    docs, codes, clean = tables(spark)
    assert languages.page_languages(docs.limit(0), codes, clean).count() == 0
    alone = languages.page_languages(docs, codes, clean.limit(0)).where("doc_id = 1").first()
    assert alone.languages  # fitted on the declared labels alone


def test_labels(spark):
    labels = {"en": "en", " EN-gb ": "en", "deu": "de", "German": "de", "de_DE": "de", "english-x": None, "fr": None, "": None, None: None, "?": None}
    rows = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r.l: r.d for r in rows.select("l", languages.declared_language(F.col("l"), CODES).alias("d")).collect()} == labels


def test_priors_are_smoothed(spark):
    rows = spark.createDataFrame([("A Herald", "en")] * 50 + [("B Herald", "en")] * 30 + [("C Herald", "de")] + [("Diario", "es")] * 9 + [(None, "es"), ("A Herald", None)], "source string, declared string")
    priors, overall = languages.source_priors(rows, ["de", "en", "es"])
    got = {r.source: r.prior for r in priors.collect()}
    assert all(abs(sum(p) - 1) < 1e-9 for p in got.values()) and abs(sum(overall) - 1) < 1e-9
    assert got["C Herald"][1] > got["C Herald"][0] > got["A Herald"][0] and got["Diario"][2] > overall[2]


def test_held_out_accuracy(spark):
    model = languages.Model(list(VOCABULARY)).add((x, k) for k in VOCABULARY for x in lines(k, 30, k)).fit()
    tests = [(k, x.split()) for k in VOCABULARY for x in lines(k, 50, k + "test")]
    likely = model.line_likelihoods([[[w.lower() for w in x] for _, x in tests]])[0]
    assert sum(model.languages[i] == k for i, (k, _) in zip(likely.argmax(axis=1), tests)) >= 0.98 * len(tests)
