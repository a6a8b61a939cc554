"""Languages of pages and of the segments of mixed pages, with a confidence.

Evidence is fused by Bayes' rule. The likelihood of a line under each language is the product over its words of a mixture
of word frequencies and of a model of three successive letters. The prior is that of the page's source, smoothed by that of
all sources whose title ends alike, smoothed by that of the whole corpus; all three are counts of declared labels by grouped aggregation.
The declared label is evidence too, right with probability RELIABLE. The best sequence of languages of a
page's lines pays SWITCH and the prior odds for each change; its stretches are the segments.

The word and letter models are fitted on labelled rows: on clean ones (`clean`, all of them up to FIT_ROWS), then
again with at most FIT_ROWS documents of each declared language, of which those count whose text the first models call wholly
the language that they declare.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most rows of each language that the models are fitted on, and the longest text among them.
FIT_ROWS, FIT_CHARACTERS = 250, 20_000
#: Share of the word frequencies in the mixture; added to each count of letters; letters that may follow; probability that a declared label is right; strength of the smoothing; cost of a change of language; weight of the text in a confidence.
WORD_SHARE, ADDED, LETTERS, RELIABLE, STRENGTH, SWITCH, TEMPER = 0.7, 0.05, 60, 0.85, 20.0, 8.0, 0.1
#: A language of a page runs over so many successive lines at least; a page has prose if so many of its lines hold two words or more.
LEAST_LINES = 3
#: Distinct words whose likelihoods a Python worker keeps.
KEPT_WORDS = 300_000
#: Sources: up to so many are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def _lines(text: str) -> list[list[str]]:
    return [_WORD.findall(x) for x in unicodedata.normalize("NFKC", text).casefold().replace("\xad", "").split("\n")]


class Model:
    """Likelihoods of words under each language."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.words = [Counter() for _ in languages]

    def add(self, rows: Iterable[tuple[str | None, str]]) -> Model:
        """Counts the words of (text, language)."""
        for text, language in rows:
            if text and language in self.languages:
                self.words[self.languages.index(language)].update(chain.from_iterable(_lines(text)))
        return self

    def fit(self) -> Model:
        n = len(self.languages)
        three, two = defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n))
        for k, counts in enumerate(self.words):
            for w, c in counts.items():
                m = f"^^{w}$"
                for i in range(2, len(m)):
                    three[m[i - 2 : i + 1]][k] += c
                    two[m[i - 2 : i]][k] += c
        self.unseen = {a: -np.log(v + ADDED * LETTERS) + math.log(ADDED) for a, v in two.items()}
        self.letters = {a: np.log(v + ADDED) - np.log(two[a[:2]] + ADDED * LETTERS) for a, v in three.items()}
        self.never = np.full(n, -math.log(LETTERS))
        totals = np.array([max(1, sum(c.values())) for c in self.words], float)
        self.known = {w: np.array([c[w] for c in self.words]) / totals for w in set(chain.from_iterable(self.words))}
        self._reset()
        return self

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "table", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _index(self, word: str) -> int:
        m = f"^^{word}$"
        total = sum((self.letters[t] if (t := m[i - 2 : i + 1]) in self.letters else self.unseen.get(t[:2], self.never) for i in range(2, len(m))), np.zeros(len(self.languages))) + math.log(1 - WORD_SHARE)
        if word in self.known:
            total = np.logaddexp(total, np.log(WORD_SHARE * self.known[word] + 1e-300))
        k = len(self.row)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = total
        self.row[word] = k
        return k

    def line_likelihoods(self, pages: list[list[list[str]]]) -> list[np.ndarray]:
        """Of each page, lines x languages."""
        if len(self.row) > KEPT_WORDS:
            self._reset()
        get, index = self.row.get, self._index
        sizes = np.array([len(x) for page in pages for x in page], np.int64)
        at = [k if (k := get(w)) is not None else index(w) for page in pages for x in page for w in x]
        sums = np.zeros((len(sizes) + 1, len(self.languages)))
        if at:
            total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(self.table[np.array(at)], axis=0, dtype=np.float64)])
            ends = np.cumsum(sizes)
            sums[:-1] = total[ends] - total[ends - sizes]
        cuts = np.cumsum([len(p) for p in pages])
        return [sums[b - len(p) : b] for p, b in zip(pages, cuts)]

    def segments(self, lines: np.ndarray, prior: np.ndarray) -> list[tuple[int, int, int, float]]:
        """first and last line, language and confidence of each segment. lines: at least one; prior: logarithms."""
        total = lines.sum(axis=0) + prior
        top = int(total.argmax())
        gain = np.cumsum(lines - lines[:, top : top + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        if ((gain - np.concatenate([np.zeros((1, len(prior))), low[:-1]])).max(axis=0) + np.maximum(prior - prior[top], 0) <= SWITCH).all():
            path = np.full(len(lines), top)
        else:
            value, back, enter = lines[0] + prior, [], prior - SWITCH
            for x in lines[1:]:
                best = int(value.argmax())
                change = value[best] + enter > value
                back.append(np.where(change, best, np.arange(len(prior))))
                value = np.where(change, value[best] + enter, value) + x
            k, path = int(value.argmax()), np.empty(len(lines), np.int64)
            for i in range(len(lines) - 1, -1, -1):
                path[i] = k
                if i:
                    k = int(back[i - 1][k])
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            score = TEMPER * lines[a:b].sum(axis=0) + prior
            out.append((a, b - 1, int(path[a]), float(1 / np.exp(score - score[path[a]]).sum())))
        return out


def declared_language(label: Column, codes: list[tuple[str, str, str]]) -> Column:
    """The language that a label names: a code of two or three letters or an English name, in any case and with spaces around it, or a code of two letters with a region. Null for any other."""
    clean = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    names = {str(n).lower(): two for two, *more in codes for n in (two, *more) if n}
    named = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))
    region = F.regexp_extract(clean, r"^([a-z]{2})[-_][a-z0-9]+$", 1)
    return F.coalesce(named[clean], F.when(region.isin([two for two, *_ in codes]), region))


def source_priors(labelled: DataFrame, languages: list[str]) -> tuple[DataFrame, list[float]]:
    """source, prior (array in the order of languages) for each source, and the corpus's own. labelled: source, declared.

    Counts the whole table when called, for the corpus's own; a row a language comes to the driver. Rows without a source or a known label count only where they can.
    """
    counted = labelled.where("declared IS NOT NULL").groupBy("source", "declared").agg(F.count(F.lit(1)).alias("n"))
    total = {r[0]: r[1] for r in counted.groupBy("declared").agg(F.sum("n")).collect()}
    overall = [(total.get(k, 0) + 1) / (sum(total.values()) + len(languages)) for k in languages]
    each = [F.sum(F.when(F.col("declared") == k, F.col("n")).otherwise(0)) for k in languages]
    suffix = F.regexp_extract(F.col("source"), r"(\S+)\s*$", 1)
    source = counted.where("source IS NOT NULL").groupBy("source").agg(F.array(*each).alias("own")).withColumn("suffix", suffix)
    alike = counted.where("source IS NOT NULL").groupBy(suffix.alias("suffix")).agg(F.array(*each).alias("alike"))
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    middle = F.zip_with(F.col("alike"), F.array(*map(F.lit, overall)), lambda n, p: (n + STRENGTH * p) / (sum_of(F.col("alike")) + STRENGTH))
    prior = F.zip_with(F.col("own"), middle, lambda n, p: (n + STRENGTH * p) / (sum_of(F.col("own")) + STRENGTH))
    return source.join(alike, "suffix").select("source", prior.alias("prior")), overall


def fitted(documents: DataFrame, clean: DataFrame, languages: list[str]) -> Model:
    """The models, fitted on the driver. documents: text, declared; clean: text, lang. At most FIT_ROWS rows of each language of either come to the driver."""
    bound = FIT_ROWS * len(languages)
    seeds = [(r[0], r[1]) for r in clean.select("text", "lang").where(F.col("lang").isin(languages) & (F.length("text") <= FIT_CHARACTERS)).limit(bound).toLocalIterator()]
    rows = documents.where(F.col("declared").isNotNull() & (F.col("text") != "") & (F.length("text") <= FIT_CHARACTERS))
    count = {r[0]: r[1] for r in rows.groupBy("declared").count().collect()}
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, FIT_ROWS / n))) for k, n in count.items())) if count else None
    picked = []
    if share is not None:
        part = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("declared")] * 1_000_000
        picked = [(r[0], r[1]) for r in rows.where(part).select("text", "declared").limit(2 * bound).toLocalIterator()]
    if not seeds:
        return Model(languages).add(picked).fit()
    first = Model(languages).add(seeds).fit()
    flat, good = np.zeros(len(languages)), []
    for text, label in picked:
        page = _lines(text)
        likely = first.line_likelihoods([page])[0]
        runs = first.segments(likely, flat)
        main = sum(b - a + 1 for a, b, k, _ in runs if languages[k] == label)
        if main >= 0.8 * len(page) and all(b - a < 2 * LEAST_LINES for a, b, k, _ in runs if languages[k] != label):
            good.append((text, label))
    return Model(languages).add(seeds).add(good).fit()


SCHEMA = "segments array<struct<first:int,last:int,lang:string,confidence:double>>, languages array<string>, confidence double"


def page_languages(documents: DataFrame, codes: DataFrame, clean: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", source: str = "source") -> DataFrame:
    """key, declared, segments, languages, confidence of each document.

    segments: first and last line (from 0), language and confidence; languages: those that run over LEAST_LINES successive
    lines, sorted; empty, as the segments, for a page without prose and for null and empty texts; confidence: the least of the
    segments that count, null if none. Priors and models are computed in jobs of their own when this is called. Then the
    documents go through one narrow pass, with the priors of their sources joined (by broadcast up to BROADCAST_SOURCES sources).
    """
    spark = documents.sparkSession
    named = [(r[0], r[1], r[2]) for r in codes.select("lang", "iso3", "english_name").where("lang IS NOT NULL").distinct().collect()]  # a row a language; the standard has fewer than 8,000
    languages = sorted({two for two, *_ in named})
    given = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), declared_language(F.col(label), named).alias("declared"))
    priors, overall = source_priors(given.select("source", "declared"), languages)
    model = spark.sparkContext.broadcast(fitted(given.select("text", "declared"), clean, languages))
    if priors.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        priors = F.broadcast(priors)
    joined = given.join(priors, "source", "left").select("key", "text", "declared", F.coalesce("prior", F.array(*map(F.lit, overall))).alias("prior"))
    wrong = math.log((1 - RELIABLE) / max(1, len(languages) - 1))
    kind = given.schema["key"].dataType.simpleString()
    segment = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts, labels, prior = b.column(1).to_pylist(), b.column(2).to_pylist(), np.log(np.array(b.column(3).to_pylist(), float).reshape(len(b), -1))
            segments, found, sure = [], [], []
            for start in range(0, len(texts), 256):
                pages = [_lines(t) if t else [] for t in texts[start : start + 256]]
                for i, (page, likely) in enumerate(zip(pages, m.line_likelihoods(pages)), start):
                    runs = []
                    if sum(len(x) > 1 for x in page) >= LEAST_LINES:
                        fused = prior[i] + (wrong if labels[i] else 0)
                        if labels[i]:
                            fused[languages.index(labels[i])] += math.log(RELIABLE) - wrong
                        runs = m.segments(likely, fused)
                    long = [r for r in runs if r[1] - r[0] + 1 >= LEAST_LINES]
                    segments.append([{"first": a, "last": z, "lang": languages[k], "confidence": c} for a, z, k, c in runs])
                    found.append(sorted({languages[k] for _, _, k, _ in long}))
                    sure.append(min((c for *_, c in long), default=None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(segments, pa.list_(segment)), pa.array(found, pa.list_(pa.string())), pa.array(sure, pa.float64())], names=["key", "declared", "segments", "languages", "confidence"])

    return joined.mapInArrow(run, f"key {kind}, declared string, {SCHEMA}").withColumnRenamed("key", key)


def mislabelled(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang: the languages of each page with prose whose label doesn't name its only language."""
    right = (F.size("languages") == 1) & (F.col("languages")[0] == F.col("declared"))
    return pages.where((F.size("languages") > 0) & ~F.coalesce(right, F.lit(False))).select(key, F.explode("languages").alias("lang"))
