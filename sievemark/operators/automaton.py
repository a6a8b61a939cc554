"""Many words looked for in texts at once, by one automaton: one pass over a text however many the words are.

For a few literals functions.spans.find_literals does the same within the JVM; its cost grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most characters of words that are sent to the tasks.
MOST_CHARACTERS = 50_000_000
MATCHES = "array<struct<start:int,end:int,word:string,meta:string>>"
_BUILT: dict[int, object] = {}


def _automaton(words: list[tuple[str, str | None]]):
    """The automaton of a list of words, one in each process."""
    import ahocorasick

    if (key := hash(tuple(words))) not in _BUILT:
        _BUILT.clear()
        own = ahocorasick.Automaton()
        for word, meta in words:
            own.add_word(word, (len(word), word, meta))
        own.make_automaton()
        _BUILT[key] = own
    return _BUILT[key]


def find_words(rows: DataFrame, words: list[tuple[str, str | None]], text: str = "text", out: str = "matches") -> DataFrame:
    """rows and `out`: every occurrence of every word, overlapping ones too: start, end, word and its value; by end, then the longest first.

    Positions count characters from 0; ends are exclusive. Case counts. Empty for no occurrence, no words and an empty text, null for a null text. Of a word
    that is given twice the last value holds. An empty word is an error, as it would be everywhere. A column `out` that rows have is replaced. Narrow: no shuffle.
    """
    if not all(w for w, _ in words):
        raise ValueError("an empty word is everywhere")
    if sum(len(w) for w, _ in words) > MOST_CHARACTERS:
        raise ValueError(f"more than {MOST_CHARACTERS} characters of words: look for them in parts")
    given = rows.drop(out)
    shared = rows.sparkSession.sparkContext.broadcast(list(dict(words).items()))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("meta", pa.string())]))
    at = given.columns.index(text)

    def found(t: str | None) -> list[dict] | None:
        if t is None or not shared.value:
            return None if t is None else []
        return [{"start": end + 1 - n, "end": end + 1, "word": w, "meta": m} for end, (n, w, m) in _automaton(shared.value).iter(t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(found, b.column(at).to_pylist()), kind)], names=[*b.schema.names, out])

    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField(out, T._parse_datatype_string(MATCHES))]))


def word_counts(rows: DataFrame, words: list[tuple[str, str | None]], text: str = "text") -> DataFrame:
    """word, meta, n, docs: how often each word that occurs does, and in how many rows. Counted within each row first."""
    own = F.expr("transform(array_distinct(transform(matches, x -> x.word)), w -> filter(matches, x -> x.word = w))")
    each = find_words(rows.select(text), words, text).select(F.explode(own).alias("g"))
    return each.groupBy(F.col("g")[0]["word"].alias("word"), F.col("g")[0]["meta"].alias("meta")).agg(F.sum(F.size("g").cast("bigint")).alias("n"), F.count(F.lit(1)).alias("docs"))
