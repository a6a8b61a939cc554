"""The detectors, as Column expressions over one text column: patterns, entropy, encoded secrets, injection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import SPACES, plain_spaces, to_java
from ..functions.dictionary import INJECTION_PHRASES, NEEDS, TRIGGER, VALIDATORS, Pattern
from ..functions.entropy import shannon_entropy
from ..functions.spans import cut, find_all, has_literal, islands, let, open_gates, placed

SPAN = "array<struct<start:int,end:int,placeholder:string,score:int,seq:int>>"
MATCH = "array<struct<ord:int,start:int,end:int,score:int>>"
ENTROPY_SCORE, ENCODED_SCORE, INJECTION_SCORE = 70, 85, 95
#: Rounding of an entropy that is exactly at its bound must not lose it.
_EPSILON = 1e-9


def open_patterns(lower: Column, patterns: tuple[Pattern, ...]) -> Column:
    """The numbers of the patterns whose gate a text in lower case opens, without those that are always looked for."""
    return open_gates(lower, {k: [a.lower() for a in p.anchors] for k, p in enumerate(patterns) if not p.always})


def pattern_matches(text: Column, opened: Column, patterns: tuple[Pattern, ...]) -> Column:
    """All validated matches of all patterns whose gate the text opens (open_patterns). The gate is part of the semantics: a pattern may match text that none of its anchors occurs in."""

    def of(k: int, p: Pattern) -> Column:
        gate = F.lit(True) if p.always else F.array_contains(opened, F.lit(k))
        return F.when(gate & NEEDS[p.need](text) if p.need else gate, cut(text, p.java, ord=F.lit(k)))

    def valid(k: Column, value: Column) -> Column:
        return reduce(Column.__and__, ((k != i) | VALIDATORS[p.validator](value) for i, p in enumerate(patterns) if p.validator), F.lit(True))

    if not patterns:
        return F.array().cast(MATCH)
    scores = F.array(*(F.lit(p.score) for p in patterns))
    match = lambda k: lambda x: F.struct(k.alias("ord"), x["start"].alias("start"), x["end"].alias("end"), F.get(scores, k).alias("score"))
    rows = lambda c: F.transform(F.filter(placed(c), lambda x: valid(c["ord"], x["value"])), match(c["ord"]))
    # the places are worked out by one expression for all patterns that match, which keeps the plan small
    return F.flatten(F.transform(F.array_compact(F.array(*(of(k, p) for k, p in enumerate(patterns)))), rows)).cast(MATCH)


def without_contained(matches: Column) -> Column:
    """Drops a match that lies within a longer, at least as severe one of another pattern; all matches take part in the test, dropped ones too. By start, unless all are of one pattern."""
    size = lambda x: x["end"] - x["start"]
    kept = lambda group: F.filter(group, lambda m: ~F.exists(group, lambda o: (o["ord"] != m["ord"]) & (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & (size(o) > size(m)) & (o["score"] >= m["score"])))
    by_start = F.transform(F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["ord"].alias("ord"), m["score"].alias("score")))), lambda m: F.struct(m["ord"].alias("ord"), m["start"].alias("start"), m["end"].alias("end"), m["score"].alias("score")))
    # what contains a match shares its island
    tested = let(by_start, lambda x: F.flatten(F.transform(islands(x), kept)))
    return F.when(F.size(F.array_distinct(F.transform(matches, lambda m: m["ord"]))) < 2, matches).otherwise(tested)


# The characters of values, and the patterns of assigned values, of those near a keyword, and of blobs.
_VALUE = "[A-Za-z0-9+/=_-]"
ASSIGNED = to_java(rf"""[A-Za-z_][A-Za-z0-9_-]{{0,64}}\s*[:=]\s*['"]?({_VALUE}{{20,200}})""")
NEARBY = to_java(rf"\b{TRIGGER}\b(?s:.){{0,24}}?\b({_VALUE}{{20,200}})", ignore_case=True)


#: What every text with an assigned value, or with one near a keyword, holds.
ASSIGNED_NEED = to_java(rf"""[:=]\s*['"]?{_VALUE}{{20}}""")
NEARBY_NEED = ("secret", "token", "key", "pass", "pwd", "cred", "auth", "api", "access")


def long_run(text: Column) -> Column:
    """Whether a text holds twenty characters of values in a row: neither random-looking values nor encoded secrets are in any other."""
    # signs without a space are one range of characters, which is tested faster than the class
    return (F.length(text) >= 20) & text.rlike("[!-~]{20}") & text.rlike(f"{_VALUE}{{20}}")


def high_entropy(text: Column, lower: Column | None = None, possible: Column | None = None) -> Column:
    """start, end, value of random-looking values: assigned ones (4.0 bits a character), then those near a keyword (4.2); of two that begin alike the first counts. None for texts under 20 characters. lower and possible (long_run), if known, save their computation."""
    lower = F.lower(text) if lower is None else lower
    span = lambda start, v: F.struct(start.cast("int").alias("start"), (start + F.length(v)).cast("int").alias("end"), v.alias("value"))
    kind = "array<struct<start:int,end:int,value:string>>"
    none = F.array().cast(kind)
    a = F.filter(find_all(text, ASSIGNED, 1), lambda x: shannon_entropy(x["part"]) >= 4.0 - _EPSILON)
    a = F.when(text.rlike(ASSIGNED_NEED), F.transform(a, lambda x: span(x["start"] + F.instr(x["value"], x["part"]) - 1, x["part"]))).otherwise(none)
    b = F.filter(find_all(text, NEARBY, 1), lambda x: shannon_entropy(x["part"]) >= 4.2 - _EPSILON)
    b = F.when(has_literal(lower, list(NEARBY_NEED)), F.transform(b, lambda x: span(x["end"] - F.length(x["part"]), x["part"]))).otherwise(none)
    # the values of either kind lie apart, so only one of each kind can begin at a place
    starts = lambda x: F.transform(x, lambda y: y["start"])
    both = let(a, lambda a: F.concat(a, F.filter(b, lambda x: ~F.array_contains(starts(a), x["start"]))))
    return F.when(long_run(text) if possible is None else possible, both).otherwise(none)


BLOB = to_java(r"\b[A-Za-z0-9+/]{20,512}={0,2}")


def encoded_secrets(text: Column, patterns: tuple[Pattern, ...], possible: Column | None = None) -> Column:
    """start, end, value of base64 blobs that decode to printable text with a severe secret (score 70 or more, not always looked for). No anchors are asked for; what is decoded isn't decoded again."""
    kind = "array<struct<start:int,end:int,value:string>>"
    severe = [p for p in patterns if p.score >= 70 and not p.always]

    def holds(blob: Column) -> Column:
        plain = F.decode(F.unbase64(blob), "ISO-8859-1")
        found = F.lit(False)
        for p in severe:
            hit = plain.rlike(p.java)
            if p.validator:
                hit = hit & VALIDATORS[p.validator](F.regexp_extract(plain, p.java, 0))
            found = found | hit
        return F.coalesce(plain.rlike(rf"\A[\x20-\x7e\xa0{SPACES}]+\z") & found, F.lit(False))

    good = F.filter(find_all(text, BLOB), lambda x: F.when((F.length(x["value"]) % 4 == 0) & x["value"].rlike(r"\A[A-Za-z0-9+/]+={0,2}\z"), holds(x["value"])).otherwise(F.lit(False)))
    hits = F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    possible = (long_run(text) if possible is None else possible) & (F.length(text) >= 24) & text.rlike(r"[A-Za-z0-9+/]{20}")
    return F.when(possible, hits).otherwise(F.array().cast(kind))


def add_spans(spans: Column, hits: Column, placeholder: str, score: int, seq: int) -> Column:
    """spans and those hits that overlap none of them, nor an accepted hit before."""
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(placeholder).alias("placeholder"), F.lit(score).alias("score"), F.lit(seq).alias("seq"))
    return F.aggregate(hits, spans.cast(SPAN), lambda acc, x: F.when(F.exists(acc, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(span(x))).cast(SPAN)))


#: Fixed value: the letters that digits and signs stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Fixed value: characters without a form of their own.
_HIDDEN = "[\u200b-\u200f\u202a-\u202e\u2060\ufeff]"
#: Fixed value: single letters or digits with separators between them.
SINGLES = to_java(r"\b(?:[a-z0-9][\s._-]){2,}[a-z0-9]\b")


def folded(text: Column) -> Column:
    """A text in compatibility form (NFKC) and lower case.

    Only texts beyond ASCII are normalised, by the ICU library that comes with Spark. The expression is for a
    select: what it calls is not marked as deterministic.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.lower(F.when(F.octet_length(text) != F.length(text), composed).otherwise(text))


def without_hidden(text: Column) -> Column:
    """The text without characters that show nothing and change the direction."""
    return F.when(text.rlike("[\\u200b-\\ufeff]"), F.regexp_replace(text, _HIDDEN, "")).otherwise(text)


def plain_form(folded_text: Column, spaced: Column | None = None) -> Column:
    """Digits and signs that stand for letters undone, of a text without hidden characters. Empty for null. spaced: whether the text before it was folded has exotic spaces, if known; folding makes none."""
    s = plain_spaces(folded_text) if spaced is None else F.when(spaced, plain_spaces(folded_text)).otherwise(folded_text)
    for digit, letter in LEET.items():
        s = F.replace(s, F.lit(digit), F.lit(letter))
    return F.coalesce(s, F.lit(""))


def joined_singles(s: Column) -> Column:
    """Single letters or digits with separators between them joined to words."""
    runs = F.transform(F.regexp_extract_all(s, F.lit(SINGLES), F.lit(0)), lambda m: F.regexp_replace(m, f"[{SPACES}._-]", ""))
    parts = F.zip_with(F.split(s, SINGLES, -1), runs, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    possible = s.rlike(to_java(r"[\s._-][a-z0-9][\s._-][a-z0-9](?![0-9A-Za-z_])"))  # begins with what is rarer
    return F.when(possible & s.rlike(SINGLES), F.array_join(parts, "")).otherwise(s)


#: The confidence from which a text counts as an injection.
THRESHOLDS = {"LOW": 0.8, "MEDIUM": 0.6, "HIGH": 0.4}
#: Signals beyond the phrases: weight, and what is reported. Fixed values.
SIGNALS = {
    "meta": (0.35, "references the model's own instructions"),
    "override": (0.3, "override verb adjacent to an instruction noun"),
    "role": (0.25, "assigns the model a new role/persona"),
    "exfiltrate": (0.35, "attempts to extract the model's own instructions"),
    "obfuscated": (0.2, "possible obfuscated trigger word"),
    "late": (0.2, "role-change instruction near end of long prompt"),
}
#: Literals of which a text must hold one of each group before a test is made.
_NEEDS = {
    "meta": [["system prompt", "instructions", "your guidelines", "your rules", "your programming"]],
    "override": [["ignore", "disregard", "forget", "override", "bypass", "reset"], ["previous", "above", "prior", "instruction", "rules", "guidelines", "directives", "context"]],
    "role": [["you are "]],
    "exfiltrate": [["system prompt", "your instructions", "your guidelines", "your rules", "your prompt", "initial prompt"]],
}
#: A text with a phrase, or one that passes one of the tests below, holds one of these.
SUSPECT = ("prompt", "instructions", "your ", "ignore", "disregard", "forget", "override", "bypass", "reset", "you are ", " dan", "dan ", "act as", "restrictions", "repeat", "do anything now", "jailbreak", "developer mode")
#: The tests of the first four signals.
_TESTS = {
    "meta": r"\b(?:system prompt|your instructions|previous instructions|prior instructions|your guidelines|your rules|your programming)\b",
    "override": r"\b(?:ignore|disregard|forget|override|bypass|reset)\b(?s:.){0,40}\b(?:previous|above|prior|instruction|instructions|rules|guidelines|directives|context)\b",
    "role": r"\byou are (?:now |going to be |to act as )?(?:a |an |dan|jailbroken|unrestricted|in developer)\b",
    "exfiltrate": r"\b(?:print|reveal|show|repeat|output|tell me|give me|dump|leak)\b(?s:.){0,30}\b(?:system prompt|your instructions|your guidelines|your rules|your prompt|initial prompt)\b",
}


def threshold(sensitivity: Column) -> Column:
    """0.8, 0.6 or 0.4 for LOW, MEDIUM, HIGH; 0.6 for anything else."""
    return F.when(sensitivity == "LOW", F.lit(0.8)).when(sensitivity == "HIGH", F.lit(0.4)).otherwise(F.lit(0.6))


def suspect(plain: Column) -> Column:
    """Whether a plain form may hold a phrase or pass one of the tests on it: for most texts a few searches instead of some sixty."""
    return has_literal(plain, list(SUSPECT))


def injection_phrases(plain: Column, possible: Column | None = None) -> Column:
    """The phrases that a plain form holds."""
    phrases = F.filter(F.array(*map(F.lit, INJECTION_PHRASES)), lambda p: F.contains(plain, p))
    return F.when(suspect(plain) if possible is None else possible, phrases).otherwise(F.array().cast("array<string>"))


def injection_flags(text: Column, plain: Column, possible: Column | None = None, lower: Column | None = None) -> Column:
    """The tests of SIGNALS as the bits of one number, the first lowest. One number, as it is used several times and structs would be taken apart and their tests repeated."""
    possible = suspect(plain) if possible is None else possible
    bit = lambda k, f: F.when(f, F.lit(1 << k)).otherwise(F.lit(0))
    tests = [bit(k, reduce(Column.__and__, [*(has_literal(plain, group) for group in _NEEDS[name]), plain.rlike(to_java(r))])) for k, (name, r) in enumerate(_TESTS.items())]
    disguised = (text.rlike(to_java(r"[gG]\s*[nN]\s*[oO0]\s*[rR]")) & text.rlike(to_java(r"[i1lIL]\s*[gG]\s*[nN]\s*[oO0]\s*[rR]\s*[eE]"))) | (F.lower(text) if lower is None else lower).contains("nstruct") & text.rlike(to_java(r"[iI1][nN][sS][tT][rR][uU][cC][tT][iI1]?[oO0][nN]"))
    tail = F.right(plain, F.lit(120))
    late = (F.length(text) > 400) & tail.rlike(to_java(r"\b(?:ignore|disregard|now|instead|actually)\b")) & tail.rlike(to_java(r"\b(?:instruction|rules|tell me|reveal|print|output)\b"))
    return F.when(possible, reduce(Column.__add__, tests)).otherwise(F.lit(0)) + bit(4, disguised & ~plain.rlike(to_java(r"\binstructions?\b"))) + bit(5, late)


def injection(phrases: Column, flags: Column, sensitivity: Column) -> Column:
    """detected, confidence, signals, matched_phrases, threshold. The confidence is compared before it is rounded."""
    n = F.size(phrases)
    confidence = F.when(n > 0, F.lit(0.6) + F.lit(0.15) * (n - 1)).otherwise(F.lit(0.0))
    signals = [F.when(n > 0, F.concat(F.lit("matched "), n.cast("string"), F.lit(" known injection phrase(s)")))]
    for k, (weight, said) in enumerate(SIGNALS.values()):
        on = flags.bitwiseAND(F.lit(1 << k)) != 0
        confidence = confidence + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        signals.append(F.when(on, F.lit(said)))
    capped, bound = F.least(F.lit(1.0), confidence), threshold(sensitivity)
    return F.struct((capped >= bound).alias("detected"), (F.floor(capped * 100 + 0.5) / 100).alias("confidence"), F.array_compact(F.array(*signals)).alias("signals"), phrases.alias("matched_phrases"), bound.alias("threshold"))
