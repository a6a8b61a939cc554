"""Matches of patterns in a text with their positions, as Column expressions.

Positions count characters (code points) from 0; ends are exclusive. What lies between the matches has known
lengths (split) and so have the matches (regexp_extract_all), which gives the positions without a UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,end:int,value:string,part:string>>"
#: Elements that are summed up one by one; sums of so many make the next step.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK elements, the last one shorter; none for an empty one."""
    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, first: int, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints, what `merge` makes of `first` and all before it. Two steps of BLOCK, so a fold doesn't carry an ever longer array along."""
    start = F.lit(first)
    fold = lambda x: F.aggregate(F.slice(x, F.lit(2), F.lit(BLOCK)), F.get(x, F.lit(0)), merge)

    def placed(parts: Column) -> Column:
        def of_sums(sums: Column) -> Column:
            before = lambda k: F.aggregate(F.slice(sums, F.lit(1), k), start, merge)
            inside = lambda part, base: F.transform(part, lambda x, i: F.aggregate(F.slice(part, F.lit(1), i), base, merge))
            return F.flatten(F.transform(parts, lambda part, k: let(before(k), lambda base: inside(part, base))))

        return let(F.transform(parts, fold), of_sums)

    return let(blocks(values), placed)


def cut(text: Column, java_pattern: str, group: int = 0, **more: Column) -> Column:
    """A text cut at the matches of a pattern, leftmost first and without overlap: a struct of `more`, v (the matches), p (their `group`) and s (what lies around them); null for no match. The pattern must not match the empty string."""
    r = F.lit(java_pattern)
    parts = lambda v: v if group == 0 else F.regexp_extract_all(text, r, F.lit(group))
    fields = [c.alias(k) for k, c in more.items()]
    return let(F.regexp_extract_all(text, r, F.lit(0)), lambda v: F.when(F.size(v) > 0, F.struct(*fields, v.alias("v"), parts(v).alias("p"), F.split(text, java_pattern, -1).alias("s"))))


def placed(pieces: Column) -> Column:
    """Where the matches of a cut text lie: array of start, end, value, part."""

    def at(gaps: Column) -> Column:
        ends = running(F.zip_with(gaps, pieces["v"], lambda g, v: g + F.length(v)), 0, lambda a, x: a + x)
        rows = F.arrays_zip(pieces["v"].alias("v"), pieces["p"].alias("p"), gaps.alias("g"), ends.alias("e"))
        return F.transform(rows, lambda x: F.struct((x["e"] + x["g"]).alias("start"), (x["e"] + x["g"] + F.length(x["v"])).alias("end"), x["v"].alias("value"), x["p"].alias("part"))).cast(FOUND)

    return let(F.slice(F.transform(pieces["s"], lambda g: F.length(g)), F.lit(1), F.size(pieces["v"])), at)


def find_all(text: Column, java_pattern: str, group: int = 0) -> Column:
    """All matches, leftmost first and without overlap: array of start, end, value, and the text of `group`. The pattern must not match the empty string. Empty for none; null for a null text. Linear in the text but for a small term in the number of matches (see running)."""
    found = let(cut(text, java_pattern, group), lambda c: F.when(c.isNotNull(), placed(c)).otherwise(F.array().cast(FOUND)))
    return F.when(text.isNull(), F.lit(None).cast(FOUND)).otherwise(found)


def find_literals(text: Column, literals: list[str]) -> Column:
    """Every occurrence of every literal, overlapping ones too: array of end, length, start, literal; by end, then the longest first. An empty literal is an error, as it would be everywhere."""
    if not all(literals):
        raise ValueError("an empty literal matches everywhere")
    kind = "array<struct<start:int,end:int,pattern:string>>"

    def of(lit: str) -> Column:
        # the text is cut before each occurrence, so the pieces' lengths add up to the places; linear in the text
        sizes = F.transform(F.split(text, f"(?={re.escape(lit)})", -1), lambda x: F.length(x))
        later = lambda sizes: F.slice(running(sizes, 0, lambda a, x: a + x), F.lit(2), F.size(sizes) - 1)
        start = F.when(text.startswith(lit), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        hits = F.transform(F.concat(start, let(sizes, later)), lambda i: F.struct(i.alias("start"), (i + len(lit)).alias("end"), F.lit(lit).alias("pattern")))
        return F.when(text.contains(lit), hits).otherwise(F.array().cast(kind))

    every = F.concat(*map(of, literals)) if literals else F.array().cast(kind)
    order = lambda a, b: F.when(a["end"] != b["end"], a["end"] - b["end"]).otherwise(a["start"] - b["start"])
    return F.array_sort(every, order)


def has_literal(text: Column, literals: list[str]) -> Column:
    """Whether any of the literals occurs."""
    return reduce(Column.__or__, (text.contains(x) for x in literals), F.lit(False))


def shared_parts(literals: list[str]) -> dict[str, list[str]]:
    """Literals by a part that at least three of them have in common and that is rare in prose (an underscore, or three characters): a text without it has none of them. '' for the others."""
    left, out = list(dict.fromkeys(literals)), {}
    while True:
        count: dict[str, int] = {}
        for x in left:
            for part in {x[i : i + 3] for i in range(len(x) - 2)} | {"_"} & set(x):
                count[part] = count.get(part, 0) + 1
        part = max(count, key=lambda k: (count[k], k), default="")
        if count.get(part, 0) < 3:
            return {**out, "": left}
        out[part] = [x for x in left if part in x]
        left = [x for x in left if part not in x]


def open_gates(text: Column, gates: dict[int, list[str]]) -> Column:
    """The numbers of the gates of which the text holds a literal, an array. Literals with a common part are looked for only where that part is."""
    owners: dict[str, list[int]] = {}
    for k, literals in gates.items():
        for x in literals:
            owners.setdefault(x, []).append(k)
    none = F.array().cast("array<int>")
    parts = []
    for part, literals in shared_parts(list(owners)).items():
        hits = [F.when(text.contains(x), F.array(*map(F.lit, owners[x]))).otherwise(none) for x in literals]
        if hits:
            every = F.concat(*hits)
            parts.append(F.when(text.contains(part), every).otherwise(none) if part else every)
    return F.concat(*parts) if parts else none


def overlap(a: Column, b: Column) -> Column:
    """Whether two spans share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def islands(spans: Column) -> Column:
    """Spans sorted by start, in groups that share no character with another group: an array of arrays. Spans that only touch are apart."""

    def groups(fresh: Column) -> Column:
        return F.transform(fresh, lambda a, k: F.slice(spans, a + 1, F.coalesce(F.try_element_at(fresh, k + 2), F.size(spans)) - a))

    def of(before: Column) -> Column:
        opens = lambda i: F.get(spans, i)["start"] >= F.get(before, i)
        return let(F.filter(F.sequence(F.lit(0), F.size(spans) - 1), opens), groups)

    return let(running(F.transform(spans, lambda x: x["end"]), -1, lambda a, x: F.greatest(a, x)), of)
