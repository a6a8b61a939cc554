"""Identifiers as clients write them: braces, hyphens, prefixes and case differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_ident(ident: Column) -> Column:
    """The identifier's hexadecimal digits in lower case as text; null if it is null or empty, the whole trimmed text in lower case, marked, if it has no such digits (it is then equal only to itself)."""
    digits = F.regexp_replace(F.lower(ident), "[^0-9a-f]", "")
    return F.when(ident.isNull() | (ident == ""), F.lit(None).cast("string")).when(digits == "", F.concat(F.lit("="), F.lower(F.trim(ident)))).otherwise(digits)


def ident_key(ident: Column) -> Column:
    """The same as bytes, of half the size: 32 digits as their 16 bytes, anything else as at least 17. Equal exactly where hex_ident is equal."""
    # most are digits and hyphens; unhex gives null for any other sign, and only then is the general way taken
    usual, known = F.replace(ident, F.lit("-"), F.lit("")), hex_ident(ident)
    general = F.when((F.length(known) == 32) & ~known.startswith("="), F.unhex(known)).otherwise(F.concat(F.lit("*" * 16), known).cast("binary"))
    return F.coalesce(F.when(F.length(usual) == 32, F.unhex(usual)), general)
