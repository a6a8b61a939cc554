r"""Patterns as browsers read them, rewritten for Java's regular expressions.

Differences that matter: there, \b and \w are ASCII while \s also holds the Unicode spaces; in Java \b is
Unicode-aware and \s is ASCII. Case-insensitive matching is ASCII in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters of \s beyond ASCII.
EXOTIC_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_EXOTIC = r"[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: What \s becomes. The texts have their exotic spaces turned into vertical tabs first (see plain_spaces), which are in no other class, so
#: the class stays within ASCII, where Java tests it by one lookup instead of a dozen comparisons for each character.
SPACES = r"\t-\r "
_W = "[0-9A-Za-z_]"
#: A border between a word character and another, or an end of the text.
BORDER = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"


def plain_spaces(text: Column) -> Column:
    """The text with each exotic space turned into a vertical tab: as long as before, and read by the rewritten patterns as a browser reads the text."""
    # the first test is for two ranges only, which most texts fail quickly
    return F.when(text.rlike("[\\u00a0\\u1680-\\uffff]") & text.rlike(_EXOTIC), F.translate(text, EXOTIC_SPACES, "\x0b" * len(EXOTIC_SPACES))).otherwise(text)


def to_java(pattern: str, ignore_case: bool = False) -> str:
    r"""The same pattern for Java. Every \b, \B, \s and \S is written out; classes keep theirs inside."""
    out, i, inside = ["(?i)"] if ignore_case else [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d == "s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif d == "S":
                out.append(f"[^{SPACES}]")  # within a class this is a union with the class
            elif d == "b" and not inside:
                out.append(BORDER)
            elif d == "B" and not inside:
                out.append(f"(?!{BORDER})")
            else:
                out.append(c + d)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "[":
            out.append("\\")
        elif c == "]":
            inside = False
        elif c == "&" and inside:
            out.append("\\")
        out.append(c)
        i += 1
    return "".join(out)
