"""Blank handling and line splitting with the same idea of "blank" everywhere."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank, and those that end a line. Java's \s
# and \R leave some of them out, so both sets are spelled out.
BLANKS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = "\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"

# Patterns over every kind of blank are slow: each character goes through a chain of tests. So
# texts are unified first (see `unify`) and patterns only meet three kinds: a space (which also
# stands for a tab), a no-break space (any other blank inside a line) and a newline.
OTHER_BLANKS = "".join(c for c in BLANKS if c not in " \t" + LINE_ENDS)
BLANK = "[ \xa0\n]"
INLINE_BLANK = "[ \xa0]"

# For texts that must stay as they are.
ANY_BLANK = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

# Every decimal digit of Unicode next to the ASCII digit of the same value.
_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_OTHER_DIGITS = "".join(_DIGITS)
_SAME_DIGITS = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a name, so that `body` may use it several times for one evaluation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(~F.rlike(c, F.lit(f"[^{ANY_BLANK[1:]}")), F.lit(True))


def unify(text: Column) -> Column:
    """One character per kind of blank; a two-character line end leaves a blank line behind."""
    return F.translate(
        text,
        "\t" + OTHER_BLANKS + LINE_ENDS,
        " " + "\xa0" * len(OTHER_BLANKS) + "\n" * len(LINE_ENDS),
    )


def clean_text(c: Column) -> Column:
    """Runs of blanks become one space, the ends are trimmed, nothing left becomes null."""
    spaced = F.translate(c, BLANKS, " " * len(BLANKS))
    return F.nullif(F.trim(F.regexp_replace(spaced, F.lit(" {2,}"), F.lit(" "))), F.lit(""))


def lines(unified: Column) -> Column:
    """Trimmed lines of a unified text without the blank ones."""
    trimmed = F.transform(F.split(unified, "\n"), lambda line: F.trim(line, F.lit(" \xa0")))
    return F.filter(trimmed, lambda line: line != "")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    # A word that holds another one adds nothing.
    for word in (w for w in words if not any(o in w for o in words if o != w)):
        hit = hit | F.contains(c, F.lit(word))
    return hit


def has_letters(c: Column, n: int) -> Column:
    """At least n letters anywhere; the pattern stops at the n-th."""
    return F.rlike(c, F.lit(r"\p{L}" + r"[^\p{L}]*\p{L}" * (n - 1)))


def ascii_digits(c: Column, without: str = "") -> Column:
    """Digits of any script as ASCII digits; the characters of `without` are left out. A text of
    one byte per character, as most are, is not looked up in the long list of digits."""
    plain = F.translate(c, without, "") if without else c
    is_ascii = F.octet_length(c) == F.char_length(c)
    return F.when(is_ascii, plain).otherwise(F.translate(c, _OTHER_DIGITS + without, _SAME_DIGITS))
