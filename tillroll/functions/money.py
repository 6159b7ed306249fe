"""Money in unified text (see `text.unify`): the amount grammar, scanning, rounding, printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.text import BLANK, INLINE_BLANK, ascii_digits, let
from tillroll.options import Options

# The two number grammars (see Options).
NUMBERS = {
    "whole": r"\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}{1,2})?|\p{Nd}+(?:\.\p{Nd}{1,2})?",
    "split": r"\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}{1,2})?",
}

# Amount starts, symbol ends, amount ends: blanks that unified text does not hold any more. They
# are ASCII, so that a text of one byte per character stays one. The separator of a cut line is a
# Unicode noncharacter, never part of valid text.
_OPEN, _SYMBOL, _CLOSE, _CUT = "\x1c", "\x1d", "\x1e", "\ufdd3"
_MARKS = _OPEN + _SYMBOL + _CLOSE + _CUT


def symbol_class(options: Options) -> str:
    """Character class of the configured symbols; characters special to a pattern are escaped."""
    chars = "".join(options.currency_symbols)
    return "[" + "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in chars) + "]"


def _starts(symbol: str) -> str:
    """Looks at one character, so that most positions are passed over at once."""
    return f"(?=[\\p{{Nd}}{symbol[1:-1]}])"


def symbols_may_be_letters(options: Options) -> bool:
    return any(c.isalpha() for c in "".join(options.currency_symbols))


def currency(text: Column, options: Options) -> Column:
    """First configured symbol, in configured order, that occurs in the text."""
    return F.coalesce(
        *[F.when(F.contains(text, F.lit(s)), F.lit(s)) for s in options.currency_symbols]
    )


def parse_amount(raw: Column) -> Column:
    """Digits with commas and a point, blanks before them -> number."""
    plain = raw
    for left_out in ", \n":
        plain = F.replace(plain, F.lit(left_out), F.lit(""))
    is_ascii = F.octet_length(raw) == F.char_length(raw)
    return F.when(is_ascii, plain).otherwise(ascii_digits(raw, without=", \xa0\n")).try_cast("double")


def amounts(text: Column, options: Options) -> Column:
    """All money in a text in order: a number counts with a symbol or a decimal point."""
    symbol, number = symbol_class(options), NUMBERS[options.amount_grammar]
    found = F.regexp_extract_all(text, F.lit(f"({_starts(symbol)}(?:{symbol}{BLANK}*)?(?:{number}))"), F.lit(1))
    money = F.filter(found, lambda m: F.contains(m, F.lit(".")) | F.rlike(m, F.lit(symbol)))
    return F.transform(
        money, lambda m: let(F.regexp_replace(m, F.lit(f"^{symbol}{BLANK}*"), F.lit("")), parse_amount)
    )


def cut_lines(text: Column, options: Options) -> Column:
    """Cut every line that holds money around its last money: before | symbol | number | after.

    Two passes over the whole text and none per line. The first puts marks around every
    number, read from the left; a symbol belongs to a number on its own line only. The second
    goes back from the end of each line to the last mark that is money."""
    symbol, number = symbol_class(options), NUMBERS[options.amount_grammar]
    marked = F.regexp_replace(
        text,
        F.lit(f"{_starts(symbol)}(?:({symbol})({INLINE_BLANK}*))?({number})"),
        F.lit(f"{_OPEN}$1{_SYMBOL}$2$3{_CLOSE}"),
    )
    with_symbol = f"([^{_SYMBOL}]){_SYMBOL}([^{_CLOSE}]*)"
    with_point = f"{_SYMBOL}([^{_CLOSE}.]*\\.[^{_CLOSE}]*)"
    return F.regexp_replace(
        marked,
        F.lit(f"(?md)^(.*){_OPEN}(?:{with_symbol}|{with_point}){_CLOSE}"),
        F.lit(f"$1{_CUT}$2{_CUT}$3$4{_CUT}"),
    )


def has_money(cut_line: Column) -> Column:
    return F.contains(cut_line, F.lit(_CUT))


def cut_parts(cut_line: Column) -> Column:
    """Four parts, the last of which is all that stands behind the money."""
    return F.split(cut_line, _CUT, 4)


def beside_money(parts: Column) -> Column:
    """What stands before and after the money of a cut line, kept apart."""
    return F.concat(F.get(parts, F.lit(0)), F.lit("\n"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")))


def unmark(marked: Column) -> Column:
    has_mark = F.contains(marked, F.lit(_OPEN)) | F.contains(marked, F.lit(_CUT))
    return F.when(has_mark, F.translate(marked, _MARKS, "")).otherwise(marked)


#: From here on doubles lie more than a cent and a half apart: rounding to cents gives them back.
NO_CENTS = 2.0**46


def round_money(value: Column) -> Column:
    """Two decimals, judged on the exact binary value: a value printed as 2.675 lies just
    below the half and gives 2.67; a value exactly between two cents takes the even one.

    100 * x is held as a product and the error of that product, both exact, so that the whole
    cents next to it are known exactly. They are below 2**53 for all amounts that have cents,
    and dividing whole numbers by 100 rounds correctly. There is no other rule for any size."""
    return let(value, _rounded)


def _rounded(x: Column) -> Column:
    """What dividing whole cents gives is rounded already: 100 * x lies nearest to these cents."""
    return F.when(F.rint(x * 100.0) / 100.0 == x, x).otherwise(_nearest_cents(x))


def _nearest_cents(x: Column) -> Column:
    shifted = x * 134217729.0  # 2**27 + 1 splits x in two halves of 26 bits
    high = shifted - (shifted - x)
    product = x * 100.0
    error = (high * 100.0 - product) + (x - high) * 100.0
    nearest = F.rint(product)
    over = product - nearest
    cents = (
        F.when((over == 0.5) & (error > 0), nearest + 1.0)
        .when((over == -0.5) & (error < 0), nearest - 1.0)
        .otherwise(nearest)
    )
    return F.when(F.abs(x) >= NO_CENTS, x).otherwise(cents / 100.0)


def money_text(x: Column) -> Column:
    """Shortest form with at least one decimal: 5.0, 2.05, 12345678.9."""
    fixed = F.round(x, 2).try_cast("decimal(38,2)").cast("string")
    return F.coalesce(F.regexp_replace(fixed, F.lit("0$"), F.lit("")), x.cast("string"))
