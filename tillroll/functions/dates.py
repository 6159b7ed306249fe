"""Dates in unified text (see `text.unify`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.text import BLANK, ascii_digits, let
from tillroll.options import Options

# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# The five written forms in the order they are tried. Word edges are spelled
# out because Java's \b and \w do not follow Unicode letters and numbers by default; the edge
# before is looked up after the first character, which skips most positions sooner.
_D = r"\p{Nd}"
_WORD = r"[\p{L}\p{N}_]"
_NUMBER_FROM, _TO = f"{_D}(?<!{_WORD}.)", f"(?!{_WORD})"
_ONE_OR_TWO = f"{_NUMBER_FROM}{_D}?"
ISO = f"{_NUMBER_FROM}{_D}{{3}}-{_D}{{2}}-{_D}{{2}}{_TO}"
SLASHED = f"{_ONE_OR_TWO}/{_D}{{1,2}}/{_D}{{4}}{_TO}"
DASHED = f"{_ONE_OR_TWO}-{_D}{{1,2}}-{_D}{{4}}{_TO}"
DAY_MONTH_NAME = f"{_ONE_OR_TWO}{BLANK}+[A-Za-z]{{3,9}}{BLANK}+{_D}{{4}}{_TO}"
MONTH_NAME_DAY = f"[A-Za-z](?<!{_WORD}.)[A-Za-z]{{2,8}}{BLANK}+{_D}{{1,2}},?{BLANK}+{_D}{{4}}{_TO}"


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd if the parts are in range (the day against 31 only), else null."""

    def written(date: Column) -> Column:
        valid = date["year"].between(1900, 2100) & date["month"].between(1, 12) & date["day"].between(1, 31)
        two = [F.lpad(date[part].cast("string"), 2, "0") for part in ("month", "day")]
        return F.when(valid, F.concat_ws("-", date["year"].cast("string"), *two))

    return let(F.struct(year.alias("year"), month.alias("month"), day.alias("day")), written)


def find_date(text: Column, options: Options) -> Column:
    """The first form whose first hit is a date in range. Later hits of a form are not tried."""

    def parts(pattern: str, separator: str, build) -> Column:
        found = F.regexp_extract(text, pattern, 0)
        if separator in ("-", "/"):  # no such date without one, which is found out sooner
            found = F.when(F.contains(text, F.lit(separator)), found)

        def date_of(hit: Column) -> Column:
            return let(
                F.split(ascii_digits(hit), separator),
                lambda p: build(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))),
            )

        # Without a hit there is no date: no cast is tried in vain. `nullif` would search twice.
        return let(found, lambda hit: F.when(hit != "", date_of(hit)))

    def number(part: Column) -> Column:
        return part.try_cast("int")

    def month_of(name: Column) -> Column:
        position = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
        return position.cast("int")

    def two_numbers(a: Column, b: Column, year: Column) -> Column:
        def in_order(n: Column) -> Column:
            x, y = n["x"], n["y"]
            day_first = F.when((x > 12) & (y <= 12), True).when((y > 12) & (x <= 12), False)
            day_first = F.coalesce(day_first, F.lit(options.date_dayfirst))
            return iso_date(
                n["year"], F.when(day_first, y).otherwise(x), F.when(day_first, x).otherwise(y)
            )

        return let(F.struct(number(a).alias("x"), number(b).alias("y"), number(year).alias("year")), in_order)

    def named(day: Column, month: Column, year: Column) -> Column:
        return iso_date(number(year), month_of(month), number(day))

    return F.coalesce(
        parts(ISO, "-", lambda y, m, d: iso_date(number(y), number(m), number(d))),
        parts(SLASHED, "/", two_numbers),
        parts(DASHED, "-", two_numbers),
        parts(DAY_MONTH_NAME, BLANK + "+", named),
        parts(MONTH_NAME_DAY, f",?{BLANK}+", lambda m, d, y: named(d, m, y)),
    )
