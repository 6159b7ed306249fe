"""Receipt fields out of one unified text (see `text.unify`).

`cut_text` finds the lines and their money, `money_lines` labels the lines that hold any; the
other functions pick from these two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions import money
from tillroll.functions.text import contains_any, has_letters, let, lines
from tillroll.options import Options

# Words that label an amount, and words no vendor line may hold.
TOTAL_LABELS = ("grand total", "total due", "amount due", "balance due", "total")
TAX_LABELS = ("tax", "vat", "gst", "sales tax")
SUBTOTAL = "subtotal"
GRAND_TOTAL = "grand total"
VENDOR_SKIP = ("receipt", "invoice", "tax invoice", "order", "date", "time")
VENDOR_LINES = 6
DESCRIPTION_ENDS = " .:-"

# Warning texts.
FALLBACK_TOTAL = "total not labelled; used largest amount on receipt"
NO_TEXT = "no text to parse"
KEY_FIELDS = ("vendor", "date", "total")


def cut_text(text: Column, options: Options) -> Column:
    """The non-blank lines; those that hold money are cut around their last money."""
    return lines(money.cut_lines(text, options))


def money_lines(cut: Column, options: Options) -> Column:
    """One struct per line with money: which labels the line holds, and its parts. Lines
    without money have no say in totals, tax or items, whatever they hold."""

    def scan(line: Column) -> Column:
        return let(money.cut_parts(line), lambda parts: labelled(line, parts))

    def labelled(line: Column, parts: Column) -> Column:
        # Marks lie around symbols and numbers, so they split a label only if it has letters
        # that are symbols. Otherwise the money has no say: without it most lines are plain ASCII,
        # which is lower-cased as bytes.
        words = money.unmark(line) if money.symbols_may_be_letters(options) else money.beside_money(parts)
        labels = let(
            F.lower(words),
            lambda low: F.struct(
                contains_any(low, TOTAL_LABELS).alias("total"),
                contains_any(low, TAX_LABELS).alias("tax"),
                F.contains(low, F.lit(SUBTOTAL)).alias("subtotal"),
                F.contains(low, F.lit(GRAND_TOTAL)).alias("grand_total"),
            ),
        )
        return F.struct(labels.alias("has"), parts.alias("parts"))

    return F.transform(F.filter(cut, money.has_money), scan)


def _amount(line: Column) -> Column:
    return money.parse_amount(F.get(line["parts"], F.lit(2)))


def _last_amount(priced: Column, wanted) -> Column:
    return let(F.filter(priced, wanted), lambda hits: _amount(F.get(hits, F.size(hits) - 1)))


def labelled_total(priced: Column) -> Column:
    return _last_amount(
        priced,
        lambda s: s["has"]["total"] & (~s["has"]["subtotal"] | s["has"]["grand_total"]),
    )


def labelled_tax(priced: Column) -> Column:
    return _last_amount(priced, lambda s: s["has"]["tax"])


def largest_amount(text: Column, options: Options) -> Column:
    return F.array_max(money.amounts(text, options))


def vendor(cut: Column) -> Column:
    """First of the top lines that has letters, no money and none of the skip words."""

    def is_noise(low: Column) -> Column:
        return contains_any(low, VENDOR_SKIP)

    def name_or_null(line: Column) -> Column:
        usable = ~money.has_money(line) & has_letters(line, 3)
        name = F.when(usable, money.unmark(line))
        return let(name, lambda n: F.when(~let(F.lower(n), is_noise), n))

    # Mostly the first line is it, and the others need not be looked at.
    others = F.transform(F.slice(cut, 2, VENDOR_LINES - 1), name_or_null)
    return F.coalesce(name_or_null(F.get(cut, F.lit(0))), F.get(F.array_compact(others), F.lit(0)))


def line_items(priced: Column) -> Column:
    """Unlabelled lines that end in money after a description of at least two letters."""
    unlabelled = F.filter(
        priced, lambda s: ~s["has"]["total"] & ~s["has"]["tax"] & ~s["has"]["subtotal"]
    )

    def item(s: Column) -> Column:
        before, symbol = F.get(s["parts"], F.lit(0)), F.get(s["parts"], F.lit(1))
        # Without a symbol the blanks before the number belong to the number.
        before = F.when(symbol == "", F.rtrim(before, F.lit(" \xa0"))).otherwise(before)
        return F.struct(
            let(before, lambda b: F.trim(money.unmark(b), F.lit(DESCRIPTION_ENDS))).alias(
                "description"
            ),
            _amount(s).alias("amount"),
        )

    return F.filter(F.transform(unlabelled, item), lambda i: has_letters(i["description"], 2))


def missing_fields(vendor: Column, date: Column, total: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.coalesce(vendor, F.lit("")) == "", F.lit("vendor")),
            F.when(F.coalesce(date, F.lit("")) == "", F.lit("date")),
            F.when(total.isNull(), F.lit("total")),
        )
    )


def could_not_find(missing: Column) -> Column:
    return F.transform(missing, lambda name: F.concat(F.lit("could not find "), name))
