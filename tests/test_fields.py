"""Expressions on single texts."""

import pytest
from pyspark.sql import functions as F

from tillroll.functions import dates, fields, money
from tillroll.functions.text import clean_text, has_letters, lines, strip, unify
from tillroll.operators.extract import extract_receipts, read_receipts
from tillroll.options import Options


def values(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string").select("i", expression(F.col("text")).alias("v"))
    return [r.v for r in sorted(df.collect())]


AMOUNTS = {
    "TOTAL $1,234.56": ([1234.56], [1234.56]),
    "TOTAL 1234.56": ([1234.56], [4.56]),
    "TOTAL $1234.56": ([1234.56], [123.0, 4.56]),
    "TOTAL 112946.26": ([112946.26], [946.26]),
    "Tax 8.25%  $1.03": ([8.25, 1.03], [8.25, 1.03]),
    "Tax 1.234": ([1.23], [1.23]),
    "5kg rice  ₱ 99.00": ([99.0], [99.0]),
    "Date: 05.01.2026": ([5.01], [5.01]),
    "INV 2024": ([], []),
    "$ 5": ([5.0], [5.0]),
    "$\n5": ([5.0], [5.0]),
    "refund -5.00": ([5.0], [5.0]),
    "a 1,23.4": ([23.4], [23.4]),
    "1,2345.67": ([5.67], [5.67]),
    "$ x 5 6.5": ([6.5], [6.5]),
    "£\xa07": ([7.0], [7.0]),
    "٣.٥٠": ([3.5], [3.5]),
    "": ([], []),
}


@pytest.mark.parametrize("grammar", ["whole", "split"])
def test_amounts(spark, grammar):
    options = Options(amount_grammar=grammar)
    got = values(spark, list(AMOUNTS), lambda t: money.amounts(unify(t), options))
    assert got == [v[grammar == "split"] for v in AMOUNTS.values()]


def test_symbols_special_to_patterns(spark):
    options = Options(currency_symbols=("^", "]", "-", "kr"))
    got = values(spark, ["^5", "] 6", "-7", "kr 8", "a9", "$1"], lambda t: money.amounts(unify(t), options))
    assert got == [[5.0], [6.0], [7.0], [8.0], [], []]
    found = values(spark, ["x kr", "]", "r", "^]"], lambda t: money.currency(t, options))
    assert found == ["kr", "]", None, "^"]


def test_symbols_that_are_letters(spark, texts):
    df = extract_receipts(texts({"a": "Shop\nAmount due 5.00\n2 Tee 7"}), Options(currency_symbols=("e",)))
    row = df.head()
    assert (row.total, row.vendor, [tuple(i) for i in row.line_items]) == (5.0, "Shop", [("2 Te", 7.0)])


LABELLED = {
    "Subtotal 8.00\nTax 0.50\nTOTAL 8.50": (8.5, 0.5),
    "Sub total 8.00": (8.0, None),
    "TOTAL 8.50\nTotal tax 0.50": (0.5, 0.5),
    "TOTAL 8.50\nTOTAL": (8.5, None),
    "Grand total incl. subtotal 9.00": (9.0, None),
    "Taxi fare 12.00": (12.0, 12.0),
    "TOTAL\n8.50": (8.5, None),
    "Amount due: €3 (was 4.50)": (4.5, None),
    "balance due 1.00 in 30 days": (1.0, None),
    "5.00 total": (5.0, None),
    "TOTAL $\n7": (7.0, None),
    "Total 1.50 2": (1.5, None),
    "Total 1.50 $2 3": (2.0, None),
    "TOTAL 1.00\r\nTOTAL 2.00\x85TOTAL 3.00": (3.0, None),
}


def test_labelled_amounts(spark, texts):
    rows = extract_receipts(texts({t: t for t in LABELLED})).collect()
    assert {r.source_file: (r.total, r.tax) for r in rows} == LABELLED


def test_fallback_total_says_so(spark, texts):
    df = extract_receipts(texts({"a": "TOTAL\n8.50", "b": "TOTAL 8.50", "c": "nothing here"}))
    got = {r.source_file: (r.total, r.warnings) for r in df.collect()}
    # The bare label line has letters and no money, so it is taken for the vendor.
    assert got["a"] == (8.5, [fields.FALLBACK_TOTAL, "could not find date"])
    assert got["b"] == (8.5, ["could not find vendor", "could not find date"])
    assert got["c"] == (None, ["could not find date", "could not find total"])


DATES = {
    "2026-01-05": "2026-01-05",
    "2026-02-31": "2026-02-31",
    "2026-13-05 01/02/2026": "2026-01-02",
    "2026-13-05 2026-01-05": None,
    "07/08/2026": "2026-07-08",
    "25/12/2026": "2026-12-25",
    "12-25-2026": "2026-12-25",
    "13/14/2026": None,
    "5 January 2026": "2026-01-05",
    "Jan 5, 2026": "2026-01-05",
    "Jan 5 2026": "2026-01-05",
    "Marble 5 2026": "2026-03-05",
    "1/2/26": None,
    "2026-1-5": None,
    "1850-01-01": None,
    "x2026-01-05": None,
    "2026-01-05x": None,
    "é2026-01-05": None,
    "12026-01-05": None,
    "on 1/2/2026.": "2026-01-02",
    "123/4/2026 5-6-2026": "2026-05-06",
    "5\nJanuary\n2026": "2026-01-05",
    "٢٠٢٦-٠١-٠٥": "2026-01-05",
    "": None,
}


def test_dates(spark):
    got = values(spark, list(DATES), lambda t: dates.find_date(unify(t), Options()))
    assert dict(zip(DATES, got)) == DATES


def test_dates_day_first(spark):
    written = ["07/08/2026", "25/12/2026", "12-25-2026", "2026-01-05", "13/14/2026"]
    got = values(spark, written, lambda t: dates.find_date(unify(t), Options(date_dayfirst=True)))
    assert got == ["2026-08-07", "2026-12-25", "2026-12-25", "2026-01-05", None]


VENDORS = {
    "Corner Cafe\nDate: 2026-01-05": "Corner Cafe",
    "Border Books\nAcme": "Acme",
    "Daily Times\nTax Invoice\nAcme": "Acme",
    "A1\nAcme": "Acme",
    "Acme 5.00\nBeta": "Beta",
    "Store 24\nBeta": "Store 24",
    "1\n2\n3\n4\n5\n6\nAcme": None,
    "1\n\n2\n\n3\n\n4\n\n5\n\nAcme": "Acme",
    "  ÅÄÖ \x1c": "ÅÄÖ",
    "$5 shop\nx": None,
}


def test_vendors(spark, texts):
    rows = extract_receipts(texts({t: t for t in VENDORS})).collect()
    assert {r.source_file: r.vendor for r in rows} == VENDORS


ITEMS = {
    "Item A          5.00": [("Item A", 5.0)],
    "Date: 05.01.2026": [("Date", 5.01)],
    "Qty 3 Widget @ 2.50 = 7.50 each": [("Qty 3 Widget @ 2.50 =", 7.5)],
    "Subtotal 8.00": [],
    "5.00": [],
    "5kg rice  ₱ 99.00": [("5kg rice", 99.0)],
    "Item -\xa05.00": [("Item", 5.0)],
    "Item -\xa0$5.00": [("Item -\xa0", 5.0)],
    "Item\t-\t$5.00": [("Item", 5.0)],
    "1,234 bolts $5": [("1,234 bolts", 5.0)],
    "Tea .... £2": [("Tea", 2.0)],
    "ab 1.00\ncd 2.00 3\n": [("ab", 1.0), ("cd", 2.0)],
}


def test_line_items(spark, texts):
    rows = extract_receipts(texts({t: t for t in ITEMS})).collect()
    assert {r.source_file: [tuple(i) for i in r.line_items] for r in rows} == ITEMS


def test_every_input_row_comes_out(spark, texts):
    df = read_receipts(texts({"a": "Shop\n2026-01-05\nTOTAL 5.00", "b": "", "c": " \n\x1f　", "d": None}))
    got = {r.source_file: r for r in df.collect()}
    assert got["a"].warnings == ["read via text"]
    for name in "bcd":
        assert got[name].warnings == ["could not read any text"]
        assert (got[name].vendor, got[name].total, got[name].line_items) == (None, None, [])
        assert got[name].extraction_failed is False
    blank = extract_receipts(texts({"b": " "})).head()
    assert blank.warnings == ["no text to parse"]


def test_read_errors_and_methods_are_kept(spark):
    df = spark.createDataFrame(
        [("a", "TOTAL 5.00", "h", "pdf_ocr", None), ("b", "TOTAL 5.00", "h", None, "broken")],
        "source_file string, text string, content_hash string, method string, read_error string",
    )
    got = {r.source_file: r for r in read_receipts(df).collect()}
    assert got["a"].warnings[0] == "read via pdf_ocr" and got["a"].content_hash == "h"
    assert got["b"].warnings == ["broken"] and got["b"].total is None


def test_long_texts_do_not_blow_the_stack_or_the_clock(spark, texts):
    blanks, words = " \t" * 100_000, "word 12 " * 50_000
    df = read_receipts(texts({"a": f"Shop\nTOTAL{blanks}5.00{blanks}\n", "b": words + "$3"}))
    got = {r.source_file: r for r in df.collect()}
    assert got["a"].total == 5.0
    assert got["b"].total == 3.0 and got["b"].line_items[0].amount == 3.0


def test_blanks_and_lines(spark):
    assert values(spark, ["\x1c a b \x85", "　"], strip) == ["a b", ""]
    assert values(spark, [" a \t\xa0 b ", "a b", " \n", None], clean_text) == ["a b", "a b", None, None]
    text = "a\r\nb\n\n c \x1d d\x0be"
    assert values(spark, [text], lambda t: lines(unify(t))) == [["a", "b", "c", "d", "e"]]
    assert values(spark, ["a1b", "ab2c", "é漢ß", "a"], lambda t: has_letters(t, 3)) == [False, True, True, False]


def test_options_are_checked():
    for bad in ({"engine": "magic"}, {"output_format": "xlsx"}, {"currency_symbols": ()}, {"amount_grammar": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options().with_overrides(date_dayfirst=True).date_dayfirst
