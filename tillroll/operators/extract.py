"""Texts -> receipts: one projection per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.functions import dates, fields, money
from tillroll.functions.text import is_blank, lines, strip, unify
from tillroll.operators.normalize import normalize
from tillroll.options import Options
from tillroll.sources.shared import stage

# How a text was read, the shortest direct text worth using, warning texts.
DIRECT, RECOGNISED, AS_TEXT = "pdf_text", "pdf_ocr", "text"
MIN_DIRECT_CHARS = 20
UNREADABLE = "could not read any text"
READ_VIA = "read via "

PIVOTS = 64  # values drawn per pass of a selection


def extract_receipts(texts: DataFrame, options: Options = Options()) -> DataFrame:
    """One receipt per (source_file, text). A blank text gives a row with a warning only.
    Other columns of the input are kept."""
    readable = evaluate_once(
        texts, _text=F.when(~is_blank(F.col("text")), unify(F.col("text")))
    )
    cut = evaluate_once(readable, _lines=fields.cut_text(F.col("_text"), options))
    priced = evaluate_once(cut, _priced=fields.money_lines(F.col("_lines"), options))
    found = evaluate_once(
        priced,
        vendor=fields.vendor(F.col("_lines")),
        date=dates.find_date(F.col("_text"), options),
        _labelled=fields.labelled_total(F.col("_priced")),
        tax=fields.labelled_tax(F.col("_priced")),
        currency=money.currency(F.col("_text"), options),
        line_items=F.coalesce(fields.line_items(F.col("_priced")), _no_items()),
    )
    totalled = evaluate_once(
        found.drop("_lines", "_priced"),
        total=F.coalesce(F.col("_labelled"), fields.largest_amount(F.col("_text"), options)),
    )
    fell_back = F.col("_labelled").isNull() & F.col("total").isNotNull()
    missing = fields.missing_fields(F.col("vendor"), F.col("date"), F.col("total"))
    warnings = F.concat(
        F.array_compact(F.array(F.when(fell_back, F.lit(fields.FALLBACK_TOTAL)))),
        fields.could_not_find(missing),
    )
    done = totalled.withColumns(
        {
            "engine": F.lit("rule_based"),
            "warnings": F.when(F.col("_text").isNull(), F.array(F.lit(fields.NO_TEXT))).otherwise(
                warnings
            ),
            "duplicate_of": F.lit(None).cast("string"),
            "extraction_failed": F.lit(False),
        }
    )
    return done.drop("_text", "_labelled")


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row however often they are used or filtered on.
    A plain projection would be merged into its readers and into pushed-down filters, and its
    patterns would run once for each of them. The generator only hands the values on: what
    stands inside a generator is interpreted, while a projection is compiled."""
    worked = df.select("*", *[c.alias(name) for name, c in columns.items()])
    return worked.select(*df.columns, F.inline(F.array(F.struct(*columns))))


def read_receipts(texts: DataFrame, options: Options = Options()) -> DataFrame:
    """Texts as they arrive -> normalised receipts of the fixed schema, one per input row.

    `texts` holds source_file and text, and may hold content_hash (else the MD5 of the text),
    method (how the text was read) and read_error (set where reading failed)."""
    given = texts.select(
        "source_file",
        F.when(_optional(texts, "read_error").isNull(), F.col("text")).alias("text"),
        F.coalesce(_optional(texts, "content_hash"), F.md5(F.coalesce("text", F.lit("")))).alias(
            "content_hash"
        ),
        F.coalesce(_optional(texts, "method"), F.lit(AS_TEXT)).alias("method"),
        _optional(texts, "read_error").alias("read_error"),
    )
    receipts = extract_receipts(given, options).withColumn(
        "warnings",
        F.when(
            is_blank(F.col("text")),
            F.array(F.coalesce("read_error", F.lit(UNREADABLE))),
        ).otherwise(F.concat(F.array(F.concat(F.lit(READ_VIA), F.col("method"))), "warnings")),
    )
    return as_receipts(normalize(receipts))


def as_receipts(df: DataFrame) -> DataFrame:
    """The columns of the receipts schema, in its order."""
    return df.select(*_RECEIPT_COLUMNS)


def choose_text(candidates: DataFrame) -> DataFrame:
    """The directly read text if it is long enough, else the recognised one. The hash of the
    bytes and a read error, where they came along, stay with the row."""
    direct = strip(F.coalesce("direct_text", F.lit("")))
    use_direct = F.length(direct) >= MIN_DIRECT_CHARS
    return candidates.select(
        "source_file",
        F.when(use_direct, direct).otherwise(F.col("ocr_text")).alias("text"),
        F.when(use_direct, F.lit(DIRECT)).otherwise(F.lit(RECOGNISED)).alias("method"),
        *[c for c in ("content_hash", "read_error") if c in candidates.columns],
    )


def receipt_lines(texts: DataFrame) -> DataFrame:
    """Long form: one row per non-blank line, numbered from 1."""
    return texts.select("source_file", F.posexplode(lines(unify(F.col("text")))).alias("pos", "line")).select(
        "source_file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def text_amounts(texts: DataFrame, options: Options = Options()) -> DataFrame:
    """Long form: one row per money amount in a text, numbered from 1."""
    found = money.amounts(unify(F.col("text")), options)
    return texts.select("source_file", F.posexplode(found).alias("pos", "amount")).select(
        "source_file", (F.col("pos") + 1).cast("bigint").alias("amount_no"), "amount"
    )


def explode_items(receipts: DataFrame) -> DataFrame:
    """Long form of the line items; a receipt without items keeps one row of nulls."""
    return receipts.select(
        "source_file", F.posexplode_outer("line_items").alias("pos", "item")
    ).select(
        "source_file",
        (F.col("pos") + 1).cast("bigint").alias("item_no"),
        F.col("item.description").alias("description"),
        F.col("item.amount").alias("amount"),
    )


def preview(texts: DataFrame, n: int) -> DataFrame:
    """The first n files by name, before any work is done on them.

    The n-th name is found first, from names and counts alone; texts are then filtered where
    they are, and neither sorted nor moved. If the n-th name occurs more often than there is
    room for, any rows of it make up the number. A row without a name is no file."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return texts.where(F.lit(False))
    last, before, of_last = nth_smallest(stage(texts.select(F.col("source_file").alias("v")), "names"), n)
    if of_last is None:
        return texts.where(F.col("source_file").isNotNull())
    if before + of_last == n:
        return texts.where(F.col("source_file") <= last)
    return texts.where(F.col("source_file") < last).unionByName(_some(texts.where(F.col("source_file") == last), n - before))


def _some(rows: DataFrame, n: int) -> DataFrame:
    """n of more rows. They are written with a number each, and the n smallest numbers found."""
    columns = rows.columns
    numbered = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "ties")
    last, _, _ = nth_smallest(numbered.select(F.col("_row").alias("v")), n)
    return numbered.where(F.col("_row") <= last).select(columns)


def nth_smallest(values: DataFrame, n: int, pivots: int = PIVOTS) -> tuple[object, int, int | None]:
    """(n-th smallest value of the column `v`, number of smaller ones, number of equal ones),
    nulls passed over; (None, 0, None) if there are fewer than n.

    A few values drawn by their hash cut what is left into ranges; one pass counts each, and
    the range that holds the n-th is looked at next. Only pivots and counts reach the driver."""
    left = values.where("v is not null")
    before, total = 0, left.count()
    if total < n:
        return None, 0, None
    while True:
        drawn = left.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
        cuts = sorted({r["v"] for r in drawn})
        counts = left.agg(
            *[F.count(F.when(F.col("v") < c, F.lit(1))).alias(f"below_{i}") for i, c in enumerate(cuts)],
            *[F.count(F.when(F.col("v") == c, F.lit(1))).alias(f"at_{i}") for i, c in enumerate(cuts)],
        ).head()
        low = high = None
        base = before
        for i, cut in enumerate(cuts):
            below, at = base + counts[f"below_{i}"], counts[f"at_{i}"]
            if below < n <= below + at:
                return cut, below, at
            if below + at < n:
                low, before = cut, below + at
            elif high is None:
                high = cut
        if low is not None:
            left = left.where(F.col("v") > low)
        if high is not None:
            left = left.where(F.col("v") < high)


def _no_items() -> Column:
    return F.array().cast(schemas.LINE_ITEMS)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


_RECEIPT_COLUMNS = (
    "source_file", "vendor", "date", "total", "tax", "currency", "line_items", "engine",
    "warnings", "content_hash", "duplicate_of", "extraction_failed",
)
