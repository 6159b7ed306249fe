"""The flat report: ten text columns, one row per receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import money_text

# Report columns and separators.
COLUMNS = (
    "Source File", "Vendor", "Date", "Currency", "Total", "Tax",
    "Line Items", "Duplicate Of", "Engine", "Warnings",
)
SEPARATOR = "; "


def report_rows(receipts: DataFrame) -> DataFrame:
    cells = (
        F.col("source_file"), F.col("vendor"), F.col("date"), F.col("currency"),
        money_text(F.col("total")), money_text(F.col("tax")),
        F.array_join(F.transform("line_items", _item_text), SEPARATOR),
        F.col("duplicate_of"), F.col("engine"), F.array_join("warnings", SEPARATOR),
    )
    return receipts.select(
        *[F.coalesce(cell, F.lit("")).alias(name) for cell, name in zip(cells, COLUMNS)]
    )


def _item_text(item: Column) -> Column:
    amount = F.concat(F.lit(" ("), money_text(item["amount"]), F.lit(")"))
    return F.concat(item["description"], F.coalesce(amount, F.lit("")))
