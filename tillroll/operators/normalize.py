"""Tidy the fields of a receipt; nothing is invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import round_money
from tillroll.functions.text import clean_text

# Fixed value: warning text.
TAX_OVER_TOTAL = "tax is greater than total — check this row"


def normalize(receipts: DataFrame) -> DataFrame:
    tidy = receipts.withColumns(
        {
            "vendor": clean_text(F.col("vendor")),
            "total": round_money(F.col("total")),
            "tax": round_money(F.col("tax")),
            "line_items": F.transform("line_items", _tidy_item),
        }
    )
    over = (F.col("tax") > F.col("total")) & ~F.isnan("tax")
    return tidy.withColumn(
        "warnings", F.when(over, F.array_append("warnings", F.lit(TAX_OVER_TOTAL))).otherwise(F.col("warnings"))
    )


def _tidy_item(item: Column) -> Column:
    return F.struct(
        F.coalesce(clean_text(item["description"]), F.lit("")).alias("description"),
        round_money(item["amount"]).alias("amount"),
    )
