"""Corrections and deletions on imported records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import number_text, to_number
from consigna.operators.skew import number_rows


def apply_corrections(records: DataFrame, corrections: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Set single fields: `corrections` has the keys, field, value and order columns, last one wins.

    A quantity is read as a number unless it is empty.
    """
    last = (
        corrections.filter(F.col("field").isin(fields))
        .groupBy(*keys)
        .agg(*[
            F.max_by(F.struct("value"), F.when(F.col("field") == f, F.struct(*order))).alias(f"_new_{f}")
            for f in fields
        ])
    )
    out = records.join(last, keys, "left")
    new = {f: F.col(f"_new_{f}")["value"] for f in fields}
    if "skuQuantity" in fields:
        out = out.withColumn("_number", to_number(new["skuQuantity"]))
        new["skuQuantity"] = F.when(new["skuQuantity"] == "", "").otherwise(number_text(F.col("_number")))
    values = {f: F.when(F.col(f"_new_{f}").isNotNull(), v).otherwise(F.col(f)) for f, v in new.items()}
    return out.withColumns(values).select(*records.columns)


def delete_rows(
    records: DataFrame, deleted: DataFrame, keys: list[str], by: list[str], order: list[Column], block: list[Column]
) -> DataFrame:
    """Remove records by key and number the rest of each import densely from 1."""
    rest = records.join(deleted.select(*keys).distinct(), keys, "left_anti")
    return number_rows(rest, by, block, order, "row_idx")
