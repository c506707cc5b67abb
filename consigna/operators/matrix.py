"""Matrix sheets: one record per row and header column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions import cells as C
from consigna.functions.text import is_blank
from consigna.operators.extract import Mapping
from consigna.schema import SHEET


def heads_of(start_col: int) -> Column:
    """Header texts of a row from start_col (0-based) on."""
    return F.slice(C.headers(F.col("cells")), F.lit(start_col + 1), F.greatest(F.size("cells") - start_col, F.lit(0)))


def matrix_heads(sheet: DataFrame, start_col: int, header_row: int) -> DataFrame:
    """Header texts from start_col (0-based) on, one row per sheet that has the header row."""
    return sheet.filter(F.col("row_idx") == header_row).select(*SHEET, heads_of(start_col).alias("_heads"))


def matrix_unpivot(
    rows: DataFrame, mapping: Mapping, start_col: int, header_field: str, value_field: str, skip_empty: bool = False,
) -> DataFrame:
    """Unpivot the cells from start_col (0-based) on.

    The rows carry the matrix_heads and sheet_values of their sheet. The header row sets how many
    columns are read: a longer data row is cut, a shorter one gives empty cells.
    """
    base = {f: e for f, e in mapping.fields.items() if f not in (header_field, value_field)}
    long = rows.select(
        "file_id", "sheet_idx", (F.col("row_idx") + 1).alias("row_idx"), "cells",
        *[e.alias(f) for f, e in base.items()], F.posexplode("_heads").alias("matrix_col", "_head"),
    )
    out = long.withColumn("_value", C.cell(F.col("cells"), F.col("matrix_col") + start_col))
    if skip_empty:
        out = out.filter(~is_blank(F.col("_value")))
    pair = {header_field: F.col("_head"), value_field: F.col("_value")}
    return out.withColumns(pair).drop("cells", "_head", "_value")
