"""Grid tables: one row per sheet row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import is_blank
from consigna.schema import GRID_JSON


def grid_from_json(docs: DataFrame, file_id: str = "file_id", body: str = "body") -> DataFrame:
    """Sheet rows of JSON documents; numbers become text."""
    doc = docs.select(F.col(file_id).alias("file_id"), F.from_json(body, GRID_JSON).alias("doc"))
    sheets = doc.select("file_id", F.posexplode_outer("doc.sheets").alias("sheet_idx", "sheet"))
    return sheets.select(
        "file_id", "sheet_idx", F.col("sheet.name").alias("sheet_name"),
        F.posexplode_outer("sheet.data").alias("row_idx", "cells"),
    )


def texts_from_json(docs: DataFrame, file_id: str = "file_id", body: str = "body") -> DataFrame:
    """Text pages of JSON documents; a full text comes before its pages and replaces them."""
    doc = docs.select(F.col(file_id).alias("file_id"), F.from_json(body, GRID_JSON).alias("doc"))
    pages = F.when(F.col("doc.text").isNotNull(), F.array("doc.text")).otherwise(F.col("doc.pages"))
    return doc.select(
        "file_id", F.col("doc.type").alias("file_type"),
        F.posexplode_outer(pages).alias("page_idx", "text"),
    )


def grid_from_lines(
    sheets: DataFrame, text: str, delimiter: str, sheet: int | None = 0
) -> DataFrame:
    """Rows and cells of delimited text, one sheet per input row.

    `sheets` has file_id, sheet_idx, sheet_name and the text. A blank cell is NULL. `sheet` picks
    one sheet of each file; None keeps all of them.
    """
    if sheet is not None:
        sheets = sheets.filter(F.col("sheet_idx") == sheet)
    lines = sheets.select(
        "file_id", "sheet_idx", "sheet_name",
        F.posexplode_outer(F.split(F.col(text), "\n", -1)).alias("row_idx", "line"),
    )
    return lines.select(
        "file_id", "sheet_idx", "sheet_name", "row_idx", _cells("line", delimiter).alias("cells")
    )


def _cells(line: str, delimiter: str) -> Column:
    parts = F.split(F.col(line), rf"\Q{delimiter}\E", -1)
    return F.transform(parts, lambda c: F.when(~is_blank(c), c))
