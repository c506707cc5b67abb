"""File names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """Lower case text after the last dot; the whole name when it has none."""
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def file_type(name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(ext.isin("xlsx", "xls"), "excel")
        .when(ext == "docx", "word")
        .when(ext == "pdf", "pdf")
    )


def file_type_from_name(files: DataFrame, name: str = "file_name", size: str | None = None) -> DataFrame:
    """Adds file_type and why a file is not taken: not a supported type, or empty."""
    kind = file_type(F.col(name))
    reason = F.when(kind.isNull(), F.lit("unsupported"))
    if size is not None:
        reason = reason.when(F.col(size) == 0, F.lit("empty"))
    return files.withColumns({"file_type": kind, "rejected": reason})
