"""Compound cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.functions.regex import Regex, found, group_text, split
from consigna.functions.text import is_empty, trim


def cell_split(
    records: DataFrame, target: str, separator: Regex | None, pattern: Regex | None, fields: list[str]
) -> DataFrame:
    """One record per non-blank part of a field, with `split` as its number.

    A value with a single part stays as it is, without extraction. A value whose parts are all
    blank removes its record.
    """
    if separator is None or target not in records.columns:
        return records.withColumn("split", F.lit(0))
    cut = records.withColumn("_parts", split(F.col(target), separator))
    untouched = is_empty(F.col(target)) | (F.size("_parts") <= 1)
    pieces = F.when(untouched, F.array(F.lit(None).cast("string"))).otherwise(
        F.filter(F.transform("_parts", trim), lambda p: p != "")
    )
    out = cut.select(*records.columns, F.posexplode(pieces).alias("split", "_piece"))
    piece, values = F.col("_piece"), {}
    for i, f in enumerate(fields):
        own = F.col(f) if f in records.columns else F.lit(None).cast("string")
        rest = piece if i == 0 else own
        if pattern is None:
            filled = rest
        else:
            filled = F.when(found(piece, pattern), group_text(piece, pattern, i + 1)).otherwise(rest)
        values[f] = F.when(piece.isNull(), own).otherwise(filled)
    return out.withColumns(values).drop("_piece")
