"""Texts: records between separators, fields by pattern, items by repeated pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.functions.regex import Regex, extract, split
from consigna.functions.text import is_blank


def text_split_records(texts: DataFrame, separator: Regex, text: str = "text") -> DataFrame:
    """One row per non-blank piece, numbered from 0 in `text_part`."""
    pieces = F.filter(split(F.col(text), separator), lambda p: ~is_blank(p))
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.posexplode(pieces).alias("text_part", text))


def text_fields(parts: DataFrame, patterns: dict[str, Regex | None], text: str = "text") -> DataFrame:
    """First match of each field pattern; a field that finds nothing is absent."""
    return parts.withColumns({f: F.nullif(extract(F.col(text), rx), F.lit("")) for f, rx in patterns.items()})


def text_items(parts: DataFrame, pattern: Regex, fields: list[str], text: str = "text") -> DataFrame:
    """One row per item match, its groups in the given fields; a part without items stays one row."""
    used = range(1, min(len(fields), pattern.groups) + 1) or [0]  # each is a scan of the text
    groups = {f"_g{g}": F.regexp_extract_all(F.col(text), F.lit(pattern.java), F.lit(g)) for g in used}
    rows = (
        parts.withColumns(groups)
        .select(*parts.columns, F.posexplode_outer(F.arrays_zip(*groups)).alias("item", "_item"))
    )
    values = {}
    for i, f in enumerate(fields):
        own = F.col(f) if f in parts.columns else F.lit(None).cast("string")
        caught = F.col("_item")[f"_g{i + 1}"] if i < pattern.groups else F.lit("")
        values[f] = F.when(F.col("item").isNull(), own).otherwise(caught)
    return rows.withColumns(values).withColumn("item", F.coalesce("item", F.lit(0))).drop("_item")
