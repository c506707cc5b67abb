"""Counts over parsed records and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consigna.functions.text import is_empty, text_or_empty
from consigna.schema import FIELDS, ORDER_KEYS


def parse_summary(files: DataFrame, records: DataFrame, errors: DataFrame) -> DataFrame:
    """Per file: success (no errors) and how many records it gave."""
    rows = records.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"))
    faults = errors.groupBy("file_id").agg(F.count(F.lit(1)).alias("_e"))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return (
        files.select("file_id").distinct().join(rows, "file_id", "left").join(faults, "file_id", "left")
        .select("file_id", F.col("_e").isNull().alias("success"), n.alias("total_rows"), n.alias("parsed_rows"))
    )


def field_coverage(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Percent of records with a value, per field; all fields in one pass."""
    counts = records.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(~is_empty(F.col(f))).alias(f) for f in FIELDS]
    )
    return (
        counts.filter(F.col("_n") > 0)
        .unpivot([*(by or []), "_n"], FIELDS, "field", "filled")
        .select(*(by or []), "field", F.round(F.col("filled") * 100.0 / F.col("_n")).cast("bigint").alias("percent"))
    )


def suite_summary(routed: DataFrame, summary: DataFrame) -> DataFrame:
    """How many files have a rule, parsed without error, failed, and gave no rows."""
    ok = F.coalesce("success", F.lit(False))
    return routed.join(summary, "file_id", "left").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("rule_id").isNotNull()).alias("matched"),
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.coalesce("total_rows", F.lit(0)) == 0).alias("without_rows"),
    )


def sample_records(records: DataFrame, n: int = 3, by: str = "file_id", order: list[str] | None = None) -> DataFrame:
    """First n records per file as text, without helper fields."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(order or ORDER_KEYS)))
    first = records.withColumn("position", rank).filter(F.col("position") <= n)
    return first.select(by, "position", *[text_or_empty(F.col(f)).alias(f) for f in FIELDS])
