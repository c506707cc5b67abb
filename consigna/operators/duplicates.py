"""Duplicate codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import trim


def _coded(records: DataFrame) -> DataFrame:
    return records.withColumn("code", trim(F.col("externalCode")))


def duplicate_codes(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trimmed non-empty codes that occur more than once, with their count."""
    return (
        _coded(records).filter(F.col("code") != "")
        .groupBy(*(by or []), "code").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def dup_in_batch(records: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Keys of all records whose code occurs more than once in the same import.

    One row per record instead of one list per code, so a code that fills a third of an import is
    no longer row than any other. Counting combines before the shuffle, and the join back splits a
    large code.
    """
    on = [*(by or []), "code"]
    return _coded(records).select(*on, *[k for k in keys if k not in on]).join(duplicate_codes(records, by), on)


def dup_vs_store(records: DataFrame, orders: DataFrame) -> DataFrame:
    """Flags records whose trimmed code is already the code of a stored order."""
    known = orders.select(F.col("external_code").alias("code")).distinct().withColumn("_known", F.lit(True))
    return (
        _coded(records).join(known, "code", "left")
        .withColumn("in_store", F.coalesce((F.col("code") != "") & F.col("_known"), F.lit(False)))
        .drop("_known")
    )
