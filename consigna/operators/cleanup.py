"""Record clean-up, in the order trim, defaults, static values, empty rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import is_empty, trim
from consigna.schema import FIELDS


def trim_fields(records: DataFrame, fields: list[str]) -> DataFrame:
    return records.withColumns({f: trim(F.col(f)) for f in fields})


def fill_defaults(records: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Default for absent and empty fields; blanks count as empty only after trimming."""
    values = {}
    for f, default in defaults.items():
        own = F.col(f) if f in records.columns else F.lit(None).cast("string")
        values[f] = F.when(is_empty(own), F.lit(default)).otherwise(own)
    return records.withColumns(values)


def override_static(records: DataFrame, values: dict[str, str]) -> DataFrame:
    return records.withColumns({f: F.lit(v) for f, v in values.items()})


def drop_empty(records: DataFrame) -> DataFrame:
    """Drop records whose ten fields are all empty."""
    have = [~is_empty(F.col(f)) for f in FIELDS if f in records.columns]
    return records.filter(reduce(lambda a, b: a | b, have, F.lit(False)))
