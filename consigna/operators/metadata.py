"""Values outside the data region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions import cells as C
from consigna.functions.regex import extract, translate
from consigna.functions.text import is_empty, row_text, trim
from consigna.operators.sheets import Region, row_text_match
from consigna.schema import SHEET


def region_fault(regions: list[dict]) -> str | None:
    """Error of a rule that asks for a row before the first one."""
    for r in regions:
        if r.get("searchArea") == "specific-row" and r.get("row") is not None and r["row"] < 1:
            read = "map" if r.get("searchPattern") or r.get("column") is None else str(r["column"])
            return f"Engine error: Cannot read properties of undefined (reading '{read}')"
    return None


def _rows_of(meta: dict, region: Region) -> Column:
    area = meta.get("searchArea")
    if area == "header":
        rows = F.col("row_idx") <= region.header
    elif area == "footer":
        # The area starts with the data rows, not after them.
        rows = F.col("row_idx") >= region.start
    elif area == "specific-row":
        rows = F.col("row_idx") == meta["row"] - 1 if meta.get("row") is not None else F.lit(False)
    else:
        rows = F.lit(True)
    if meta.get("searchPattern"):
        rows &= row_text_match(meta["searchPattern"])
    return rows


def _value_of(meta: dict) -> Column:
    cells = F.col("cells")
    text = C.cell(cells, meta["column"]) if meta.get("column") is not None else row_text(cells)
    value = extract(text, translate(meta["regex"])) if meta.get("regex") else trim(text)
    return F.nullif(value, F.lit(""))


def metadata_lookup(rows: DataFrame, metas: list[dict], region: Region) -> DataFrame:
    """First value of each region in row order (`_meta_0`, `_meta_1`, …), one row per sheet."""
    names = [f"_meta_{i}" for i in range(len(metas))]
    values = [F.when(_rows_of(m, region), _value_of(m)).alias(n) for m, n in zip(metas, names)]
    found = rows.select(*SHEET, "row_idx", *values).filter(F.coalesce(*names).isNotNull())
    return found.groupBy(*SHEET).agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("row_idx"))).alias(n) for n in names]
    )


def metadata_values(metas: list[dict], region: Region) -> list[Column]:
    """The columns of metadata_lookup as aggregates over the rows of a sheet."""
    out = []
    for i, m in enumerate(metas):
        value = F.when(_rows_of(m, region), _value_of(m))
        out.append(F.min_by(value, F.when(value.isNotNull(), F.col("row_idx"))).alias(f"_meta_{i}"))
    return out


def metadata_columns(metas: list[dict]) -> dict[str, Column]:
    """One column per target field; a later region with a value wins."""
    targets: dict[str, list[Column]] = {}
    for i, m in enumerate(metas):
        targets.setdefault(m["targetField"], []).insert(0, F.col(f"_meta_{i}"))
    return {f"_found_{t}": F.coalesce(*c) for t, c in targets.items()}


def metadata_merge(found: DataFrame, metas: list[dict]) -> DataFrame:
    """One column per target field; a later region with a value wins."""
    return found.select(*SHEET, *[c.alias(n) for n, c in metadata_columns(metas).items()])


def metadata_fill(records: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Fill the empty fields of each record with what its sheet says.

    Without `merged` the records already carry its columns.
    """
    out = records if merged is None else records.join(merged, SHEET, "left")
    fields = [c.removeprefix("_found_") for c in out.columns if c.startswith("_found_")]
    filled = {}
    for f in fields:
        meta = F.col(f"_found_{f}")
        own = F.col(f) if f in records.columns else F.lit(None).cast("string")
        filled[f] = F.when(is_empty(own) & meta.isNotNull(), meta).otherwise(own)
    return out.withColumns(filled).drop(*[f"_found_{f}" for f in fields])
