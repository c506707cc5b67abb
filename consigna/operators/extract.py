"""Field extractors: one column expression per mapped field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions import cells as C
from consigna.functions.regex import extract, translate
from consigna.functions.text import row_text, text_or_empty
from consigna.operators.sheets import row_scalars
from consigna.schema import SHEET


def col_by_index(index: int) -> Column:
    return C.cell(F.col("cells"), index)


def col_by_name(resolved: str) -> Column:
    """Cell under a header whose index was resolved per sheet."""
    return text_or_empty(F.get("cells", F.col(resolved)))


def regex_on_row(pattern: str | None, group: int | None = None) -> Column:
    if not pattern:
        return F.lit("")
    return extract(row_text(F.col("cells")), translate(pattern), 1 if group is None else group)


def static_value(value: str | None) -> Column:
    return F.lit(str(value) if value is not None else "")


def formula() -> Column:
    """Reserved in the rule language: always empty."""
    return F.lit("")


@dataclass(frozen=True)
class Mapping:
    """Field expressions, and the per-sheet values (named columns, fixed cells) they refer to."""

    fields: dict[str, Column]
    named: dict[str, str]
    cells: dict[str, tuple[int, int]]


def compile_mapping(mapping: dict[str, dict | None], has_headers: bool = True) -> Mapping:
    """Column expressions of a field mapping; extractors set to null are left out.

    Named columns need headers, without them they are empty.
    """
    fields: dict[str, Column] = {}
    named: dict[str, str] = {}
    fixed: dict[str, tuple[int, int]] = {}
    for name, ex in mapping.items():
        if ex is None:
            continue
        kind, value = ex.get("type"), F.lit("")
        if kind == "static":
            value = static_value(ex.get("staticValue"))
        elif kind == "column" and isinstance(ex.get("column"), str):
            if has_headers:
                slot = f"_named_{len(named)}"
                named[slot] = ex["column"]
                value = col_by_name(slot)
        elif kind == "column" and ex.get("column") is not None:
            value = col_by_index(ex["column"])
        elif kind == "cell":
            at = C.address(ex.get("cell") or "")
            if at:
                slot = f"_cell_{len(fixed)}"
                fixed[slot] = at
                value = text_or_empty(F.col(slot))
        elif kind == "regex":
            value = regex_on_row(ex.get("regex"), ex.get("regexGroup"))
        elif kind == "formula":
            value = formula()
        fields[name] = value
    return Mapping(fields, named, fixed)


def cell_at(rows: DataFrame, addresses: dict[str, str]) -> DataFrame:
    """Cells at A1 addresses, one row per sheet; a bad address or a missing cell is ''."""
    places = {n: C.address(a) for n, a in addresses.items()}
    wanted = {n: (p[0], C.cell(F.col("cells"), p[1])) for n, p in places.items() if p}
    sheets = rows.filter(F.col("sheet_idx").isNotNull()).select(*SHEET).distinct()
    hits = row_scalars(rows, wanted)
    out = sheets.join(hits, SHEET, "left") if hits is not None else sheets
    return out.select(*SHEET, *[text_or_empty(F.col(n)).alias(n) if p else F.lit("").alias(n) for n, p in places.items()])


def mapped_values(header: int, mapping: Mapping) -> dict[str, tuple[int, Column]]:
    """Resolved column indexes and fixed cells of a mapping: the row each sits in and its expression."""
    wanted = {s: (header, C.resolve(C.headers(F.col("cells")), n)) for s, n in mapping.named.items()}
    return wanted | {s: (r, F.get("cells", F.lit(c))) for s, (r, c) in mapping.cells.items()}


def sheet_values(sheet: DataFrame, header: int, mapping: Mapping) -> DataFrame | None:
    """Resolved column indexes and fixed cells of a mapping, one row per sheet."""
    return row_scalars(sheet, mapped_values(header, mapping))


def project_record(rows: DataFrame, mapping: Mapping, keep: list[str] = ()) -> DataFrame:
    """Records of data rows: all mapped fields in one projection, row_idx 1-based.

    The rows carry the sheet_values of the mapping; `keep` names further columns to pass on.
    """
    return rows.select(
        "file_id", "sheet_idx", (F.col("row_idx") + 1).alias("row_idx"),
        *[e.alias(f) for f, e in mapping.fields.items()], *keep,
    )
