"""Sheet choice and data regions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions import cells as C
from consigna.functions.regex import found, translate
from consigna.functions.text import has_content, row_text
from consigna.schema import SHEET

NO_SHEETS = "No sheet data available"
NO_SHEETS_MULTI = "No sheet data available for multi-sheet mode"


@dataclass(frozen=True)
class SheetChoice:
    """Which sheets of a file a rule reads."""

    index: int | None = None
    pattern: str | None = None
    all_sheets: bool = False

    @classmethod
    def of(cls, config: dict | None) -> SheetChoice:
        config = config or {}
        return cls(config.get("sheetIndex"), config.get("sheetNamePattern") or None, bool(config.get("allSheets")))


@dataclass(frozen=True)
class Region:
    """Header row and data rows, 0-based, the end exclusive; end None means the last used row."""

    header: int = 0
    start: int = 1
    end: int | None = None
    skip_rows: tuple[int, ...] = ()
    skip_patterns: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, config: dict | None) -> Region:
        config = config or {}
        header = config["headerRow"] - 1 if config.get("headerRow") is not None else 0
        start = config["dataStartRow"] - 1 if config.get("dataStartRow") is not None else header + 1
        end = config.get("dataEndRow", "auto")
        return cls(
            header, start, None if end == "auto" else end or 0,
            tuple(config.get("skipRows") or ()), tuple(config.get("skipPatterns") or ()),
        )


def _file_errors(rows: DataFrame, hit: Column, message: str, no_sheets: str) -> DataFrame:
    """One error per file without any hit."""
    return (
        rows.groupBy("file_id")
        .agg(F.max(F.col("sheet_idx").isNotNull()).alias("_any"), F.max(F.coalesce(hit, F.lit(False))).alias("_hit"))
        .filter(~F.col("_any") | ~F.col("_hit"))
        .select("file_id", F.when(F.col("_any"), F.lit(message)).otherwise(F.lit(no_sheets)).alias("message"))
    )


def select_sheet(rows: DataFrame, choice: SheetChoice) -> tuple[DataFrame, DataFrame]:
    """Rows of the one sheet a rule reads in each file, and an error for each file without it."""
    rx = translate(choice.pattern) if choice.pattern else None
    if choice.pattern and rx is None:
        message = f"Invalid sheetNamePattern: {choice.pattern}"
        return rows.filter(F.lit(False)), _file_errors(rows, F.lit(False), message, NO_SHEETS)
    if choice.index is not None:
        hit = F.col("sheet_idx") == choice.index
        message = f"Sheet index {choice.index} out of range"
        return rows.filter(hit), _file_errors(rows, hit, message, NO_SHEETS)
    if rx is not None:
        hit = found(F.col("sheet_name"), rx)
        first = rows.filter(hit).groupBy("file_id").agg(F.min("sheet_idx").alias("sheet_idx"))
        message = f"No sheet matches pattern: {choice.pattern}"
        return rows.join(first, SHEET, "left_semi"), _file_errors(rows, hit, message, NO_SHEETS)
    hit = F.col("sheet_idx") == 0
    return rows.filter(hit), _file_errors(rows, hit, NO_SHEETS, NO_SHEETS)


def select_sheets_union(rows: DataFrame, choice: SheetChoice) -> tuple[DataFrame, DataFrame]:
    """Rows of all sheets a multi-sheet rule reads, each sheet a table of its own.

    Every chosen sheet is then read with the whole rule again as if it were a file of one sheet, so
    an index above 0 is out of range for it and a name pattern must match it too.
    """
    empty = _file_errors(rows, F.col("sheet_idx").isNotNull(), NO_SHEETS_MULTI, NO_SHEETS_MULTI)
    rx = translate(choice.pattern) if choice.pattern else None
    if choice.all_sheets:
        taken = F.col("sheet_idx").isNotNull()
    elif rx is not None:
        taken = found(F.col("sheet_name"), rx)
    elif choice.index is not None:
        taken = F.col("sheet_idx") == choice.index
    else:
        taken = F.col("sheet_idx").isNotNull()

    if choice.pattern and rx is None:
        kept, message = F.lit(False), f"Invalid sheetNamePattern: {choice.pattern}"
    elif choice.index is not None:
        kept, message = F.lit(choice.index == 0), f"Sheet index {choice.index} out of range"
    elif rx is not None:
        kept, message = found(F.col("sheet_name"), rx), f"No sheet matches pattern: {choice.pattern}"
    else:
        kept, message = F.lit(True), ""
    refused = (
        rows.filter(taken & ~kept).groupBy(*SHEET).agg(F.lit(message).alias("message"))
        .select("file_id", "message")
    )
    return rows.filter(taken & kept), empty.unionByName(refused)


def build_headers(rows: DataFrame, header: int) -> DataFrame:
    """Trimmed header cells, one row per sheet that has the header row."""
    return rows.filter(F.col("row_idx") == header).select(*SHEET, C.headers(F.col("cells")).alias("headers"))


def resolve_column(heads: DataFrame, names: list[str], prefix: str = "col") -> DataFrame:
    """Index of each named column per sheet, NULL where no header fits."""
    return heads.select(*SHEET, *[C.resolve(F.col("headers"), n).alias(f"{prefix}_{i}") for i, n in enumerate(names)])


def auto_data_end(rows: DataFrame) -> DataFrame:
    """Exclusive end of the used rows of each sheet; a sheet without content is left out."""
    return (
        rows.filter(has_content(F.col("cells")))
        .groupBy(*SHEET).agg((F.max("row_idx") + 1).alias("data_end"))
    )


def row_text_match(pattern: str) -> Column:
    """Whether the row text matches; an invalid pattern matches nothing."""
    return found(row_text(F.col("cells")), translate(pattern))


def one_per_sheet(tables: list[DataFrame]) -> DataFrame:
    """Tables with one row per sheet as one such table.

    They are put under each other and grouped, which keeps the size estimate of the result small:
    a small result can then be broadcast, which a full join of the tables would rule out.
    """
    if len(tables) == 1:
        return tables[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    values = [c for c in stacked.columns if c not in SHEET]
    return stacked.groupBy(*SHEET).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def _kept(rows: DataFrame, region: Region) -> DataFrame:
    keep = F.col("row_idx") >= region.start
    if region.end is not None:
        keep &= F.col("row_idx") < region.end
    if region.skip_rows:
        keep &= ~F.col("row_idx").isin([r - 1 for r in region.skip_rows])
    for p in region.skip_patterns:
        keep &= ~row_text_match(p)
    return rows.filter(keep)


def region_rows(rows: DataFrame, region: Region, per_sheet: list[DataFrame | None] = ()) -> DataFrame:
    """Data rows of each sheet without the rows the rule skips.

    Adds the columns of the per_sheet tables. They are put together with the data ends first, so
    the rows take part in one join only; a join on its own can be split when a sheet is very large.
    """
    kept = _kept(rows, region)
    tables = [t for t in per_sheet if t is not None]
    if region.end is None:
        tables.append(auto_data_end(rows))
    if tables:
        kept = kept.join(one_per_sheet(tables), SHEET, "left")
    if region.end is None:
        kept = kept.filter(F.col("row_idx") < F.col("data_end")).drop("data_end")
    return kept


def sheet_profile(rows: DataFrame, region: Region, wanted: dict[str, tuple[int, Column]], more: list[Column] = ()) -> DataFrame | None:
    """All that a rule asks about a sheet as a whole, one row per sheet, from one reading of the rows.

    `wanted` are values of fixed rows as in row_scalars, `more` further aggregates; the data end is added
    when the region has none. Only that row of a sheet is worked out which a value sits in.
    """
    values = [F.max(F.when(F.col("row_idx") == r, e)).alias(n) for n, (r, e) in wanted.items()] + list(more)
    if region.end is None:
        values.append(F.max(F.when(has_content(F.col("cells")), F.col("row_idx") + 1)).alias("data_end"))
    return rows.groupBy(*SHEET).agg(*values) if values else None


def profiled_rows(rows: DataFrame, region: Region, profile: DataFrame | None) -> DataFrame:
    """Data rows of each sheet with the columns of its profile."""
    kept = _kept(rows, region)
    if profile is not None:
        kept = kept.join(profile, SHEET, "left")
    return kept if region.end is not None else kept.filter(F.col("row_idx") < F.col("data_end")).drop("data_end")


def row_scalars(rows: DataFrame, wanted: dict[str, tuple[int, Column]]) -> DataFrame | None:
    """Values that sit in fixed rows, one row per sheet.

    `wanted` maps a column name to a row and an expression over that row. A sheet has one row per
    row_idx, so picking the rows is a filter and only a handful of rows per sheet are aggregated.
    """
    if not wanted:
        return None
    index = sorted({r for r, _ in wanted.values()})
    return (
        rows.filter(F.col("row_idx").isin(index))
        .groupBy(*SHEET)
        .agg(*[F.max(F.when(F.col("row_idx") == r, e)).alias(n) for n, (r, e) in wanted.items()])
    )
