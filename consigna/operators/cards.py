"""Card sheets: runs of rows that open with a start row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consigna.functions import cells as C
from consigna.functions.regex import Regex, extract, found
from consigna.functions.text import is_blank, row_text
from consigna.operators.extract import Mapping
from consigna.schema import BLOCK_ROWS, SHEET

CARD = [*SHEET, "card_start"]


def card_segment(rows: DataFrame, start: Regex, end: Regex | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that belong to a card, with the card's first row and the offset from it.

    A start row opens a card and closes the one before. An end row closes its card and belongs to
    it. A row's card is the last start at or before it, so all that is needed are running maxima.
    They run inside blocks of rows; the maxima of the blocks before come from a table of one row
    per block, so one huge sheet is still many tasks.
    """
    text = row_text(F.col("cells"))
    marked = rows.filter(F.col("row_idx").isNotNull()).withColumns({
        "_block": F.floor(F.col("row_idx") / block_rows),
        "_start": F.when(found(text, start), F.col("row_idx")),
        "_end": F.when(~found(text, start) & found(text, end), F.col("row_idx")),
    })
    earlier = Window.partitionBy(*SHEET).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*SHEET, "_block").agg(F.max("_start").alias("_s"), F.max("_end").alias("_e"))
        .withColumns({"_start_in": F.max("_s").over(earlier), "_end_in": F.max("_e").over(earlier)})
        .filter(F.col("_block") > 0)
        .drop("_s", "_e")
    )
    inside = Window.partitionBy(*SHEET, "_block").orderBy("row_idx")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        marked.withColumns({"_start_here": F.max("_start").over(upto), "_end_here": F.max("_end").over(above)})
        .join(carried, [*SHEET, "_block"], "left")
        .withColumns({
            "card_start": F.coalesce("_start_here", "_start_in"),
            "_last_end": F.coalesce("_end_here", "_end_in"),
        })
        .filter(F.col("card_start").isNotNull())
        .filter(F.col("_last_end").isNull() | (F.col("_last_end") < F.col("card_start")))
    )
    return placed.select(
        *[F.col(c) for c in rows.columns], "card_start", (F.col("row_idx") - F.col("card_start")).alias("card_off")
    )


def with_card_values(rows: DataFrame, patterns: dict[str, Regex]) -> DataFrame:
    """Rows with what each has for the fields of a card, worked out before rows are shuffled for their cards.

    Where nothing else reads the cells of a card, they are not shuffled then.
    """
    text = row_text(F.col("cells"))
    return rows.withColumns({f"_value_{f}": F.nullif(extract(text, rx), F.lit("")) for f, rx in patterns.items()})


def card_metadata(cards: DataFrame, patterns: dict[str, Regex]) -> DataFrame:
    """First non-empty extract of each field in each card, one row per card; see with_card_values."""
    text = row_text(F.col("cells"))
    values = {
        f: F.col(f"_value_{f}") if f"_value_{f}" in cards.columns else F.nullif(extract(text, rx), F.lit(""))
        for f, rx in patterns.items()}
    if not values:
        return cards.filter(F.col("card_off") == 0).select(*CARD)
    hits = (
        cards.select(*CARD, "card_off", *[e.alias(f) for f, e in values.items()])
        .filter((F.col("card_off") == 0) | F.coalesce(*values).isNotNull())
    )
    return hits.groupBy(*CARD).agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("card_off"))).alias(f) for f in values]
    )


def card_record(meta: DataFrame) -> DataFrame:
    """One record per card from its metadata alone."""
    return meta.withColumn("row_idx", F.col("card_start") + 1).drop("card_start")


def card_inner_table(
    cards: DataFrame, meta: DataFrame, mapping: Mapping, header_off: int = 0, data_off: int | None = None
) -> DataFrame:
    """One record per non-blank inner row; inner fields replace card fields even when empty.

    Reading stops at a start row, so a data offset of 0 yields nothing unless that row is blank.
    """
    data_off = header_off + 1 if data_off is None else data_off
    blank = is_blank(F.array_join("cells", "", ""))
    wanted = {s: (header_off, C.resolve(C.headers(F.col("cells")), n)) for s, n in mapping.named.items()}
    wanted |= {s: (r, F.get("cells", F.lit(c))) for s, (r, c) in mapping.cells.items()}
    if data_off <= 0:
        wanted["_blank_start"] = (0, blank)
    data = cards.filter((F.col("card_off") >= max(data_off, 1)) & ~blank)
    per_card = meta
    if wanted:
        offsets = sorted({o for o, _ in wanted.values()})
        values = (
            cards.filter(F.col("card_off").isin(offsets)).groupBy(*CARD)
            .agg(*[F.max(F.when(F.col("card_off") == o, e)).alias(n) for n, (o, e) in wanted.items()])
        )
        per_card = meta.join(values, CARD, "left")
    data = data.join(per_card, CARD, "left")
    if data_off <= 0:
        data = data.filter(F.col("_blank_start"))
    fields = [c for c in meta.columns if c not in CARD and c not in mapping.fields]
    return data.select(
        *SHEET, (F.col("row_idx") + 1).alias("row_idx"), *fields,
        *[e.alias(f) for f, e in mapping.fields.items()],
    )
