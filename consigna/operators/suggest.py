"""Tables around rule suggestion: previews and prompts in, cleaned answers out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions.regex import translate
from consigna.functions.text import text_or_empty, trim

PREVIEW_ROWS = 20
PREVIEW_CHARS = 5000

# Default name of a suggested rule and the blocks a rule may have.
DEFAULT_NAME = "AI生成的规则"
BLOCKS = [
    "source", "dataRegion", "fieldMapping", "aggregation", "matrixTranspose", "cardParsing",
    "textParsing", "cellSplitting", "metadataExtraction", "postProcessing",
]


def preview_rows(rows: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """First rows of the first sheet of each file."""
    return rows.filter((F.col("sheet_idx") == 0) & (F.col("row_idx") < n))


def preview_sample(rows: DataFrame) -> DataFrame:
    """Per file: first rows as tab-separated lines and as cells, row count, sheet names."""
    first = preview_rows(rows).groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "row_idx", F.transform("cells", lambda c: text_or_empty(c)).alias("cells")))).alias("_rows")
    )
    size = rows.groupBy("file_id").agg(
        F.count_if((F.col("sheet_idx") == 0) & F.col("row_idx").isNotNull()).alias("total_rows")
    )
    names = rows.select("file_id", "sheet_idx", "sheet_name").distinct()
    sheets = names.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("sheet_idx", "sheet_name"))).alias("_sheets"))
    return (
        size.join(first, "file_id", "left").join(sheets, "file_id", "left")
        .select(
            "file_id", "total_rows",
            text_or_empty(F.array_join(F.transform("_rows", lambda r: F.array_join(r["cells"], "\t")), "\n")).alias("content"),
            F.transform("_rows", lambda r: r["cells"]).alias("sample"),
            F.transform("_sheets", lambda s: s["sheet_name"]).alias("sheet_names"),
        )
    )


def preview_text(texts: DataFrame, chars: int | None = None) -> DataFrame:
    """Per text: its first lines and line count, or its first characters."""
    lines = F.split("text", "\n", -1)
    content = F.substring("text", 1, chars) if chars else F.array_join(F.slice(lines, 1, PREVIEW_ROWS), "\n")
    return texts.select("file_id", F.size(lines).cast("bigint").alias("total_rows"), content.alias("content"))


def _quoted(cell: Column) -> Column:
    """JSON form of one string."""
    listed = F.to_json(F.array(cell))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _pretty(sample: Column) -> Column:
    """Rows of cells as JSON with an indent of two."""
    def row(cells: Column) -> Column:
        inner = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("    "), _quoted(c))), ",\n")
        return F.when(F.size(cells) == 0, F.lit("  []")).otherwise(F.concat(F.lit("  [\n"), inner, F.lit("\n  ]")))
    return F.concat(F.lit("[\n"), F.array_join(F.transform(sample, row), ",\n"), F.lit("\n]"))


def prompt_table(previews: DataFrame) -> DataFrame:
    """Prompt text per file; parts a file does not have are left out."""
    has = lambda c: c in previews.columns
    # Wording of the prompt.
    parts = [F.concat(F.lit("文件类型: "), F.col("file_type"))]
    if has("sheet_names"):
        parts.append(F.when(F.size("sheet_names") > 0, F.concat(F.lit("\nSheet名称: "), F.array_join("sheet_names", ", "))))
    parts.append(F.concat(F.lit("\n总行数: "), F.col("total_rows").cast("string")))
    parts.append(F.concat(F.lit("\n\n文件内容前20行:\n"), F.col("content")))
    if has("sample"):
        parts.append(F.when(F.size("sample") > 0, F.concat(F.lit("\n\n原始数据样本(JSON格式):\n"), _pretty(F.col("sample")))))
    parts.append(F.lit("\n\n请分析此文件的结构并生成解析规则。"))
    return previews.select("file_id", F.concat_ws("", *parts).alias("prompt"))


def _is_json(c: Column) -> Column:
    """Whether a text is one JSON value. Parsing alone would not see text after the value."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return listed.isNotNull() & named.isNotNull()


def recover_json(answers: DataFrame, text: str = "text") -> DataFrame:
    """JSON of an answer: the whole text, else its first fenced block, else first { to last }.

    Adds `json` (the text that parses) and `found_by`; both NULL when nothing parses.
    """
    t = F.col(text)
    tries = {
        "whole": t,
        "fence": trim(F.regexp_extract(t, translate(r"```(?:json)?\s*([\s\S]*?)```").java, 1)),
        "braces": F.regexp_extract(t, r"(?s)\{.*\}", 0),
    }
    found = F.coalesce(*[F.when(_is_json(c), F.lit(k)) for k, c in tries.items()])
    out = answers.withColumn("found_by", found)
    return out.withColumn("json", F.coalesce(*[F.when(F.col("found_by") == k, c) for k, c in tries.items()]))


def _get(v: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{field}", kind)


def _kind(v: Column) -> Column:
    return F.split(F.schema_of_variant(v), "<")[0]


def _is_block(v: Column) -> Column:
    return F.coalesce(_kind(v).isin("OBJECT", "ARRAY"), F.lit(False))


def normalize_rule(answers: DataFrame, json: str = "json") -> DataFrame:
    """Rule of an answer with only the known blocks, its name and source type always set.

    An answer holds the rule under "rule" or at the top. Adds `rule` (JSON), `source_type`,
    `confidence` and `explanation`.
    """
    raw = F.try_parse_json(F.col(json))
    step = answers.withColumn("_raw", raw).withColumn("_nested", _get(F.col("_raw"), "rule"))
    top = F.col("_raw")
    flat = _truthy(_get(top, "source")) | _truthy(_get(top, "fieldMapping")) | _truthy(_get(top, "dataRegion"))
    step = step.withColumn("_rule", F.when(_is_block(F.col("_nested")), F.col("_nested")).when(flat, top))
    rule = F.col("_rule")
    blocks = {}
    for b in BLOCKS:
        v = _get(rule, b)
        ok = F.coalesce(_kind(v) == "ARRAY", F.lit(False)) if b == "metadataExtraction" else _is_block(v)
        blocks[f"_{b}"] = F.when(ok, v)
    step = step.withColumns(blocks)
    # The first block that is there decides the mode when the rule does not say.
    inferred = (
        F.when(F.col("_matrixTranspose").isNotNull(), "matrix").when(F.col("_cardParsing").isNotNull(), "card")
        .when(F.col("_textParsing").isNotNull(), "text").otherwise("table")
    )
    source = F.coalesce("_source", F.parse_json(F.concat(F.lit('{"type":"'), inferred, F.lit('"}'))))
    name = F.coalesce(F.nullif(_get(rule, "name", "string"), F.lit("")), F.lit(DEFAULT_NAME))
    fields = [
        name.alias("name"), _get(rule, "description", "string").alias("description"),
        _get(rule, "fileType", "string").alias("fileType"), source.alias("source"),
        *[F.col(f"_{b}").alias(b) for b in BLOCKS[1:]],
    ]
    return step.withColumns({
        "rule": F.to_json(F.struct(*fields)),
        "source_type": F.try_variant_get(source, "$.type", "string"),
        "confidence": _get(top, "confidence", "map<string,double>"),
        "explanation": F.coalesce(_get(top, "explanation", "string"), F.lit("")),
    }).drop("_raw", "_nested", "_rule", *blocks)


def _truthy(v: Column) -> Column:
    kind = _kind(v)
    text = v.try_cast("string") if hasattr(v, "try_cast") else v.cast("string")
    falsy = kind.isin("VOID") | (kind.isin("STRING", "BOOLEAN", "BIGINT", "DOUBLE") & text.isin("", "false", "0"))
    return v.isNotNull() & ~F.coalesce(falsy, F.lit(True))


def confidence_band(scores: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row per field with its percent and band."""
    others = [c for c in scores.columns if c != confidence]
    c = F.col("score")
    return scores.select(*others, F.explode(confidence).alias("field", "score")).select(
        *others, "field", "score", F.floor(c * 100 + 0.5).cast("bigint").alias("percent"),
        F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low").alias("band"),
    )
