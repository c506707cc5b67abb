"""From a rule and raw files to records.

A rule is a JSON object. It is read once on the driver and turned into column expressions, filters
and joins; the files are only touched by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.functions.regex import translate
from consigna.operators import cards, cleanup, matrix, merge, metadata, splitting, textmode
from consigna.operators.extract import compile_mapping, mapped_values, project_record
from consigna.operators.rules_table import match_rule_by_filename
from consigna.operators.sheets import NO_SHEETS, NO_SHEETS_MULTI, Region, SheetChoice, profiled_rows, select_sheet, select_sheets_union, sheet_profile
from consigna.schema import BLOCK_ROWS, FIELDS, ORDER_KEYS, SEQ, TEXT_TOO_LONG
from consigna.session import shared_folder
from consigna.sources.store import CODEC
from consigna.sources.texts import NO_TEXT, gathered_texts

# Messages of rules that cannot run.
NO_SOURCE = "规则配置缺少 source 字段，无法确定解析模式。请重新生成或编辑规则。"
NO_RULE = "规则配置为空，请检查规则是否正确保存。"
NULL_START = "Engine error: Cannot read properties of null (reading 'test')"
ENDLESS_ITEMS = "Engine error: itemPattern matches empty text"

POSITION = ["file_id", *ORDER_KEYS]

#: Rules up to which each task writes its own file of each.
FEW_RULES = 16


@dataclass(frozen=True)
class Parsed:
    """Records and the errors of files; a file may have both."""

    records: DataFrame
    errors: DataFrame


def source_type(rule: dict) -> str | None:
    """Mode of a rule, from its source or from the first block that implies one."""
    if rule.get("source") is not None:
        return str(rule["source"].get("type"))
    for block, kind in (("matrixTranspose", "matrix"), ("cardParsing", "card"), ("textParsing", "text"),
                        ("fieldMapping", "table"), ("dataRegion", "table")):
        if rule.get(block) is not None:
            return kind
    return None


def _files(df: DataFrame) -> DataFrame:
    return df.select("file_id").distinct()


def _errors(files: DataFrame, message: str) -> DataFrame:
    return files.select("file_id", F.lit(message).alias("message"))


def _failed(df: DataFrame, message: str) -> Parsed:
    """No records, the same error for every file."""
    none = df.filter(F.lit(False)).select("file_id", F.lit(None).cast("int").alias("sheet_idx"), F.lit(None).cast("int").alias("row_idx"))
    return Parsed(none, _errors(_files(df), message))


def _with_fault(sheet: DataFrame, errors: DataFrame, message: str) -> Parsed:
    """A fault that shows once a sheet is read: such files have this error alone and no records."""
    hit = _files(sheet)
    return Parsed(
        _failed(sheet, message).records,
        errors.join(hit, "file_id", "left_anti").unionByName(_errors(hit, message)),
    )


def _table(sheet: DataFrame, errors: DataFrame, rule: dict) -> Parsed:
    region = Region.of(rule.get("dataRegion"))
    metas = rule.get("metadataExtraction") or []
    fault = metadata.region_fault(metas)
    if fault:
        return _with_fault(sheet, errors, fault)
    mapping = compile_mapping(rule.get("fieldMapping") or {})
    profile = sheet_profile(sheet, region, mapped_values(region.header, mapping), metadata.metadata_values(metas, region))
    if metas:
        profile = profile.withColumns(metadata.metadata_columns(metas)).drop(*[f"_meta_{i}" for i in range(len(metas))])
    rows = profiled_rows(sheet, region, profile)
    records = project_record(rows, mapping, [c for c in rows.columns if c.startswith("_found_")])
    return Parsed(metadata.metadata_fill(records), errors)


def _matrix(sheet: DataFrame, errors: DataFrame, rule: dict) -> Parsed:
    config = rule.get("matrixTranspose")
    if not config:
        return _with_errors(sheet, errors, "matrixTranspose config is required for matrix mode")
    mapping = compile_mapping(rule.get("fieldMapping") or {}, has_headers=False)
    region = Region.of(rule.get("dataRegion"))
    start, header = config.get("transposeStartCol"), config.get("transposeHeaderRow")
    if start is None or header is None:
        sheet, start, header = sheet.filter(F.lit(False)), 0, 1
    wanted = mapped_values(region.header, mapping) | {"_heads": (header - 1, matrix.heads_of(start))}
    rows = profiled_rows(sheet, region, sheet_profile(sheet, region, wanted))
    records = matrix.matrix_unpivot(
        rows, mapping, start, config["headerField"], config["valueField"], bool(config.get("skipEmptyValues")))
    return Parsed(records, errors)


def _with_errors(sheet: DataFrame, errors: DataFrame, message: str) -> Parsed:
    return Parsed(_failed(sheet, message).records, errors.unionByName(_errors(_files(sheet), message)))


def _card(sheet: DataFrame, errors: DataFrame, rule: dict, block_rows: int) -> Parsed:
    config = rule.get("cardParsing")
    if not config:
        return _with_errors(sheet, errors, "cardParsing config is required for card mode")
    start = translate(config.get("cardStartPattern") or "")
    if start is None:
        return _with_fault(sheet.filter(F.col("row_idx").isNotNull()), errors, NULL_START)
    end = translate(config["cardEndPattern"]) if config.get("cardEndPattern") else None
    patterns = {f: translate(p) for f, p in (config.get("metadataPatterns") or {}).items()}
    patterns = {f: rx for f, rx in patterns.items() if rx}
    inner = config.get("innerTableConfig")
    segments = cards.card_segment(cards.with_card_values(sheet, patterns) if inner is None else sheet, start, end, block_rows)
    meta = cards.card_metadata(segments, patterns)
    if inner is None:
        return Parsed(cards.card_record(meta), errors)
    header = inner.get("headerOffset") or 0
    records = cards.card_inner_table(
        segments, meta, compile_mapping(inner.get("fieldMapping") or {}), header, inner.get("dataStartOffset"))
    return Parsed(records, errors)


def _text(pages: DataFrame, rule: dict) -> Parsed:
    config = rule.get("textParsing")
    if not config:
        return _failed(pages, "textParsing config is required for text mode")
    texts, errors = gathered_texts(pages)
    errors = errors.withColumnRenamed("error", "message")
    pattern = config["recordSeparator"]
    separator = translate(pattern)
    if separator is None:
        message = f"Invalid recordSeparator regex: {pattern}"
        return Parsed(_failed(texts, message).records, errors.unionByName(_errors(texts, message)))
    fields = {f: translate(p) for f, p in (config.get("fieldPatterns") or {}).items()}
    parts = textmode.text_fields(textmode.text_split_records(texts, separator), fields)
    item = translate(config["itemPattern"]) if config.get("itemPattern") else None
    names = config.get("itemFields") or []
    if names and item is not None:
        if item.matches_empty:
            return Parsed(_failed(texts, ENDLESS_ITEMS).records, errors.unionByName(_errors(texts, ENDLESS_ITEMS)))
        parts = textmode.text_items(parts, item, names)
    return Parsed(
        parts.drop("text").withColumns({"sheet_idx": F.lit(None).cast("int"), "row_idx": F.lit(None).cast("int")}), errors)


def _unknown(kind: str | None) -> str:
    return f"Unknown source type: {'undefined' if kind == 'None' else kind}"


def _extract(rows: DataFrame, pages: DataFrame | None, rule: dict, block_rows: int) -> Parsed:
    kind = source_type(rule)
    given = rows if kind != "text" or pages is None else pages
    if kind is None:
        return _failed(given, NO_SOURCE)
    if kind == "text":
        return _text(pages, rule) if pages is not None else _failed(rows, NO_TEXT)
    if kind not in ("table", "matrix", "card", "multi-sheet"):
        return _failed(given, _unknown(kind))
    choice = SheetChoice.of((rule.get("source") or {}).get("sheetConfig"))
    if kind == "multi-sheet":
        return _table(*select_sheets_union(rows, choice), rule)
    sheet, errors = select_sheet(rows, choice)
    if kind == "table":
        return _table(sheet, errors, rule)
    return _matrix(sheet, errors, rule) if kind == "matrix" else _card(sheet, errors, rule, block_rows)


def _record_fields(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c not in POSITION]


def _positioned(records: DataFrame) -> DataFrame:
    missing = {c: F.lit(0) for c in SEQ if c not in records.columns}
    return records.withColumns(missing)


def _aggregate(records: DataFrame, config: dict, trim_ends: bool, block_rows: int) -> DataFrame:
    key = config["groupBy"]
    if key not in records.columns:
        records = records.withColumn(key, F.lit(None).cast("string"))
    block = [
        F.coalesce("sheet_idx", F.lit(0)),
        F.floor(F.coalesce("row_idx", F.lit(0)) / block_rows), F.floor(F.col("text_part") / block_rows),
    ]
    return merge.merge_groups(
        records, key, config.get("sharedFields") or [], _record_fields(records), ORDER_KEYS, block, ["file_id"], trim_ends)


def _post_process(records: DataFrame, config: dict) -> DataFrame:
    if config.get("trimWhitespace"):
        records = cleanup.trim_fields(records, _record_fields(records))
    if config.get("defaultValues"):
        records = cleanup.fill_defaults(records, config["defaultValues"])
    if config.get("staticValues"):
        records = cleanup.override_static(records, config["staticValues"])
    return cleanup.drop_empty(records) if config.get("removeEmptyRows") else records


def _canonical(records: DataFrame) -> DataFrame:
    others = [f for f in _record_fields(records) if f not in FIELDS]
    if others:
        pairs = F.create_map(*[x for f in others for x in (F.lit(f), F.col(f))])
        extra = F.map_filter(pairs, lambda _, v: v.isNotNull())
    else:
        extra = F.lit(None).cast("map<string,string>")
    return records.select(
        *POSITION,
        *[F.col(f) if f in records.columns else F.lit(None).cast("string").alias(f) for f in FIELDS],
        extra.alias("extra"),
    )


def _absent(files: DataFrame, rows: DataFrame, pages: DataFrame | None, rule: dict) -> DataFrame:
    """Errors of the files that have nothing the rule reads: no row at all, or no page for a text rule."""
    kind = source_type(rule)
    given = rows if kind != "text" or pages is None else pages
    message = {None: NO_SOURCE, "text": NO_TEXT, "multi-sheet": NO_SHEETS_MULTI, "table": NO_SHEETS, "matrix": NO_SHEETS, "card": NO_SHEETS}.get(
        kind, _unknown(kind))
    return _errors(_files(files).join(_files(given), "file_id", "left_anti"), message)


def parse(
    rows: DataFrame, pages: DataFrame | None, rule: dict | None,
    block_rows: int = BLOCK_ROWS, files: DataFrame | None = None,
) -> Parsed:
    """Apply one rule to all given files: extract, split cells, aggregate, clean up.

    `files` lists the files there should be; one without anything to read has an error too.
    """
    if rule is None:
        failed = _failed(rows if files is None else files, NO_RULE)
        return Parsed(_canonical(_positioned(failed.records)), failed.errors)
    got = _extract(rows, pages, rule, block_rows)
    if files is not None:
        got = Parsed(got.records, got.errors.unionByName(_absent(files, rows, pages, rule)))
    records = got.records
    split = rule.get("cellSplitting")
    if split:
        extract = translate(split["extractPattern"]) if split.get("extractPattern") else None
        records = splitting.cell_split(
            records, split["targetField"], translate(split["splitPattern"]), extract, split.get("extractFields") or [])
    records = _positioned(records)
    post = rule.get("postProcessing") or {}
    errors = got.errors
    if rule.get("aggregation"):
        records = _aggregate(records, rule["aggregation"], bool(post.get("trimWhitespace")), block_rows)
        # A file with a merged text that cannot be one value has this error; its other records stay.
        errors = errors.unionByName(_errors(_files(records.filter("too_long")), TEXT_TOO_LONG))
        records = records.filter("NOT too_long").drop("too_long")
    return Parsed(_canonical(_post_process(records, post)), errors)


def _by_rule(df: DataFrame, routed: DataFrame, name: str, rules: int) -> DataFrame:
    """Rows or pages with the rule of their file, written once with the rule as partition.

    With few rules each task of the join writes its own file for each; with more, rows are shuffled by rule first.
    """
    folder = shared_folder(df.sparkSession, name)
    owned = df.join(routed.filter(F.col("rule_id").isNotNull()).select("file_id", "rule_id"), "file_id")
    (owned if rules <= FEW_RULES else owned.hint("rebalance", "rule_id")).write.partitionBy("rule_id").option("compression", CODEC).parquet(folder)
    return df.sparkSession.read.schema(owned.schema).parquet(folder)


def parse_files(files: DataFrame, rows: DataFrame, pages: DataFrame, rules: list[dict]) -> Parsed:
    """Route each file to its first matching rule by name and parse it; others get no records.

    `files` has file_id and file_name. Rows and pages are read and written once; each rule then
    reads the partition of its own files and nothing else.
    """
    routed = match_rule_by_filename(files, rules)
    rows, pages = _by_rule(rows, routed, "rows-by-rule", len(rules)), _by_rule(pages, routed, "pages-by-rule", len(rules))
    done = []
    for rule in rules:
        mine = F.col("rule_id") == rule["id"]
        own = routed.filter(mine).select("file_id")
        done.append(parse(rows.filter(mine).drop("rule_id"), pages.filter(mine).drop("rule_id"), rule, files=own))
    unmatched = _errors(routed.filter(F.col("rule_id").isNull()), "未找到匹配的预设规则")
    return Parsed(
        reduce(DataFrame.unionByName, [p.records for p in done]),
        reduce(DataFrame.unionByName, [p.errors for p in done], unmatched),
    )
