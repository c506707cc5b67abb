"""Sheet operators over documents: lines are rows, words are cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.registry import ROWS, SHEETS, Tables, query, sql_blank, sql_trim, with_
from consigna.functions.regex import translate
from consigna.operators import cards, extract, matrix, metadata, sheets, splitting, summary
from consigna.operators.extract import compile_mapping
from consigna.operators.rules_table import match_rule_by_filename
from consigna.operators.sheets import Region, SheetChoice
from consigna.plans.parse import parse, parse_files
from consigna.schema import FIELDS
from consigna.sources import grid

ROW = ["file_id", "sheet_idx", "row_idx"]
AT = ", ".join(ROW)


def none_to_empty(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.coalesce(n, F.lit("")) for n in names})


# --- sources -------------------------------------------------------------------------------------

@query("grid_from_json", """SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS file_id, CAST(0 AS INT) AS sheet_idx, lang AS sheet_name,
  CAST(i - 1 AS INT) AS row_idx, replace(line, ' ', '|') AS line
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def grid_from_json(t: Tables) -> DataFrame:
    data = F.transform(F.split("text", "\n", -1), lambda line: F.split(line, " ", -1))
    sheet = F.struct(F.col("lang").alias("name"), data.alias("data"))
    docs = t.read("documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"),
        F.to_json(F.struct(F.lit("excel").alias("type"), F.array(sheet).alias("sheets"))).alias("body"))
    return grid.grid_from_json(docs).select("file_id", "sheet_idx", "sheet_name", "row_idx", F.array_join("cells", "|", "").alias("line"))


@query("grid_from_lines", with_(ROWS) + f"""SELECT {AT}, sheet_name,
  array_to_string(list_transform(cells, lambda c: CASE WHEN {sql_blank('c')} THEN '-' ELSE c END), '|') AS line FROM raw""")
def grid_from_lines(t: Tables) -> DataFrame:
    rows = grid.grid_from_lines(t.sheets(), "text", " ", sheet=None)
    return rows.select(*ROW, "sheet_name", F.array_join("cells", "|", "-").alias("line"))


# --- sheets and regions --------------------------------------------------------------------------

@query("select_sheet", with_(ROWS) + f"""SELECT {AT}, sheet_name, line FROM raw
JOIN (SELECT file_id AS f, min(sheet_idx) AS s FROM sheets WHERE regexp_matches(sheet_name, '^fr') GROUP BY 1) ON f = file_id AND s = sheet_idx""")
def select_sheet(t: Tables) -> DataFrame:
    rows, _ = sheets.select_sheet(t.rows(), SheetChoice(pattern="^fr"))
    return rows.select(*ROW, "sheet_name", F.array_join("cells", " ").alias("line"))


@query("select_sheet_errors", with_(SHEETS) + """SELECT file_id, 'No sheet matches pattern: ^fr' AS message FROM sheets
GROUP BY file_id HAVING count(*) FILTER (regexp_matches(sheet_name, '^fr')) = 0
UNION ALL SELECT file_id, 'Sheet index 7 out of range' FROM sheets GROUP BY file_id HAVING max(sheet_idx) < 7""")
def select_sheet_errors(t: Tables) -> DataFrame:
    by_name = sheets.select_sheet(t.rows(), SheetChoice(pattern="^fr"))[1]
    return by_name.unionByName(sheets.select_sheet(t.rows(), SheetChoice(index=7))[1])


@query("select_sheets_union", with_(ROWS) + f"""SELECT 'row' AS kind, {AT}, line AS text FROM raw WHERE regexp_matches(sheet_name, '^(fr|de)')
UNION ALL SELECT 'error', file_id, -1, -1, 'No sheet matches pattern: ^(fr|de)' FROM sheets WHERE NOT regexp_matches(sheet_name, '^(fr|de)')""")
def select_sheets_union(t: Tables) -> DataFrame:
    rows, errors = sheets.select_sheets_union(t.rows(), SheetChoice(pattern="^(fr|de)", all_sheets=True))
    return rows.select(F.lit("row").alias("kind"), *ROW, F.array_join("cells", " ").alias("text")).unionByName(
        errors.select(F.lit("error").alias("kind"), "file_id", F.lit(-1).alias("sheet_idx"), F.lit(-1).alias("row_idx"),
                      F.col("message").alias("text")))


HEADS = f"heads AS (SELECT file_id, sheet_idx, list_transform(cells, lambda c: {sql_trim('c')}) AS h FROM raw WHERE row_idx = 0)"


def sql_resolve(name: str) -> str:
    low = "list_transform(h, lambda x: lower(x))"
    return (f"(coalesce(nullif(list_position({low}, '{name}'), 0), "
            f"nullif(list_position(list_transform(h, lambda x: contains(lower(x), '{name}')), true), 0)) - 1)")


@query("build_headers", with_(ROWS, HEADS) + "SELECT file_id, sheet_idx, array_to_string(h, '|') AS headers FROM heads")
def build_headers(t: Tables) -> DataFrame:
    return sheets.build_headers(t.rows(), 0).select("file_id", "sheet_idx", F.array_join("headers", "|").alias("headers"))


NAMES = ["the", "DER", "an", "", "no such name"]


@query("resolve_column", with_(ROWS, HEADS) + "SELECT file_id, sheet_idx, " + ", ".join(
    f"CAST(coalesce({sql_resolve(n.lower())}, -1) AS INT) AS col_{i}" for i, n in enumerate(NAMES)) + " FROM heads")
def resolve_column(t: Tables) -> DataFrame:
    found = sheets.resolve_column(sheets.build_headers(t.rows(), 0), NAMES)
    return found.select("file_id", "sheet_idx", *[F.coalesce(f"col_{i}", F.lit(-1)).alias(f"col_{i}") for i in range(len(NAMES))])


ENDS = f"ends AS (SELECT file_id AS ef, sheet_idx AS es, max(row_idx) + 1 AS data_end FROM raw WHERE NOT {sql_blank('line')} GROUP BY 1, 2)"


@query("auto_data_end", with_(ROWS, ENDS) + "SELECT ef AS file_id, es AS sheet_idx, CAST(data_end AS INT) AS data_end FROM ends")
def auto_data_end(t: Tables) -> DataFrame:
    return sheets.auto_data_end(t.rows())


REGION = Region(header=0, start=1, skip_rows=(3,), skip_patterns=("http", "^[A-Z][a-z]+ [0-9]"))
DATA = """data AS (SELECT raw.* FROM raw JOIN ends ON ef = file_id AND es = sheet_idx WHERE row_idx >= 1 AND row_idx < data_end
  AND row_idx <> 2 AND NOT regexp_matches(line, 'http') AND NOT regexp_matches(line, '^[A-Z][a-z]+ [0-9]'))"""


@query("region_rows", with_(ROWS, ENDS, DATA) + f"SELECT {AT}, line FROM data")
def region_rows(t: Tables) -> DataFrame:
    return sheets.region_rows(t.rows(), REGION).select(*ROW, F.array_join("cells", " ").alias("line"))


@query("row_text_match", with_(ROWS) + f"SELECT {AT}, CAST(regexp_matches(line, '[0-9][0-9]+ [a-z]') AS INT) AS matched FROM raw")
def row_text_match(t: Tables) -> DataFrame:
    return t.rows().select(*ROW, sheets.row_text_match(r"\d\d+ [a-z]").cast("int").alias("matched"))


# --- extractors ----------------------------------------------------------------------------------

@query("col_by_index", with_(ROWS) + f"SELECT {AT}, coalesce(cells[1], '') AS first, coalesce(cells[6], '') AS sixth FROM raw")
def col_by_index(t: Tables) -> DataFrame:
    return t.rows().select(*ROW, extract.col_by_index(0).alias("first"), extract.col_by_index(5).alias("sixth"))


@query("col_by_name", with_(ROWS, HEADS) + f"""SELECT r.file_id, r.sheet_idx, row_idx, coalesce(cells[{sql_resolve('the')} + 1], '') AS value
FROM raw r LEFT JOIN heads h ON h.file_id = r.file_id AND h.sheet_idx = r.sheet_idx""")
def col_by_name(t: Tables) -> DataFrame:
    rows = t.rows()
    found = sheets.resolve_column(sheets.build_headers(rows, 0), ["the"])
    return rows.join(found, ["file_id", "sheet_idx"], "left").select(*ROW, extract.col_by_name("col_0").alias("value"))


@query("cell_at", with_(ROWS) + """SELECT file_id, sheet_idx, coalesce(max(cells[2]) FILTER (row_idx = 0), '') AS b1,
  coalesce(max(cells[1]) FILTER (row_idx = 4), '') AS a5, '' AS aa, '' AS bad FROM raw GROUP BY 1, 2""")
def cell_at(t: Tables) -> DataFrame:
    return extract.cell_at(t.rows(), {"b1": "B1", "a5": "a5", "aa": "AA0", "bad": "1B"})


@query("regex_on_row", with_(ROWS) + f"""SELECT {AT}, regexp_extract(line, '([a-z]+)@([a-z.]+)', 2) AS host,
  regexp_extract(line, '[0-9]+', 0) AS number, regexp_extract(line, '([A-Z])([a-z]+)', 0) AS word FROM raw""")
def regex_on_row(t: Tables) -> DataFrame:
    return t.rows().select(
        *ROW, extract.regex_on_row("([a-z]+)@([a-z.]+)", 2).alias("host"), extract.regex_on_row(r"\d+").alias("number"),
        extract.regex_on_row("([A-Z])([a-z]+)", 5).alias("word"))


@query("static_value", with_(ROWS) + f"SELECT {AT}, 'depot' AS value, '' AS missing FROM raw")
def static_value(t: Tables) -> DataFrame:
    return t.rows().select(*ROW, extract.static_value("depot").alias("value"), extract.static_value(None).alias("missing"))


@query("formula", with_(ROWS) + f"SELECT {AT}, '' AS value FROM raw")
def formula(t: Tables) -> DataFrame:
    return t.rows().select(*ROW, extract.formula().alias("value"))


MAPPING = {
    "skuCode": {"type": "column", "column": 0},
    "skuName": {"type": "column", "column": "the"},
    "skuSpec": {"type": "cell", "cell": "B2"},
    "remark": {"type": "regex", "regex": r"([A-Z][a-z]+)\."},
    "storeName": {"type": "static", "staticValue": "depot"},
    "receiverName": {"type": "formula", "formula": "x"},
    "receiverPhone": {"type": "column", "column": 99},
    "receiverAddress": None,
}
MAPPED = f"""mapped AS (SELECT d.file_id, d.sheet_idx, d.row_idx + 1 AS row_idx, coalesce(d.cells[1], '') AS skuCode,
  coalesce(d.cells[{sql_resolve('the')} + 1], '') AS skuName, coalesce(b2.cells[2], '') AS skuSpec,
  regexp_extract(d.line, '([A-Z][a-z]+)\\.', 1) AS remark, 'depot' AS storeName, '' AS receiverName, coalesce(d.cells[100], '') AS receiverPhone
FROM data d LEFT JOIN heads h ON h.file_id = d.file_id AND h.sheet_idx = d.sheet_idx
LEFT JOIN raw b2 ON b2.file_id = d.file_id AND b2.sheet_idx = d.sheet_idx AND b2.row_idx = 1)"""
MAPPED_FIELDS = "skuCode, skuName, skuSpec, remark, storeName, receiverName, receiverPhone"


@query("project_record", with_(ROWS, HEADS, ENDS, DATA, MAPPED) + f"SELECT {AT}, {MAPPED_FIELDS} FROM mapped")
def project_record(t: Tables) -> DataFrame:
    return _project(t.rows())


def _project(rows: DataFrame) -> DataFrame:
    mapping = compile_mapping(MAPPING)
    values = extract.sheet_values(rows, REGION.header, mapping)
    return extract.project_record(sheets.region_rows(rows, REGION, [values]), mapping)


# --- metadata ------------------------------------------------------------------------------------

METAS = [
    {"targetField": "remark", "searchArea": "header", "regex": "([A-Z][a-z]+) "},
    {"targetField": "externalCode", "searchArea": "footer", "searchPattern": "[0-9][0-9]", "regex": "([0-9]+)"},
    {"targetField": "receiverName", "searchArea": "specific-row", "row": 2, "column": 1},
    {"targetField": "remark", "searchArea": "all", "searchPattern": "http", "regex": "https?://([a-z.]+)"},
]
LOOKUP = f"""meta AS (SELECT file_id, sheet_idx,
  arg_min(regexp_extract(line, '([A-Z][a-z]+) ', 1), row_idx) FILTER (row_idx = 0 AND regexp_extract(line, '([A-Z][a-z]+) ', 1) <> '') AS m0,
  arg_min(regexp_extract(line, '[0-9]+'), row_idx) FILTER (row_idx >= 1 AND regexp_matches(line, '[0-9][0-9]')) AS m1,
  min({sql_trim('cells[2]')}) FILTER (row_idx = 1 AND NOT {sql_blank('cells[2]')}) AS m2,
  arg_min(regexp_extract(line, 'https?://([a-z.]+)', 1), row_idx) FILTER (regexp_extract(line, 'https?://([a-z.]+)', 1) <> '') AS m3
FROM raw GROUP BY 1, 2)"""


@query("metadata_lookup", with_(ROWS, LOOKUP) + """SELECT file_id, sheet_idx, coalesce(m0, '') AS m0, coalesce(m1, '') AS m1,
  coalesce(m2, '') AS m2, coalesce(m3, '') AS m3 FROM meta WHERE coalesce(m0, m1, m2, m3) IS NOT NULL""")
def metadata_lookup(t: Tables) -> DataFrame:
    found = metadata.metadata_lookup(t.rows(), METAS, REGION)
    return found.select("file_id", "sheet_idx", *[F.coalesce(f"_meta_{i}", F.lit("")).alias(f"m{i}") for i in range(4)])


@query("metadata_merge", with_(ROWS, LOOKUP) + """SELECT file_id, sheet_idx, coalesce(m3, m0, '') AS remark, coalesce(m1, '') AS externalCode,
  coalesce(m2, '') AS receiverName FROM meta WHERE coalesce(m0, m1, m2, m3) IS NOT NULL""")
def metadata_merge(t: Tables) -> DataFrame:
    merged = metadata.metadata_merge(metadata.metadata_lookup(t.rows(), METAS, REGION), METAS)
    return merged.select("file_id", "sheet_idx", *[
        F.coalesce(f"_found_{f}", F.lit("")).alias(f) for f in ("remark", "externalCode", "receiverName")])


FILLED = """filled AS (SELECT m.file_id, m.sheet_idx, row_idx, skuCode, skuName, skuSpec, coalesce(nullif(remark, ''), m3, m0, '') AS remark,
  storeName, coalesce(m2, '') AS receiverName, receiverPhone, coalesce(m1, '') AS externalCode
FROM mapped m LEFT JOIN meta t ON t.file_id = m.file_id AND t.sheet_idx = m.sheet_idx)"""


@query("metadata_fill", with_(ROWS, HEADS, ENDS, DATA, MAPPED, LOOKUP, FILLED) + f"SELECT {AT}, {MAPPED_FIELDS}, externalCode FROM filled")
def metadata_fill(t: Tables) -> DataFrame:
    rows = t.rows()
    records = _project(rows)
    merged = metadata.metadata_merge(metadata.metadata_lookup(rows, METAS, REGION), METAS)
    return none_to_empty(metadata.metadata_fill(records, merged), "externalCode", "receiverName", "remark")


# --- matrix, cards, compound cells ---------------------------------------------------------------

PAIRS = f"""pairs AS (SELECT d.file_id, d.sheet_idx, d.row_idx + 1 AS row_idx, i - 2 AS matrix_col, coalesce(d.cells[1], '') AS storeName,
  h[i] AS remark, coalesce(d.cells[i], '') AS skuName
FROM data d JOIN (SELECT file_id, sheet_idx, h, unnest(range(2, len(h) + 1)) AS i FROM heads) x
  ON x.file_id = d.file_id AND x.sheet_idx = d.sheet_idx WHERE NOT {sql_blank('d.cells[i]')})"""


@query("matrix_unpivot", with_(ROWS, HEADS, ENDS, DATA, PAIRS) + f"SELECT {AT}, CAST(matrix_col AS INT) AS matrix_col, storeName, remark, skuName FROM pairs")
def matrix_unpivot(t: Tables) -> DataFrame:
    rows = t.rows()
    mapping = compile_mapping({"storeName": {"type": "column", "column": 0}}, has_headers=False)
    data = sheets.region_rows(rows, REGION, [matrix.matrix_heads(rows, 1, 0)])
    return matrix.matrix_unpivot(data, mapping, 1, "remark", "skuName", skip_empty=True)


START, END = "^(The|Of|Le|Der|El|In)", "(en|er|on)[.]$"
CARDS = f"""marked AS (SELECT *, regexp_matches(line, '{START}') AS s FROM raw),
counted AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY file_id, sheet_idx ORDER BY row_idx) AS card FROM marked),
bounds AS (SELECT file_id AS bf, sheet_idx AS bs, card AS bc, min(row_idx) AS card_start,
    coalesce(min(row_idx) FILTER (NOT s AND regexp_matches(line, '{END}')), 1000000000) AS card_end FROM counted WHERE card > 0 GROUP BY 1, 2, 3),
cards AS (SELECT counted.*, card_start, row_idx - card_start AS off FROM counted
  JOIN bounds ON bf = file_id AND bs = sheet_idx AND bc = card WHERE row_idx <= card_end)"""


def _cards(t: Tables) -> DataFrame:
    return cards.card_segment(t.rows(), translate(START), translate(END))


@query("card_segment", with_(ROWS, CARDS) + f"SELECT {AT}, card_start, CAST(off AS INT) AS card_off FROM cards")
def card_segment(t: Tables) -> DataFrame:
    return _cards(t).select(*ROW, "card_start", "card_off")


CARD_FIELDS = {"remark": "([0-9]+)", "storeName": "^([A-Z][a-z]+) "}
CARD_META = """card_meta AS (SELECT file_id, sheet_idx, card_start,
  arg_min(regexp_extract(line, '[0-9]+'), row_idx) FILTER (regexp_extract(line, '[0-9]+') <> '') AS remark,
  arg_min(regexp_extract(line, '^([A-Z][a-z]+) ', 1), row_idx) FILTER (regexp_extract(line, '^([A-Z][a-z]+) ', 1) <> '') AS storeName
FROM cards GROUP BY 1, 2, 3)"""


def _card_meta(segments: DataFrame) -> DataFrame:
    return cards.card_metadata(segments, {f: translate(p) for f, p in CARD_FIELDS.items()})


@query("card_metadata", with_(ROWS, CARDS, CARD_META) + """SELECT file_id, sheet_idx, card_start, coalesce(remark, '') AS remark,
  coalesce(storeName, '') AS storeName FROM card_meta""")
def card_metadata(t: Tables) -> DataFrame:
    return none_to_empty(_card_meta(_cards(t)), "remark", "storeName")


@query("card_record", with_(ROWS, CARDS, CARD_META) + """SELECT file_id, sheet_idx, CAST(card_start + 1 AS INT) AS row_idx,
  coalesce(remark, '') AS remark, coalesce(storeName, '') AS storeName FROM card_meta""")
def card_record(t: Tables) -> DataFrame:
    return none_to_empty(cards.card_record(_card_meta(_cards(t))), "remark", "storeName")


INNER = {
    "skuCode": {"type": "column", "column": 0}, "skuName": {"type": "column", "column": "the"},
    "skuSpec": {"type": "cell", "cell": "B3"}, "remark": {"type": "column", "column": "no such name"},
}


@query("card_inner_table", with_(ROWS, CARDS, CARD_META) + f"""SELECT c.file_id, c.sheet_idx, CAST(c.row_idx + 1 AS INT) AS row_idx,
  coalesce(storeName, '') AS storeName, coalesce(c.cells[1], '') AS skuCode, coalesce(c.cells[{sql_resolve('the')} + 1], '') AS skuName,
  coalesce(b.cells[2], '') AS skuSpec, '' AS remark
FROM cards c JOIN card_meta m ON m.file_id = c.file_id AND m.sheet_idx = c.sheet_idx AND m.card_start = c.card_start
LEFT JOIN (SELECT file_id, sheet_idx, card_start, list_transform(cells, lambda x: {sql_trim('x')}) AS h FROM cards WHERE off = 1) h
  ON h.file_id = c.file_id AND h.sheet_idx = c.sheet_idx AND h.card_start = c.card_start
LEFT JOIN (SELECT file_id, sheet_idx, card_start, cells FROM cards WHERE off = 2) b
  ON b.file_id = c.file_id AND b.sheet_idx = c.sheet_idx AND b.card_start = c.card_start
WHERE c.off >= 2 AND NOT {sql_blank('c.line')}""")
def card_inner_table(t: Tables) -> DataFrame:
    segments = _cards(t)
    out = cards.card_inner_table(segments, _card_meta(segments), compile_mapping(INNER), 1, 2)
    return none_to_empty(out, "storeName")


SPLIT = f"""parts AS (SELECT file_id, sheet_idx, row_idx, line, string_split_regex(line, '[|;] ?') AS p FROM raw),
pieces AS (SELECT *, list_filter(list_transform(p, lambda x: {sql_trim('x')}), lambda x: x <> '') AS q FROM parts),
exploded AS (SELECT {AT}, line, CAST(NULL AS VARCHAR) AS piece, 0 AS split FROM pieces WHERE line = '' OR len(p) <= 1
  UNION ALL SELECT {AT}, line, unnest(q), unnest(range(0, len(q))) FROM pieces WHERE line <> '' AND len(p) > 1)"""


@query("cell_split", with_(ROWS, SPLIT) + f"""SELECT {AT}, CAST(split AS INT) AS split,
  CASE WHEN piece IS NULL THEN line WHEN regexp_matches(piece, '^([A-Za-z]+) ([a-z]+)') THEN regexp_extract(piece, '^([A-Za-z]+) ([a-z]+)', 1) ELSE piece END AS skuName,
  CASE WHEN regexp_matches(piece, '^([A-Za-z]+) ([a-z]+)') THEN regexp_extract(piece, '^([A-Za-z]+) ([a-z]+)', 2) ELSE '' END AS skuSpec FROM exploded""")
def cell_split(t: Tables) -> DataFrame:
    records = t.rows().select(*ROW, F.array_join("cells", " ").alias("skuName"), F.lit("").alias("skuSpec"))
    out = splitting.cell_split(
        records, "skuName", translate("[|;] ?"), translate("^([A-Za-z]+) ([a-z]+)"), ["skuName", "skuSpec"])
    return out


# --- whole rules ---------------------------------------------------------------------------------

REGION_JSON = {"headerRow": 1, "dataStartRow": 2, "dataEndRow": "auto", "skipRows": [3], "skipPatterns": list(REGION.skip_patterns)}
CLEAN = {"trimWhitespace": True, "removeEmptyRows": True}
TABLE_RULE = {
    "source": {"type": "table", "sheetConfig": {"sheetNamePattern": "^fr"}}, "dataRegion": REGION_JSON, "fieldMapping": MAPPING,
    "metadataExtraction": METAS, "postProcessing": {**CLEAN, "defaultValues": {"remark": "none"}, "staticValues": {"skuQuantity": "1"}},
}
FIRST_FR = "(SELECT file_id AS f, min(sheet_idx) AS s FROM sheets WHERE regexp_matches(sheet_name, '^fr') GROUP BY 1)"
TABLE_OUT = ", ".join([f"{sql_trim(f)} AS {f}" for f in ("externalCode", "storeName", "receiverName", "receiverPhone", "skuCode", "skuName", "skuSpec")]
                      + ["'' AS receiverAddress", "'1' AS skuQuantity", f"coalesce(nullif({sql_trim('remark')}, ''), 'none') AS remark"])


def _fields(df: DataFrame, *more: str) -> DataFrame:
    return none_to_empty(df, *FIELDS).select(*ROW, *more, *FIELDS)


@query("parse_table", with_(ROWS, HEADS, ENDS, DATA, MAPPED, LOOKUP, FILLED) + f"""SELECT file_id, sheet_idx, CAST(row_idx AS INT) AS row_idx, {TABLE_OUT}
FROM filled JOIN {FIRST_FR} ON f = file_id AND s = sheet_idx""")
def parse_table(t: Tables) -> DataFrame:
    return _fields(parse(t.rows(), None, TABLE_RULE).records)


@query("parse_multi_sheet", with_(ROWS, HEADS, ENDS, DATA, MAPPED, LOOKUP, FILLED) + f"""SELECT file_id, sheet_idx, CAST(row_idx AS INT) AS row_idx, {TABLE_OUT} FROM filled""")
def parse_multi_sheet(t: Tables) -> DataFrame:
    rule = {**TABLE_RULE, "source": {"type": "multi-sheet", "sheetConfig": {"allSheets": True}}}
    return _fields(parse(t.rows(), None, rule).records)


SINGLE = "concat(file_id, '/', CAST(sheet_idx AS VARCHAR)) AS file_id, CAST(0 AS INT) AS sheet_idx"
MATRIX_RULE = {
    "source": {"type": "matrix", "sheetConfig": {"sheetIndex": 0}}, "dataRegion": REGION_JSON,
    "matrixTranspose": {"transposeStartCol": 1, "transposeHeaderRow": 1, "headerField": "remark", "valueField": "skuName", "skipEmptyValues": True},
    "fieldMapping": {"storeName": {"type": "column", "column": 0}},
    "cellSplitting": {"targetField": "skuName", "splitPattern": "th", "extractPattern": "^([a-z])([a-z]+)$", "extractFields": ["skuCode", "skuName"]},
    "postProcessing": CLEAN,
}


@query("parse_matrix", with_(ROWS, HEADS, ENDS, DATA, PAIRS, f"""cut AS (SELECT *, string_split_regex(skuName, 'th') AS p FROM pairs),
pieces AS (SELECT *, list_filter(list_transform(p, lambda x: {sql_trim('x')}), lambda x: x <> '') AS q FROM cut),
exploded AS (SELECT file_id, sheet_idx, row_idx, matrix_col, storeName, remark, skuName, CAST(NULL AS VARCHAR) AS piece, 0 AS split FROM pieces WHERE len(p) <= 1
  UNION ALL SELECT file_id, sheet_idx, row_idx, matrix_col, storeName, remark, skuName, unnest(q), unnest(range(0, len(q))) FROM pieces WHERE len(p) > 1)""")
    + f"""SELECT {SINGLE}, CAST(row_idx AS INT) AS row_idx, CAST(matrix_col AS INT) AS matrix_col, CAST(split AS INT) AS split,
  {sql_trim('storeName')} AS storeName, {sql_trim('remark')} AS remark,
  CASE WHEN piece IS NULL THEN '' WHEN regexp_matches(piece, '^([a-z])([a-z]+)$') THEN regexp_extract(piece, '^([a-z])([a-z]+)$', 1) ELSE piece END AS skuCode,
  CASE WHEN piece IS NULL THEN {sql_trim('skuName')} WHEN regexp_matches(piece, '^([a-z])([a-z]+)$') THEN regexp_extract(piece, '^([a-z])([a-z]+)$', 2)
    ELSE {sql_trim('skuName')} END AS skuName, '' AS externalCode, '' AS receiverName, '' AS receiverPhone, '' AS receiverAddress, '' AS skuQuantity, '' AS skuSpec
FROM exploded""")
def parse_matrix(t: Tables) -> DataFrame:
    return _fields(parse(t.single_sheets(), None, MATRIX_RULE).records, "matrix_col", "split")


CARD_RULE = {
    "source": {"type": "card"},
    "cardParsing": {"cardStartPattern": START, "cardEndPattern": END, "metadataPatterns": CARD_FIELDS},
    "aggregation": {"groupBy": "storeName", "sharedFields": []},
}


@query("parse_card", with_(ROWS, CARDS, CARD_META) + f"""SELECT {SINGLE}, CAST(min(card_start) + 1 AS INT) AS row_idx,
  coalesce(storeName, '') AS storeName, list_reduce(list(coalesce(remark, '') ORDER BY card_start), lambda acc, x: CASE WHEN x = '' OR x = acc THEN acc
      WHEN acc = '' THEN x ELSE concat(acc, ',', x) END, '') AS remark
FROM card_meta GROUP BY file_id, sheet_idx, coalesce(storeName, '')""")
def parse_card(t: Tables) -> DataFrame:
    got = parse(t.single_sheets(), None, CARD_RULE).records
    return none_to_empty(got, "storeName", "remark").select(*ROW, "storeName", "remark")


SUITE = [
    {**TABLE_RULE, "id": "french", "fileType": "excel", "keywords": ["fr"], "source": {"type": "table"}},
    {**MATRIX_RULE, "id": "german", "fileType": "excel", "keywords": ["de"]},
    {**CARD_RULE, "id": "english", "fileType": "excel", "keywords": ["en"]},
    {"id": "spanish", "fileType": "word", "keywords": ["es"], "source": {"type": "text"},
     "textParsing": {"recordSeparator": r"\. ", "fieldPatterns": {"remark": "([a-z]+)"}}},
]


SUITE_COUNTS = f"""cut AS (SELECT file_id, sheet_idx, string_split_regex(skuName, 'th') AS p FROM pairs),
counts AS (SELECT 'fr' AS lang, file_id, sheet_idx, count(*) AS n FROM mapped GROUP BY 2, 3
  UNION ALL SELECT 'de', file_id, sheet_idx, sum(CASE WHEN len(p) <= 1 THEN 1 ELSE len(list_filter(p, lambda x: NOT {sql_blank('x')})) END) FROM cut GROUP BY 2, 3
  UNION ALL SELECT 'en', file_id, sheet_idx, count(DISTINCT coalesce(storeName, '')) FROM card_meta GROUP BY 2, 3
  UNION ALL SELECT 'es', file_id, sheet_idx, len(list_filter(string_split_regex(text, '\\. '), lambda x: NOT {sql_blank('x')})) FROM sheets)"""


@query("parse_files", with_(ROWS, HEADS, ENDS, DATA, MAPPED, PAIRS, CARDS, CARD_META, SUITE_COUNTS)
    + """SELECT concat(s.file_id, '/', CAST(s.sheet_idx AS VARCHAR)) AS file_id, 'yes' AS success, CAST(coalesce(n, 0) AS BIGINT) AS total_rows
FROM sheets s LEFT JOIN counts c ON c.file_id = s.file_id AND c.sheet_idx = s.sheet_idx AND c.lang = string_split(sheet_name, '-')[1]""")
def parse_files_query(t: Tables) -> DataFrame:
    """Each language has its own rule; Spanish documents are texts."""
    sheets_ = t.sheets().withColumn("file_id", F.concat_ws("/", "file_id", F.col("sheet_idx").cast("string")))
    spanish = F.startswith("sheet_name", F.lit("es-"))
    files = sheets_.select("file_id", F.concat("sheet_name", F.when(spanish, ".docx").otherwise(".xlsx")).alias("file_name"))
    texts = sheets_.filter(spanish).select("file_id", F.lit("word").alias("file_type"), F.lit(0).alias("page_idx"), "text")
    got = parse_files(files, t.single_sheets(), texts, SUITE)
    out = summary.parse_summary(files, got.records, got.errors)
    return out.select("file_id", F.when(F.col("success"), "yes").otherwise("no").alias("success"), "total_rows")


@query("parse_summary", with_(ROWS, HEADS, ENDS, DATA, MAPPED) + f"""SELECT a.file_id, CASE WHEN f IS NULL THEN 'no' ELSE 'yes' END AS success,
  coalesce(n, 0) AS total_rows, coalesce(n, 0) AS parsed_rows
FROM (SELECT DISTINCT file_id FROM sheets) a LEFT JOIN {FIRST_FR} ON f = a.file_id
LEFT JOIN (SELECT file_id, sheet_idx, count(*) AS n FROM mapped GROUP BY 1, 2) c ON c.file_id = f AND c.sheet_idx = s""")
def parse_summary(t: Tables) -> DataFrame:
    got = parse(t.rows(), None, TABLE_RULE)
    out = summary.parse_summary(t.sheets(), got.records, got.errors)
    return out.withColumn("success", F.when(F.col("success"), "yes").otherwise("no"))


SUITE_KIND = "(CAST(substr(s.file_id, 6) AS BIGINT) * 8 + s.sheet_idx) % 5"


@query("suite_summary", with_(ROWS, HEADS, ENDS, DATA, MAPPED, PAIRS, CARDS, CARD_META, SUITE_COUNTS)
    + f"""SELECT count(*) AS files, count(*) FILTER ({SUITE_KIND} <> 1) AS matched, count(*) FILTER ({SUITE_KIND} > 1) AS passed,
  count(*) FILTER ({SUITE_KIND} <= 1) AS failed, count(*) FILTER ({SUITE_KIND} <= 1 OR coalesce(n, 0) = 0) AS without_rows
FROM sheets s LEFT JOIN counts c ON c.file_id = s.file_id AND c.sheet_idx = s.sheet_idx AND c.lang = string_split(sheet_name, '-')[1]""")
def suite_summary(t: Tables) -> DataFrame:
    """Each language has its own rule; a fifth of the files hold nothing and a fifth have a name of the wrong kind."""
    sheets_ = t.sheets().withColumns({
        "kind": (F.substring_index("file_id", "-", -1).cast("bigint") * 8 + F.col("sheet_idx")) % 5,
        "file_id": F.concat_ws("/", "file_id", F.col("sheet_idx").cast("string"))})
    spanish = F.startswith("sheet_name", F.lit("es-"))
    suffix = F.when(F.col("kind") == 1, ".pdf").when(spanish, ".docx").otherwise(".xlsx")
    files = sheets_.select("file_id", F.concat("sheet_name", suffix).alias("file_name"))
    full = sheets_.filter(F.col("kind") > 0)
    rows = t.single_sheets().join(full.select("file_id"), "file_id", "left_semi")
    texts = full.filter(spanish).select("file_id", F.lit("word").alias("file_type"), F.lit(0).alias("page_idx"), "text")
    got = parse_files(files, rows, texts, SUITE)
    routed = match_rule_by_filename(files, SUITE)
    return summary.suite_summary(routed, summary.parse_summary(files, got.records, got.errors))
