"""Text operators over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.registry import TEXTS, Tables, query, sql_blank, sql_trim, with_
from consigna.functions.regex import translate
from consigna.operators import textmode
from consigna.plans.parse import parse
from consigna.schema import FIELDS
from consigna.sources import grid, texts

PAGES = "pages_in AS (SELECT concat('conv-', CAST(conv_id AS VARCHAR)) AS file_id, turn, text FROM conversations)"


def _pages(t: Tables) -> DataFrame:
    return t.read("conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("file_id"), F.lit("pdf").alias("file_type"),
        F.col("turn").cast("int").alias("page_idx"), "text")


@query("text_from_pages", with_(PAGES) + """SELECT file_id, string_agg(text, chr(10) ORDER BY turn) AS text, '' AS error
FROM pages_in GROUP BY file_id""")
def text_from_pages(t: Tables) -> DataFrame:
    return texts.text_from_pages(_pages(t)).withColumn("error", F.coalesce("error", F.lit("")))


@query("texts_from_json", """SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS file_id, 'word' AS file_type, CAST(i - 1 AS INT) AS page_idx, line AS text
FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [text] ELSE string_split(text, chr(10)) END) AS line,
  generate_subscripts(CASE WHEN doc_id % 2 = 0 THEN [text] ELSE string_split(text, chr(10)) END, 1) AS i FROM documents)""")
def texts_from_json(t: Tables) -> DataFrame:
    """Every other document has a full text, the rest have their lines as pages."""
    whole = F.col("doc_id") % 2 == 0
    body = F.struct(F.lit("word").alias("type"), F.when(whole, F.col("text")).alias("text"), F.split("text", "\n", -1).alias("pages"))
    docs = t.spread(t.read("documents")).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"), F.to_json(body).alias("body"))
    return grid.texts_from_json(docs)


SEPARATOR = r"\. "
PARTS = TEXTS + f""", pieces AS (SELECT file_id, list_filter(string_split_regex(text, '\\. '), lambda x: NOT {sql_blank('x')}) AS p FROM texts),
parts AS (SELECT file_id, unnest(p) AS text, CAST(unnest(range(0, len(p))) AS INT) AS text_part FROM pieces)"""


def _parts(t: Tables) -> DataFrame:
    return textmode.text_split_records(t.texts(), translate(SEPARATOR))


@query("text_split_records", with_(PARTS) + "SELECT file_id, text_part, text FROM parts")
def text_split_records(t: Tables) -> DataFrame:
    return _parts(t)


FIELD_PATTERNS = {
    "receiverPhone": r"\+1 \((\d{3})\) (\d{3}-\d{4})", "remark": r"([a-z.]+@[a-z.]+)", "storeName": r"^([A-Z][a-z]+) ",
}
FIELD_SQL = r"""coalesce(nullif(regexp_extract(text, '\+1 \(([0-9]{3})\) ([0-9]{3}-[0-9]{4})', 1), ''), '') AS receiverPhone,
  regexp_extract(text, '([a-z.]+@[a-z.]+)', 1) AS remark, regexp_extract(text, '^([A-Z][a-z]+) ', 1) AS storeName"""


def _fields(df: DataFrame) -> DataFrame:
    found = textmode.text_fields(df, {f: translate(p) for f, p in FIELD_PATTERNS.items()})
    return found.withColumns({f: F.coalesce(f, F.lit("")) for f in FIELD_PATTERNS})


@query("text_fields", with_(PARTS) + f"SELECT file_id, text_part, {FIELD_SQL} FROM parts")
def text_fields(t: Tables) -> DataFrame:
    return _fields(_parts(t)).drop("text")


ITEM = "([A-Z][a-z]+)( [a-z]+)? ([a-z]+),"
ITEMS = f"""items AS (SELECT file_id, text_part, text, regexp_extract_all(text, '{ITEM}', 1) AS a, regexp_extract_all(text, '{ITEM}', 2) AS b,
  regexp_extract_all(text, '{ITEM}', 3) AS c FROM parts),
item_rows AS (SELECT file_id, text_part, text, unnest(a) AS skuCode, unnest(b) AS skuName, unnest(c) AS skuSpec, CAST(unnest(range(0, len(a))) AS INT) AS item
    FROM items WHERE len(a) > 0
  UNION ALL SELECT file_id, text_part, text, NULL, NULL, NULL, 0 FROM items WHERE len(a) = 0)"""


@query("text_items", with_(PARTS, ITEMS) + """SELECT file_id, text_part, item, coalesce(skuCode, '-') AS skuCode, CASE WHEN skuCode IS NULL THEN '-' ELSE coalesce(skuName, '') END AS skuName,
  coalesce(skuSpec, '-') AS skuSpec, CASE WHEN skuCode IS NULL THEN '-' ELSE '' END AS skuQuantity FROM item_rows""")
def text_items(t: Tables) -> DataFrame:
    names = ["skuCode", "skuName", "skuSpec", "skuQuantity"]
    rows = textmode.text_items(_parts(t), translate(ITEM), names).drop("text")
    return rows.withColumns({f: F.coalesce(f, F.lit("-")) for f in names})


RULE = {
    "source": {"type": "text"},
    "textParsing": {
        "recordSeparator": SEPARATOR, "fieldPatterns": FIELD_PATTERNS,
        "itemPattern": ITEM, "itemFields": ["skuCode", "skuName", "_unit"],
    },
    "postProcessing": {"trimWhitespace": True, "removeEmptyRows": True},
}


@query("parse_text", f"""WITH texts AS (SELECT concat('conv-', CAST(conv_id AS VARCHAR)) AS file_id, string_agg(text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY 1){PARTS.removeprefix(TEXTS)}, {ITEMS}
SELECT file_id, text_part, item, {", ".join(f"'' AS {f}" for f in FIELDS if f not in ("skuCode", "skuName", *FIELD_PATTERNS))},
  {FIELD_SQL}, coalesce(skuCode, '') AS skuCode, coalesce({sql_trim('skuName')}, '') AS skuName, coalesce(skuSpec, '') AS unit
FROM item_rows WHERE skuCode IS NOT NULL OR regexp_matches(text, '^([A-Z][a-z]+) ') OR regexp_matches(text, '[a-z.]+@[a-z.]+')
  OR regexp_matches(text, '\\+1 \\(([0-9]{{3}})\\) ([0-9]{{3}}-[0-9]{{4}})')""")
def parse_text(t: Tables) -> DataFrame:
    got = parse(t.rows(), _pages(t), RULE).records
    return got.withColumn("unit", F.col("extra")["_unit"]).select(
        "file_id", "text_part", "item", *[F.coalesce(f, F.lit("")).alias(f) for f in [*FIELDS, "unit"]])
