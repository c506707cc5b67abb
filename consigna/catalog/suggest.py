"""Preparation of rule suggestion over documents, events and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.registry import ROWS, TEXTS, Tables, query, with_
from consigna.operators import suggest

SAMPLE = """first_rows AS (SELECT file_id, string_agg(array_to_string(cells, chr(9)), chr(10) ORDER BY row_idx) AS content,
    list(cells ORDER BY row_idx) AS sample FROM raw WHERE sheet_idx = 0 AND row_idx < 20 GROUP BY 1),
names AS (SELECT file_id, string_agg(sheet_name, ', ' ORDER BY sheet_idx) AS sheet_names FROM sheets GROUP BY 1),
sizes AS (SELECT file_id, count(*) AS total_rows FROM raw WHERE sheet_idx = 0 GROUP BY 1),
preview AS (SELECT n.file_id, sheet_names, coalesce(content, '') AS content, sample, coalesce(total_rows, 0) AS total_rows
  FROM names n LEFT JOIN first_rows f ON f.file_id = n.file_id LEFT JOIN sizes s ON s.file_id = n.file_id)"""


@query("preview_rows", with_(ROWS) + "SELECT file_id, sheet_idx, row_idx, line FROM raw WHERE sheet_idx = 0 AND row_idx < 20")
def preview_rows(t: Tables) -> DataFrame:
    return suggest.preview_rows(t.rows()).select("file_id", "sheet_idx", "row_idx", F.array_join("cells", " ").alias("line"))


@query("preview_sample", with_(ROWS, SAMPLE) + "SELECT file_id, sheet_names, content, total_rows FROM preview")
def preview_sample(t: Tables) -> DataFrame:
    return suggest.preview_sample(t.rows()).drop("sample").withColumn("sheet_names", F.array_join("sheet_names", ", "))


@query("preview_text", with_(TEXTS) + """SELECT file_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS total_rows,
  array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)) AS content, substring(text, 1, 5000) AS head FROM texts""")
def preview_text(t: Tables) -> DataFrame:
    lines = suggest.preview_text(t.texts())
    head = suggest.preview_text(t.texts(), suggest.PREVIEW_CHARS).select("file_id", F.col("content").alias("head"))
    return lines.join(head, "file_id")


@query("prompt_table", with_(ROWS, SAMPLE) + """SELECT file_id, concat('文件类型: excel', chr(10), 'Sheet名称: ', sheet_names, chr(10), '总行数: ', CAST(total_rows AS VARCHAR),
  chr(10), chr(10), '文件内容前20行:', chr(10), content,
  CASE WHEN sample IS NOT NULL THEN concat(chr(10), chr(10), '原始数据样本(JSON格式):', chr(10), '[', chr(10),
    array_to_string(list_transform(sample, lambda r: concat('  [', chr(10),
      array_to_string(list_transform(r, lambda c: concat('    ', CAST(to_json(c) AS VARCHAR))), concat(',', chr(10))), chr(10), '  ]')), concat(',', chr(10))),
    chr(10), ']') ELSE '' END, chr(10), chr(10), '请分析此文件的结构并生成解析规则。') AS prompt FROM preview""")
def prompt_table(t: Tables) -> DataFrame:
    return suggest.prompt_table(suggest.preview_sample(t.rows()).withColumn("file_type", F.lit("excel")))


FENCE = "```"


def _answers(t: Tables) -> DataFrame:
    """Event properties as answers: plain, fenced, inside prose, without JSON."""
    props = F.col("props")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(F.lit(f"Here it is:\n{FENCE}json\n"), props, F.lit(f"\n{FENCE}\nDone {{}}")))
        .when(kind == 2, F.concat(F.lit("The rule is "), props, F.lit(" as asked.")))
        .otherwise(F.lit("no rule found"))
    )
    return t.read("events").select("event_id", text.alias("text"))


@query("recover_json", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'fence' WHEN 2 THEN 'braces' ELSE 'none' END AS found_by,
  CASE WHEN event_id % 4 = 3 THEN '' ELSE props END AS json FROM events""")
def recover_json(t: Tables) -> DataFrame:
    return suggest.recover_json(_answers(t)).select(
        "event_id", F.coalesce("found_by", F.lit("none")).alias("found_by"), F.coalesce("json", F.lit("")).alias("json"))


def _rules(t: Tables) -> DataFrame:
    """Parts as suggested rules of different shapes."""
    k = F.col("p_partkey")
    name = F.concat(F.lit('"name":"'), F.col("p_name"), F.lit('"'))
    body = (
        F.when(k % 6 == 0, F.concat(F.lit('{"rule":{'), name, F.lit(',"matrixTranspose":{"a":1},"other":1},"confidence":{"skuCode":0.9},"explanation":"e"}')))
        .when(k % 6 == 1, F.concat(F.lit("{"), name, F.lit(',"fieldMapping":{"skuCode":{"type":"column"}},"metadataExtraction":{"a":1}}')))
        .when(k % 6 == 2, F.concat(F.lit('{"rule":{"source":{"type":"card"},'), name, F.lit(',"metadataExtraction":[{"a":1}]}}')))
        .when(k % 6 == 3, F.lit('{"rule":{"textParsing":{},"name":""}}'))
        .when(k % 6 == 4, F.lit('{"name":"lost","matrixTranspose":{"a":1},"explanation":"x"}'))
        .otherwise(F.lit('{"rule":{"cardParsing":{"b":2},"textParsing":{"c":3},"source":null}}'))
    )
    return t.read("part").select("p_partkey", body.alias("json"))


@query("normalize_rule", f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'matrix' WHEN 2 THEN 'card' WHEN 3 THEN 'text' WHEN 5 THEN 'card' ELSE 'table' END AS source_type,
  CASE p_partkey % 6 WHEN 0 THEN 'e' WHEN 4 THEN 'x' ELSE '' END AS explanation,
  CASE p_partkey % 6 WHEN 0 THEN concat('{{"name":"', p_name, '","source":{{"type":"matrix"}},"matrixTranspose":{{"a":1}}}}')
    WHEN 1 THEN concat('{{"name":"', p_name, '","source":{{"type":"table"}},"fieldMapping":{{"skuCode":{{"type":"column"}}}}}}')
    WHEN 2 THEN concat('{{"name":"', p_name, '","source":{{"type":"card"}},"metadataExtraction":[{{"a":1}}]}}')
    WHEN 3 THEN '{{"name":"{suggest.DEFAULT_NAME}","source":{{"type":"text"}},"textParsing":{{}}}}'
    WHEN 4 THEN '{{"name":"{suggest.DEFAULT_NAME}","source":{{"type":"table"}}}}'
    ELSE '{{"name":"{suggest.DEFAULT_NAME}","source":{{"type":"card"}},"cardParsing":{{"b":2}},"textParsing":{{"c":3}}}}' END AS rule
FROM part""")
def normalize_rule(t: Tables) -> DataFrame:
    return suggest.normalize_rule(_rules(t)).select("p_partkey", "source_type", "explanation", "rule")


@query("confidence_band", """SELECT p_partkey, field, score, CAST(floor(score * 100 + 0.5) AS BIGINT) AS percent,
  CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT p_partkey, 'storeName' AS field, CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS score FROM part
  UNION ALL SELECT p_partkey, 'skuCode', CAST(p_partkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) FROM part)""")
def confidence_band(t: Tables) -> DataFrame:
    scores = F.create_map(
        F.lit("storeName"), F.col("p_size").cast("double") / 50, F.lit("skuCode"), (F.col("p_partkey") % 100).cast("double") / 100)
    return suggest.confidence_band(t.read("part").select("p_partkey", scores.alias("confidence")))
