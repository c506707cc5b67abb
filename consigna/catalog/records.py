"""Record operators over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.registry import LINE, LINES, RECORDS, Tables, order_code, query, sql_blank, sql_code, sql_trim, with_
from consigna.operators import cleanup, duplicates, edits, merge, summary, validate
from consigna.operators.validate import CHECKED, MESSAGES, PHONE
from consigna.schema import EXPORT_LABELS, FIELDS
from consigna.sources import store

KEYS = ", ".join(LINE)
ALL = ", ".join(FIELDS)
PHONE_SQL = PHONE.removeprefix("^(?:").removesuffix(r")\z")

_UNKNOWN = f"({sql_blank('storeName')} AND ({' OR '.join(sql_blank(f) for f in CHECKED[1:4])}))"


def _required(f: str) -> str:
    return f"WHEN {_UNKNOWN} AND {sql_blank(f)} THEN '{MESSAGES[f]}'"


ERROR_SQL = {
    "storeName": f"CASE {_required('storeName')} END",
    "receiverName": f"CASE {_required('receiverName')} END",
    "receiverPhone": (
        f"CASE {_required('receiverPhone')} WHEN NOT {sql_blank('receiverPhone')} AND NOT "
        f"regexp_full_match({sql_trim('receiverPhone')}, '{PHONE_SQL}') THEN '{MESSAGES['phone_format']}' END"
    ),
    "receiverAddress": f"CASE {_required('receiverAddress')} END",
    "skuCode": f"CASE WHEN {sql_blank('skuCode')} THEN '{MESSAGES['skuCode']}' END",
    "skuName": f"CASE WHEN {sql_blank('skuName')} THEN '{MESSAGES['skuName']}' END",
    "skuQuantity": (
        f"CASE WHEN coalesce(skuQuantity, '') = '' THEN '{MESSAGES['quantity_missing']}' "
        f"WHEN coalesce(TRY_CAST({sql_trim('skuQuantity')} AS DOUBLE), 0) <= 0 THEN '{MESSAGES['quantity_invalid']}' END"
    ),
}
VALIDATED = RECORDS + ", checked AS (SELECT *, " + ", ".join(f"{e} AS e_{f}" for f, e in ERROR_SQL.items()) + " FROM rec)"
COUNT_SQL = " + ".join(f"CAST(e_{f} IS NOT NULL AS INT)" for f in CHECKED)


@query("validate_records", with_(VALIDATED) + f"SELECT {KEYS}, concat_ws(';', " + ", ".join(
    f"CASE WHEN e_{f} IS NOT NULL THEN concat('{f}:', e_{f}) END" for f in CHECKED) + ") AS errors FROM checked")
def validate_records(t: Tables) -> DataFrame:
    entries = F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return validate.validate_records(t.records()).select(*LINE, F.array_join(entries, ";").alias("errors"))


@query("check_recipient", with_(RECORDS) + f"SELECT {KEYS}, " + ", ".join(
    f"coalesce(CASE {_required(f)} END, '') AS {f}" for f in CHECKED[:4]) + " FROM rec")
def check_recipient(t: Tables) -> DataFrame:
    return t.records().select(*LINE, *[F.coalesce(e, F.lit("")).alias(f) for f, e in validate.check_recipient().items()])


@query("check_sku", with_(VALIDATED) + f"SELECT {KEYS}, coalesce(e_skuCode, '') AS skuCode, coalesce(e_skuName, '') AS skuName FROM checked")
def check_sku(t: Tables) -> DataFrame:
    return t.records().select(*LINE, *[F.coalesce(e, F.lit("")).alias(f) for f, e in validate.check_sku().items()])


@query("check_quantity", with_(VALIDATED) + f"SELECT {KEYS}, coalesce(e_skuQuantity, '') AS message FROM checked")
def check_quantity(t: Tables) -> DataFrame:
    return t.records().select(*LINE, F.coalesce(validate.check_quantity(), F.lit("")).alias("message"))


@query("check_phone", with_(RECORDS) + f"""SELECT {KEYS}, CASE WHEN NOT {sql_blank('receiverPhone')} AND NOT
  regexp_full_match({sql_trim('receiverPhone')}, '{PHONE_SQL}') THEN '{MESSAGES['phone_format']}' ELSE '' END AS message FROM rec""")
def check_phone(t: Tables) -> DataFrame:
    return t.records().select(*LINE, F.coalesce(validate.check_phone(), F.lit("")).alias("message"))


@query("error_list", with_(VALIDATED) + " UNION ALL ".join(
    f"SELECT {KEYS}, '{f}' AS field, e_{f} AS message FROM checked WHERE e_{f} IS NOT NULL" for f in CHECKED))
def error_list(t: Tables) -> DataFrame:
    return validate.error_list(t.records(), LINE)


@query("error_count", with_(VALIDATED) + f"SELECT batch_id, CAST(sum({COUNT_SQL}) AS BIGINT) AS errors FROM checked GROUP BY batch_id")
def error_count(t: Tables) -> DataFrame:
    return validate.error_count(validate.validate_records(t.records()), ["batch_id"])


@query("submit_gate", with_(VALIDATED) + f"""SELECT {KEYS}, externalCode FROM checked
WHERE externalCode IN (SELECT externalCode FROM checked GROUP BY 1 HAVING sum({COUNT_SQL}) = 0)""")
def submit_gate(t: Tables) -> DataFrame:
    return validate.submit_gate(validate.validate_records(t.records()), "externalCode").select(*LINE, "externalCode")


@query("field_coverage", with_(RECORDS) + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(round(100.0 * count(*) FILTER (coalesce({f}, '') <> '') / count(*)) AS BIGINT) AS percent FROM rec"
    for f in FIELDS))
def field_coverage(t: Tables) -> DataFrame:
    return summary.field_coverage(t.records())


@query("field_coverage_by_batch", with_(RECORDS) + " UNION ALL ".join(
    f"SELECT batch_id, '{f}' AS field, CAST(round(100.0 * count(*) FILTER (coalesce({f}, '') <> '') / count(*)) AS BIGINT) AS percent "
    f"FROM rec GROUP BY batch_id" for f in FIELDS))
def field_coverage_by_batch(t: Tables) -> DataFrame:
    return summary.field_coverage(t.records(), ["batch_id"])


@query("trim_fields", with_(RECORDS) + f"SELECT {KEYS}, " + ", ".join(f"{sql_trim(f)} AS {f}" for f in FIELDS) + " FROM rec")
def trim_fields(t: Tables) -> DataFrame:
    return cleanup.trim_fields(t.records(), FIELDS).select(*LINE, *FIELDS)


@query("fill_defaults", with_(RECORDS) + f"""SELECT {KEYS}, {", ".join(f for f in FIELDS if f not in ("storeName", "remark"))},
  CASE WHEN storeName = '' THEN 'Main store' ELSE storeName END AS storeName,
  CASE WHEN remark = '' THEN 'none' ELSE remark END AS remark, '0' AS unit FROM rec""")
def fill_defaults(t: Tables) -> DataFrame:
    defaults = {"storeName": "Main store", "remark": "none", "unit": "0"}
    return cleanup.fill_defaults(t.records(), defaults).select(*LINE, *FIELDS, "unit")


@query("override_static", with_(RECORDS) + f"SELECT {KEYS}, 'depot' AS storeName, 'box' AS unit FROM rec")
def override_static(t: Tables) -> DataFrame:
    return cleanup.override_static(t.records(), {"storeName": "depot", "unit": "box"}).select(*LINE, "storeName", "unit")


_SPARSE = ["storeName", "receiverAddress", "remark"]


@query("drop_empty", with_(RECORDS) + f"""SELECT {KEYS}, {", ".join(_SPARSE)} FROM rec
WHERE {" OR ".join(f"{f} <> ''" for f in _SPARSE)}""")
def drop_empty(t: Tables) -> DataFrame:
    """Only three of the ten fields are there, so some records are empty."""
    return cleanup.drop_empty(t.records().select(*LINE, *_SPARSE))


@query("dup_in_batch", with_(RECORDS) + f"""SELECT {KEYS}, code, n FROM (
  SELECT *, {sql_trim('externalCode')} AS code, count(*) OVER (PARTITION BY {sql_trim('externalCode')}) AS n FROM rec)
WHERE code <> '' AND n > 1""")
def dup_in_batch(t: Tables) -> DataFrame:
    return duplicates.dup_in_batch(t.records(), LINE)


@query("duplicate_codes", with_(RECORDS) + """SELECT batch_id, externalCode AS code, count(*) AS n FROM rec
GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_codes(t: Tables) -> DataFrame:
    return duplicates.duplicate_codes(t.records(), ["batch_id"])


# Codes of incoming records lie 5000 keys further, so that not all of them are in the store.
SHIFT = 5000


@query("dup_vs_store", with_(LINES) + f"""SELECT {KEYS}, {sql_code(f'l_orderkey + {SHIFT}')} AS code, CAST(o_orderkey IS NOT NULL AS INT) AS in_store
FROM lines LEFT JOIN orders ON l_orderkey + {SHIFT} = o_orderkey""")
def dup_vs_store(t: Tables) -> DataFrame:
    incoming = t.lines().select(
        *LINE, F.concat(F.lit(" "), order_code(F.col("l_orderkey") + SHIFT), F.lit("\t")).alias("externalCode"))
    return duplicates.dup_vs_store(incoming, t.orders()).select(*LINE, "code", F.col("in_store").cast("int").alias("in_store"))


_SHARED = ["storeName", "receiverName", "receiverPhone", "receiverAddress"]
_FOLDED = [f for f in FIELDS if f not in _SHARED and f != "externalCode"]


@query("merge_groups", with_(RECORDS) + """SELECT externalCode, min(l_linenumber) AS l_linenumber, """ + ", ".join(
    [f"list({f} ORDER BY l_linenumber, l_partkey, l_suppkey, l_cents)[1] AS {f}" for f in [*_SHARED, "l_partkey", "l_suppkey", "l_cents"]]
    + [f"""list_reduce(list({f} ORDER BY l_linenumber, l_partkey, l_suppkey, l_cents), lambda acc, x: CASE WHEN x = '' OR x = acc THEN acc
      WHEN acc = '' THEN x ELSE concat(acc, ',', x) END, '') AS {f}""" for f in _FOLDED]) + " FROM rec GROUP BY externalCode")
def merge_groups(t: Tables) -> DataFrame:
    block = [F.floor(F.col("l_linenumber") / 4096)]
    return merge.merge_groups(t.records(together=True), "externalCode", _SHARED, FIELDS, LINE[1:], block).drop("too_long")


def _corrections(t: Tables) -> DataFrame:
    """Events as edits: two in a row address the same line, the later one wins."""
    line = F.floor(F.col("event_id") / 2)
    kind = F.col("event_type")
    field = (
        F.when(kind == "view", "remark").when(kind == "click", "storeName").when(kind == "signup", "skuQuantity")
        .when(kind == "purchase", "receiverPhone").otherwise("skuSpec")
    )
    return t.read("events").select(
        line.alias("l_orderkey"), (line % 7 + 1).cast("int").alias("l_linenumber"), field.alias("field"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("value").cast("string")).alias("value"), "ts", "event_id")


_EDITED = ["remark", "storeName", "skuQuantity", "receiverPhone", "skuSpec"]
_EDITS = """edits AS (SELECT event_id // 2 AS k, (event_id // 2) % 7 + 1 AS n, ts, event_id,
  CASE event_type WHEN 'view' THEN 'remark' WHEN 'click' THEN 'storeName' WHEN 'signup' THEN 'skuQuantity'
    WHEN 'purchase' THEN 'receiverPhone' ELSE 'skuSpec' END AS field,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_type = 'signup' AND value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
    ELSE CAST(value AS VARCHAR) END AS value FROM events),
last_edit AS (SELECT k, n, field, list(value ORDER BY ts DESC, event_id DESC)[1] AS value FROM edits GROUP BY ALL)"""


@query("apply_corrections", with_(RECORDS, _EDITS.replace("GROUP BY ALL", "GROUP BY k, n, field")) + f"SELECT {KEYS}, " + ", ".join(
    f"coalesce((SELECT value FROM last_edit WHERE k = l_orderkey AND n = l_linenumber AND field = '{f}'), {f}) AS {f}" for f in _EDITED)
    + " FROM rec")
def apply_corrections(t: Tables) -> DataFrame:
    return edits.apply_corrections(
        t.records(), _corrections(t), ["l_orderkey", "l_linenumber"], _EDITED, ["ts", "event_id"]
    ).select(*LINE, *_EDITED)


@query("delete_rows", with_(RECORDS) + f"""SELECT {KEYS}, batch_id,
  CAST(row_number() OVER (PARTITION BY batch_id ORDER BY {KEYS}) AS BIGINT) AS row_idx
FROM rec r WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id = l_orderkey AND event_id % 7 + 1 = l_linenumber)""")
def delete_rows(t: Tables) -> DataFrame:
    deleted = t.read("events").select(
        F.col("event_id").alias("l_orderkey"), (F.col("event_id") % 7 + 1).cast("int").alias("l_linenumber"))
    block = [F.floor(F.col("l_orderkey") / 64)]
    return edits.delete_rows(
        t.records(), deleted, ["l_orderkey", "l_linenumber"], ["batch_id"], [F.col(c) for c in LINE], block
    ).select(*LINE, "batch_id", F.col("row_idx").cast("bigint").alias("row_idx"))


@query("export_records", with_(RECORDS) + "SELECT " + ", ".join(f'coalesce({f}, \'\') AS "{label}"' for f, label in EXPORT_LABELS.items()) + " FROM rec")
def export_records(t: Tables) -> DataFrame:
    return store.export_records(t.records())


@query("sample_records", with_(RECORDS) + f"""SELECT batch_id, position, {ALL} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY {KEYS}) AS INT) AS position FROM rec) WHERE position <= 3""")
def sample_records(t: Tables) -> DataFrame:
    return summary.sample_records(t.records(), 3, "batch_id", LINE)
