"""Queries on the order store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.registry import ITEMS, LINE, ORDERS, Tables, order_code, query, sku_code, sql_code, sql_sku, with_
from consigna.operators import query as Q
from consigna.operators import rules_table
from consigna.session import shared_folder
from consigna.sources import store as S

ORDER_SQL = ", ".join(f"{c} AS {n}" for n, c in Q.ORDER_COLUMNS.items())
ITEM_SQL = "coalesce(sku_code, '') AS skuCode, coalesce(sku_name, '') AS skuName, coalesce(sku_quantity, -1) AS skuQuantity, coalesce(sku_spec, '') AS skuSpec"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.000Z')"
STORE = with_(ORDERS, ITEMS)


def _plain_items(df: DataFrame) -> DataFrame:
    """Item columns without NULLs, quantity as DOUBLE."""
    return df.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("skuCode", "skuName", "skuSpec")},
        "skuQuantity": F.coalesce(F.col("skuQuantity").cast("double"), F.lit(-1.0)),
    })


def _item_text(df: DataFrame) -> DataFrame:
    """Nested items as one text per list."""
    text = F.transform("items", lambda i: F.concat_ws(
        ":", i["skuCode"], i["skuName"], i["skuQuantity"].cast("int").cast("string"), i["skuSpec"]))
    return df.withColumn("items", F.array_join(text, ";"))


ITEM_LIST = """nested AS (SELECT order_id, string_agg(concat_ws(':', sku_code, sku_name, CAST(CAST(sku_quantity AS INT) AS VARCHAR), sku_spec),
  ';' ORDER BY id) AS items, count(*) AS n FROM store_items GROUP BY order_id)"""


@query("orders_with_items", STORE + f"""SELECT o.id AS orderId, {ORDER_SQL}, {ISO.format('created_at')} AS createdAt, coalesce(i.id, '') AS itemId, {ITEM_SQL}
FROM store_orders o LEFT JOIN store_items i ON o.id = i.order_id""")
def orders_with_items(t: Tables) -> DataFrame:
    rows = Q.orders_with_items(t.orders(), t.items())
    return (
        _plain_items(rows).withColumn("itemId", F.coalesce("itemId", F.lit("")))
        .withColumn("createdAt", Q._iso(F.col("created_at"))).drop("created_at")
    )


SEARCH = {"external_code": "1", "receiver_name": "1_", "start": "1996-01-01", "end": "1998-06-30"}
MATCHED = """matched AS (SELECT * FROM store_orders WHERE external_code LIKE '%1%' AND receiver_name LIKE '%1_%'
  AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-07-01')"""


@query("orders_search", with_(ORDERS, ITEMS, MATCHED) + f"""SELECT o.id AS orderId, {ORDER_SQL}, {ISO.format('created_at')} AS createdAt, {ITEM_SQL}
FROM matched o LEFT JOIN store_items i ON o.id = i.order_id
ORDER BY created_at DESC NULLS FIRST, o.id, i.id LIMIT 20 OFFSET 40""")
def orders_search(t: Tables) -> DataFrame:
    return _plain_items(Q.orders_search(t.orders(), t.items(), page=3, page_size=20, **SEARCH))


@query("orders_count", with_(ORDERS, MATCHED) + "SELECT count(*) AS total FROM matched")
def orders_count(t: Tables) -> DataFrame:
    return Q.orders_count(Q.filter_orders(t.orders(), **SEARCH))


@query("orders_count_distinct", with_(ORDERS) + "SELECT count(DISTINCT id) AS total FROM store_orders WHERE created_at >= TIMESTAMP '1998-01-01'")
def orders_count_distinct(t: Tables) -> DataFrame:
    return Q.orders_count_distinct(Q.filter_orders(t.orders(), start="1998-01-01"))


@query("orders_sync", with_(ORDERS, ITEMS, ITEM_LIST) + f"""SELECT id AS orderId, {ORDER_SQL}, {ISO.format('created_at')} AS createdAt,
  coalesce(items, '') AS items
FROM (SELECT * FROM store_orders WHERE created_at >= TIMESTAMP '1998-01-01' ORDER BY created_at DESC, id LIMIT 50 OFFSET 50) o
LEFT JOIN nested ON id = order_id""")
def orders_sync(t: Tables) -> DataFrame:
    return _item_text(Q.orders_sync(t.orders(), t.items(), "1998-01-01", page=2)).drop("amount")


@query("items_nested", with_(ITEMS) + """SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY id) AS position,
  sku_code AS skuCode, sku_name AS skuName, CAST(sku_quantity AS DOUBLE) AS skuQuantity, sku_spec AS skuSpec FROM store_items""")
def items_nested(t: Tables) -> DataFrame:
    return Q.items_nested(t.items(), [F.substring_index("id", "-", 3)]).withColumn("skuQuantity", F.col("skuQuantity").cast("double"))


# Asked codes lie 5000 keys further than the orders, so some of them are unknown.
SHIFT = 5000


@query("order_detail", with_(ORDERS, ITEMS, ITEM_LIST) + f"""SELECT a.code, CASE WHEN o.id IS NULL THEN 'order_not_found' ELSE 'found' END AS status,
  coalesce(o.id, '') AS orderId, coalesce(store_name, '') AS storeName, coalesce({ISO.format('created_at')}, '') AS createdAt, coalesce(items, '') AS items
FROM (SELECT DISTINCT {sql_code(f'o_orderkey + {SHIFT}')} AS code FROM orders) a
LEFT JOIN store_orders o ON a.code = o.external_code LEFT JOIN nested ON o.id = order_id""")
def order_detail(t: Tables) -> DataFrame:
    codes = t.read("orders").select(F.concat(order_code(F.col("o_orderkey") + SHIFT), F.lit(" ")).alias("code"))
    found = _item_text(Q.order_detail(codes, t.orders(), t.items()))
    return found.select("code", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("orderId", "storeName", "createdAt", "items")])


def _pairs(t: Tables) -> DataFrame:
    """Lines as (code, sku) questions: some blank, some unknown orders, some wrong skus."""
    n = F.col("l_linenumber")
    return t.spread(t.read("lineitem")).select(
        F.when(n == 1, " ").otherwise(order_code(F.col("l_orderkey") + F.when(n == 2, 10**9).otherwise(0))).alias("externalCode"),
        F.concat(sku_code(F.col("l_partkey") + F.when(n == 3, 1).otherwise(0)), F.lit(" ")).alias("skuCode"),
    )


PAIRS = f"""pairs AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN '' ELSE {sql_code('l_orderkey + CASE WHEN l_linenumber = 2 THEN 1000000000 ELSE 0 END')} END AS code,
  {sql_sku('l_partkey + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END')} AS sku FROM lineitem)"""


@query("sku_in_order", with_(ORDERS, ITEMS, PAIRS, """hits AS (SELECT external_code, sku_code,
  list(o.id || '|' || store_name || '|' || sku_name || '|' || CAST(CAST(sku_quantity AS INT) AS VARCHAR) || '|' || sku_spec
    ORDER BY created_at, o.id, i.id)[1] AS hit
  FROM store_orders o JOIN store_items i ON o.id = i.order_id GROUP BY 1, 2)""") + """SELECT code, sku,
  CASE WHEN code = '' OR sku = '' THEN 'invalid_payload' WHEN hit IS NOT NULL THEN 'valid'
    WHEN code IN (SELECT external_code FROM store_orders) THEN 'sku_not_in_order' ELSE 'order_not_found' END AS status, coalesce(hit, '') AS hit
FROM pairs LEFT JOIN hits ON code = external_code AND sku = sku_code""")
def sku_in_order(t: Tables) -> DataFrame:
    found = Q.sku_in_order(_pairs(t), t.orders(), t.items())
    hit = F.concat_ws("|", "orderId", "storeName", "skuName", F.col("skuQuantity").cast("int").cast("string"), "skuSpec")
    return found.select("code", "sku", "status", F.when(F.col("status") == "valid", hit).otherwise("").alias("hit"))


@query("marker_existence", f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'invalid_external_code'
  WHEN o_orderkey IS NOT NULL THEN 'accepted' ELSE 'order_not_found' END AS status
FROM events LEFT JOIN orders ON event_id + {SHIFT * 2} = o_orderkey""")
def marker_existence(t: Tables) -> DataFrame:
    markers = t.read("events").select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, "\t").otherwise(order_code(F.col("event_id") + SHIFT * 2)).alias("externalCode"))
    return Q.marker_existence(markers, t.orders()).select("event_id", "status")


def _monthly(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Store tables whose batches are months.

    Orders are laid by day as numbers; their texts are made behind that. Lines are moved once, to meet their months, and
    written by the tasks that joined them: a month has a file of each, and months are few. Both are sorted by day, as
    a task writes one file after the other, while they are numbers: the sort has less than half the bytes it has of texts.
    """
    month = F.trunc("o_orderdate", "month").cast("timestamp")
    heads = S.by_day(t.read("orders").select("o_orderkey", "o_custkey", "o_orderpriority", month.alias("o_orderdate")), "o_orderdate")
    orders = t.orders(heads.sortWithinPartitions("created_day"), F.col("created_day")).withColumn("batch_id", F.date_format("created_at", "yyyy-MM"))
    months = t.read("orders").select("o_orderkey", month.alias("created_at"))
    lines = S.with_day(t.spread(t.lines()).select(*LINE, "l_quantity", "l_returnflag").join(months, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"))
    return orders, t.items(lines.sortWithinPartitions("created_day"), F.date_format("created_at", "yyyy-MM").alias("batch_id"), F.col("created_at"), F.col("created_day"))


MONTH = "strftime(o_orderdate, '%Y-%m')"


@query("write_orders", f"""SELECT {MONTH} AS batch_id, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS items
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def write_orders(t: Tables) -> DataFrame:
    """Written twice: the second time replaces the first."""
    path = shared_folder(t.spark, "store")
    orders, items = _monthly(t)
    S.write_orders(orders, items, path)
    S.write_orders(orders, items, path)
    stored = S.orders_scan(t.spark, path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("orders"))
    lines = S.items_scan(t.spark, path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("items"))
    return stored.join(lines, "batch_id", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("bigint")))


@query("orders_scan", f"SELECT concat('O-', CAST(o_orderkey AS VARCHAR)) AS id, {MONTH} AS batch_id FROM orders WHERE {MONTH} BETWEEN '1996-03' AND '1996-06'")
def orders_scan(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "store")
    S.write_orders(*_monthly(t), path)
    return S.orders_scan(t.spark, path, "1996-03-01", "1996-06-30").select("id", F.col("batch_id").cast("string").alias("batch_id"))


@query("items_scan", "SELECT concat('O-', CAST(l_orderkey AS VARCHAR)) AS order_id, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def items_scan(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "store")
    S.write_orders(*_monthly(t), path)
    return S.items_scan(t.spark, path).groupBy("order_id").agg(F.sum("sku_quantity").cast("double").alias("quantity"))


EXT = ["xlsx", "XLS", "docx", "pdf", "csv"]
NAMES = "names AS (SELECT page_id, concat(url, CASE page_id % 5 " + " ".join(
    f"WHEN {i} THEN '.{e}'" for i, e in enumerate(EXT)) + " END) AS file_name, CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(html) END AS size FROM pages)"


def names(t: Tables) -> DataFrame:
    """Page addresses as file names."""
    ext = F.element_at(F.array(*[F.lit(f".{e}") for e in EXT]), (F.col("page_id") % 5 + 1).cast("int"))
    return t.read("pages").select(
        "page_id", F.concat("url", ext).alias("file_name"),
        F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html")).alias("size"))


TYPE_SQL = "CASE page_id % 5 WHEN 0 THEN 'excel' WHEN 1 THEN 'excel' WHEN 2 THEN 'word' WHEN 3 THEN 'pdf' ELSE '' END"


@query("file_type_from_name", with_(NAMES) + f"""SELECT file_name, {TYPE_SQL} AS file_type,
  CASE WHEN page_id % 5 = 4 THEN 'unsupported' WHEN size = 0 THEN 'empty' ELSE '' END AS rejected FROM names""")
def file_type_from_name(t: Tables) -> DataFrame:
    from consigna.sources.files import file_type_from_name as typed
    out = typed(names(t), size="size")
    return out.select("file_name", F.coalesce("file_type", F.lit("")).alias("file_type"), F.coalesce("rejected", F.lit("")).alias("rejected"))


RULES = [
    {"id": "blogs", "fileType": "excel", "keywords": ["blog", "example"]},
    {"id": "english", "fileType": "excel", "keywords": ["/en/"]},
    {"id": "secure", "fileType": "word", "keywords": ["https"]},
    {"id": "paged", "fileType": "pdf", "keywords": ["page=", "ref="]},
    {"id": "rest", "fileType": "pdf", "keywords": ["http"]},
    {"id": "unused", "fileType": "excel", "keywords": []},
]


@query("match_rule_by_filename", with_(NAMES) + """SELECT file_name, CASE
  WHEN page_id % 5 IN (0, 1) AND contains(file_name, 'blog') AND contains(file_name, 'example') THEN 'blogs'
  WHEN page_id % 5 IN (0, 1) AND contains(file_name, '/en/') THEN 'english'
  WHEN page_id % 5 = 2 AND contains(file_name, 'https') THEN 'secure'
  WHEN page_id % 5 = 3 AND contains(file_name, 'page=') AND contains(file_name, 'ref=') THEN 'paged'
  WHEN page_id % 5 = 3 AND contains(file_name, 'http') THEN 'rest' ELSE '' END AS rule_id FROM names""")
def match_rule_by_filename(t: Tables) -> DataFrame:
    out = rules_table.match_rule_by_filename(names(t), RULES)
    return out.select("file_name", F.coalesce("rule_id", F.lit("")).alias("rule_id"))


@query("rules_for_type", with_(NAMES) + f"SELECT page_id, file_name FROM names WHERE {TYPE_SQL} = 'excel'")
def rules_for_type(t: Tables) -> DataFrame:
    from consigna.sources.files import file_type
    return rules_table.rules_for_type(names(t).withColumn("file_type", file_type(F.col("file_name"))), "excel").select("page_id", "file_name")


@query("upsert_snapshot", """WITH incoming AS (
  SELECT name, list(description ORDER BY p_partkey DESC)[1] AS description FROM (
    SELECT concat('rule-', CAST((p_partkey // 2) * 2 + 1000 AS VARCHAR)) AS name, p_brand AS description, p_partkey FROM part) GROUP BY name),
stored AS (SELECT concat('id-', CAST(p_partkey AS VARCHAR)) AS id, concat('rule-', CAST(p_partkey AS VARCHAR)) AS name, p_type AS description FROM part)
SELECT coalesce(s.id, concat('new-', i.name)) AS id, coalesce(s.name, i.name) AS name, coalesce(i.description, s.description) AS description,
  CASE WHEN s.id IS NULL THEN 'inserted' WHEN i.name IS NULL THEN 'kept' ELSE 'updated' END AS action,
  CASE WHEN i.name IS NULL THEN 'old' ELSE 'new' END AS updated_at
FROM stored s FULL OUTER JOIN incoming i ON s.name = i.name""")
def upsert_snapshot(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    stored = t.read("part").select(
        F.concat(F.lit("id-"), key.cast("string")).alias("id"), F.concat(F.lit("rule-"), key.cast("string")).alias("name"),
        F.col("p_type").alias("description"), F.lit("old").alias("created_at"), F.lit("old").alias("updated_at"))
    incoming = t.read("part").select(
        F.concat(F.lit("rule-"), (F.floor(key / 2) * 2 + 1000).cast("string")).alias("name"),
        F.col("p_brand").alias("description"), key.alias("seq"))
    merged = rules_table.upsert_snapshot(
        stored, incoming, "name", ["description"], "seq", F.lit("new"), F.concat(F.lit("new-"), F.col("name")))
    return merged.drop("created_at")
