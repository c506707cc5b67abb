"""Look-ups on a stored and indexed order table, and codes that come again in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.registry import ITEMS, ORDERS, Tables, order_code, query, sql_code, with_
from consigna.catalog.store import ISO, ITEM_LIST, ITEM_SQL, ORDER_SQL, PAIRS, SHIFT, _item_text, _monthly, _pairs, _plain_items
from consigna.session import shared_folder
from consigna.sources import index, store, totals
from consigna.streaming.repeats import repeated_orders, watch_repeats

MONTHLY = ORDERS.replace("o_orderdate AS created_at", "date_trunc('month', o_orderdate) AS created_at")


def _indexed(t: Tables) -> str:
    """A store of monthly batches; all but the last, which are published last, are indexed when it is asked."""
    path, attempt = shared_folder(t.spark, "store"), store.new_attempt()
    orders, items = _monthly(t)
    late = F.col("batch_id") >= "1998-01"
    store.write_orders(orders, items, path, store.counted(orders.where(~late)), attempt)
    index.index_store(t.spark, path)
    store.publish(store.counted(orders.where(late)), path, attempt)
    return path


@query("stored_order_detail", with_(MONTHLY, ITEMS, ITEM_LIST) + f"""SELECT a.code, CASE WHEN o.id IS NULL THEN 'order_not_found' ELSE 'found' END AS status,
  coalesce(o.id, '') AS orderId, coalesce(store_name, '') AS storeName, coalesce({ISO.format('created_at')}, '') AS createdAt, coalesce(items, '') AS items
FROM (SELECT DISTINCT {sql_code(f'o_orderkey + {SHIFT}')} AS code FROM orders) a
LEFT JOIN store_orders o ON a.code = o.external_code LEFT JOIN nested ON o.id = order_id""")
def stored_order_detail(t: Tables) -> DataFrame:
    codes = t.read("orders").select(F.concat(order_code(F.col("o_orderkey") + SHIFT), F.lit(" ")).alias("code"))
    found = _item_text(index.stored_order_detail(t.spark, _indexed(t), codes))
    return found.select("code", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("orderId", "storeName", "createdAt", "items")])


@query("stored_sku_in_order", with_(MONTHLY, ITEMS, PAIRS) + """SELECT code, sku,
  CASE WHEN code = '' OR sku = '' THEN 'invalid_payload' WHEN hit THEN 'valid'
    WHEN code IN (SELECT external_code FROM store_orders) THEN 'sku_not_in_order' ELSE 'order_not_found' END AS status
FROM pairs LEFT JOIN (SELECT DISTINCT external_code, sku_code, true AS hit FROM store_orders o JOIN store_items i ON o.id = i.order_id)
  ON code = external_code AND sku = sku_code""")
def stored_sku_in_order(t: Tables) -> DataFrame:
    return index.stored_sku_in_order(t.spark, _indexed(t), _pairs(t), details=False)


@query("stored_marker_existence", f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'invalid_external_code'
  WHEN o_orderkey IS NOT NULL THEN 'accepted' ELSE 'order_not_found' END AS status
FROM events LEFT JOIN orders ON event_id + {SHIFT * 2} = o_orderkey""")
def stored_marker_existence(t: Tables) -> DataFrame:
    markers = t.read("events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, "\t").otherwise(order_code(F.col("event_id") + SHIFT * 2)).alias("externalCode"))
    return index.stored_marker_existence(t.spark, _indexed(t), markers).select("event_id", "status")


PART = {"external_code": "1_2", "receiver_name": "er 1", "start": "1996-01-01", "end": "1998-06-30"}


@query("stored_search", with_(MONTHLY, ITEMS) + f"""SELECT o.id AS orderId, {ORDER_SQL}, {ISO.format('created_at')} AS createdAt, {ITEM_SQL}
FROM store_orders o LEFT JOIN store_items i ON o.id = i.order_id WHERE external_code LIKE '%1_2%' AND receiver_name LIKE '%er 1%'
  AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-07-01'
ORDER BY created_at DESC NULLS FIRST, o.id, i.id LIMIT 5 OFFSET 10""")
def stored_search(t: Tables) -> DataFrame:
    return _plain_items(index.stored_search(t.spark, _indexed(t), page=3, page_size=5, **PART))


@query("stored_page", with_(MONTHLY, ITEMS) + f"""SELECT o.id AS orderId, {ORDER_SQL}, {ISO.format('created_at')} AS createdAt, {ITEM_SQL}
FROM store_orders o LEFT JOIN store_items i ON o.id = i.order_id
ORDER BY created_at DESC NULLS FIRST, o.id, i.id LIMIT 50 OFFSET 4950""")
def stored_page(t: Tables) -> DataFrame:
    """Page 100, found by the rows that each hour has."""
    path = _indexed(t)
    index.index_store(t.spark, path)
    return _plain_items(index.stored_search(t.spark, path, page=100, page_size=50))


RANGES = {"all": (None, None), "since": ("1995-06-01", None), "until": (None, "1996-06-01 00:00:01"), "both": ("1995-05-31 23:30:00", "1997-01-01 00:30:00"), "none": ("1997-01-01", "1996-01-01")}


def _range_sql(name: str, since: str | None, until: str | None) -> str:
    conds = [f"created_at >= TIMESTAMP '{since}'" if since else "", f"created_at < TIMESTAMP '{until}'" if until else ""]
    return f"SELECT '{name}' AS asked, count(*) AS total FROM store_orders WHERE " + (" AND ".join(c for c in conds if c) or "true")


@query("stored_orders_count", with_(MONTHLY) + "\nUNION ALL ".join(_range_sql(n, *r) for n, r in RANGES.items()))
def stored_orders_count(t: Tables) -> DataFrame:
    """Orders of time ranges, from the counts that loads keep; the last load is counted by a scan."""
    path, out = _indexed(t), None
    for name, (since, until) in RANGES.items():
        one = totals.stored_orders_count(t.spark, path, since, until).select(F.lit(name).alias("asked"), "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("stored_field_coverage", with_(MONTHLY, ITEMS) + "\nUNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (coalesce(CAST({f} AS VARCHAR), '') <> '') AS filled, count(*) AS total FROM {name}"
    for name, fields in (("store_orders", index.ORDER_FIELDS), ("store_items", index.ITEM_FIELDS)) for f in fields))
def stored_field_coverage(t: Tables) -> DataFrame:
    return totals.stored_field_coverage(t.spark, _indexed(t)).select("field", "filled", "total")


@query("import_stream_repeats", """WITH texts AS (SELECT doc_id, doc_id % 3 AS epoch, concat('c', CAST(length(text) % 1000 AS VARCHAR)) AS code FROM documents),
ranked AS (SELECT doc_id, code, row_number() OVER (PARTITION BY code ORDER BY epoch, sha256(concat('E', CAST(epoch AS VARCHAR), '/', CAST(doc_id AS VARCHAR)))) AS p FROM texts)
SELECT code, count(*) AS orders, CAST(count(*) FILTER (p > 1) AS BIGINT) AS repeats FROM ranked GROUP BY code""")
def import_stream_repeats(t: Tables) -> DataFrame:
    """Three loads of a third of the documents each; a code is the length of a text. The stream follows after each load."""
    path, state = shared_folder(t.spark, "repeat-store"), shared_folder(t.spark, "repeat-state")
    docs = t.spread(t.read("documents")).select("doc_id", F.concat(F.lit("c"), (F.length("text") % 1000).cast("string")).alias("external_code"))
    for epoch in range(3):
        name = f"E{epoch}"
        orders = docs.where(F.col("doc_id") % 3 == epoch).select(
            F.sha2(F.concat(F.lit(f"{name}/"), F.col("doc_id").cast("string")), 256).alias("id"), "external_code",
            F.lit(name).alias("batch_id"), F.lit(f"2024-01-0{epoch + 1}").cast("timestamp").alias("created_at"))
        store.write_orders(orders, orders.limit(0), path)
        watch_repeats(t.spark, path, state, once=True).awaitTermination()
    seen = store.orders_scan(t.spark, path).groupBy(F.col("external_code").alias("code")).agg(F.count(F.lit(1)).alias("orders"))
    again = repeated_orders(t.spark, path).groupBy("code").agg(F.count(F.lit(1)).alias("repeats"))
    return seen.join(again, "code", "left").withColumn("repeats", F.coalesce("repeats", F.lit(0).cast("bigint")))
