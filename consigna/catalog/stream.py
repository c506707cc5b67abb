"""The import stream over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.registry import Tables, query, sql_trim
from consigna.catalog.texts import ITEMS, PARTS, RULE
from consigna.session import shared_folder
from consigna.sources.store import items_scan, orders_scan
from consigna.streaming.import_stream import import_stream

# Every record gets what validation asks for; documents without text are the bad files of the stream.
STREAM_RULE = {
    **RULE,
    "textParsing": {**RULE["textParsing"], "fieldPatterns": {"remark": r"([a-z.]+@[a-z.]+)"}, "itemFields": ["skuCode", "skuName", "skuSpec"]},
    "postProcessing": {
        "trimWhitespace": True, "staticValues": {"storeName": "Main store", "skuQuantity": "2"},
        "defaultValues": {"skuCode": "none", "skuName": "none"},
    },
}


@query("import_stream", f"""WITH {PARTS}, {ITEMS}
SELECT regexp_extract(text, '([a-z.]+@[a-z.]+)', 1) AS remark, coalesce(skuCode, 'none') AS sku_code,
  CASE WHEN coalesce({sql_trim('skuName')}, '') = '' THEN 'none' ELSE {sql_trim('skuName')} END AS sku_name, coalesce(skuSpec, '') AS sku_spec,
  CAST(2 AS DOUBLE) AS sku_quantity, 'Main store' AS store_name, '2024-01-01' AS day
FROM item_rows WHERE CAST(substr(file_id, 5) AS BIGINT) % 10 <> 3""")
def import_stream_query(t: Tables) -> DataFrame:
    """Stream the documents into a new store, then read its orders with their items.

    Every tenth file has no text: it is refused, the files beside it are loaded.
    """
    stream = t.spark.readStream.schema(t.read("documents").schema).parquet(f"{t.folder}/documents*.parquet")
    docs = stream.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"),
        F.to_json(F.struct(F.lit("word").alias("type"), F.when(F.col("doc_id") % 10 == 3, " ").otherwise(F.col("text")).alias("text"))).alias("body"),
        F.lit("2024-01-01 08:00:00").cast("timestamp").alias("received_at"))
    path = shared_folder(t.spark, "stream-store")
    import_stream(docs, STREAM_RULE, path, shared_folder(t.spark, "stream-state"), once=True).awaitTermination()
    orders = orders_scan(t.spark, path).withColumn("day", F.col("created_day").cast("string"))
    rows = orders.join(items_scan(t.spark, path), orders["id"] == F.col("order_id"))
    return rows.select(
        "remark", "sku_code", "sku_name", "sku_spec", F.col("sku_quantity").cast("double").alias("sku_quantity"), "store_name", "day")
