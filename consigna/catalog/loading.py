"""Loading order lines into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.catalog.records import KEYS
from consigna.catalog.registry import LINE, RECORDS, Tables, query, with_
from consigna.operators import load
from consigna.session import shared_folder, shuffles_released, staged
from consigna.sources import store

IMPORTED = "2024-01-01 00:00:00"
ORDER_ID = "sha256(concat_ws('/', batch_id, CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_cents AS VARCHAR)))"


def _imported(t: Tables) -> DataFrame:
    return t.records().withColumn("created_at", F.lit(IMPORTED).cast("timestamp"))


@query("split_orders", with_(RECORDS) + f"""SELECT {ORDER_ID} AS id, externalCode AS external_code, storeName AS store_name,
  receiverName AS receiver_name, receiverPhone AS receiver_phone, receiverAddress AS receiver_address, remark, batch_id FROM rec""")
def split_orders(t: Tables) -> DataFrame:
    return load.split_orders_items(_imported(t), LINE)[0].drop("created_at")


@query("split_items", with_(RECORDS) + f"""SELECT sha256(concat({ORDER_ID}, '/item')) AS id, {ORDER_ID} AS order_id, skuCode AS sku_code,
  skuName AS sku_name, TRY_CAST(skuQuantity AS DOUBLE) AS sku_quantity, skuQuantity AS sku_quantity_text, skuSpec AS sku_spec, batch_id FROM rec WHERE skuQuantity <> 'n/a'""")
def split_items(t: Tables) -> DataFrame:
    accepted = load.accept_reject(_imported(t)).filter(F.col("rejected").isNull())
    items = load.split_orders_items(accepted, LINE)[1].drop("created_at")
    return items.withColumn("sku_quantity", F.col("sku_quantity").cast("double"))


def _long_names(t: Tables) -> DataFrame:
    """Store names of sixth lines are longer than their column."""
    return t.records().withColumn(
        "storeName", F.when(F.col("l_linenumber") == 6, F.repeat("storeName", F.lit(15))).otherwise(F.col("storeName")))


REJECTED = """CASE WHEN l_linenumber = 6 AND length(repeat(storeName, 15)) > 255 THEN 'storeName is longer than 255'
  WHEN TRY_CAST(skuQuantity AS DOUBLE) IS NULL THEN 'skuQuantity is not a number' END"""


@query("accept_reject", with_(RECORDS) + f"SELECT {KEYS}, coalesce({REJECTED}, '') AS rejected FROM rec")
def accept_reject(t: Tables) -> DataFrame:
    return load.accept_reject(_long_names(t)).select(*LINE, F.coalesce("rejected", F.lit("")).alias("rejected"))


@query("batch_summary", with_(RECORDS) + f"""SELECT batch_id, count(*) AS total_count, count(*) FILTER (rejected IS NULL) AS success_count,
  count(rejected) AS fail_count, CAST(0 AS BIGINT) AS error_count, CASE WHEN count(rejected) > 0 THEN 'partial' ELSE 'completed' END AS status
FROM (SELECT batch_id, {REJECTED} AS rejected FROM rec) GROUP BY batch_id""")
def batch_summary(t: Tables) -> DataFrame:
    return load.batch_summary(load.accept_reject(_long_names(t)))


def _corrected(t: Tables) -> DataFrame:
    """Records without errors but for the quantities of every fifth batch."""
    bad = F.floor(F.col("l_orderkey") / 1000) % 5 == 1
    return _imported(t).withColumns({
        "storeName": F.lit("Main store"), "receiverPhone": F.lit("13800138000"),
        "skuQuantity": F.when(bad, F.col("skuQuantity")).otherwise("1"),
    })


IMPORTED_SQL = """done AS (SELECT *, l_orderkey // 1000 % 5 = 1 AND (skuQuantity = 'n/a' OR skuQuantity = '0') AS bad,
  CASE WHEN l_linenumber = 5 THEN 'skuSpec is longer than 255' END AS rejected FROM rec),
batches AS (SELECT batch_id, count(*) AS total_count, CAST(count(*) FILTER (bad) AS BIGINT) AS error_count, count(rejected) AS rejects FROM done GROUP BY 1)"""


def _records(t: Tables) -> DataFrame:
    """Every fifth batch has bad quantities; fifth lines have too long a specification."""
    long = F.when(F.col("l_linenumber") == 5, F.repeat(F.lit("x"), F.lit(300))).otherwise(F.col("skuSpec"))
    return _corrected(t).withColumn("skuSpec", long)


def _import(t: Tables) -> tuple[DataFrame, str]:
    path = shared_folder(t.spark, "store")
    return load.import_job(_records(t), LINE, path), path


@query("import_job", with_(RECORDS, IMPORTED_SQL) + """SELECT batch_id, total_count, CASE WHEN error_count > 0 THEN 0 ELSE total_count - rejects END AS success_count,
  CASE WHEN error_count > 0 THEN total_count ELSE rejects END AS fail_count, error_count,
  CASE WHEN error_count > 0 THEN 'refused' WHEN rejects > 0 THEN 'partial' ELSE 'completed' END AS status FROM batches""")
def import_job(t: Tables) -> DataFrame:
    return _import(t)[0]


@query("import_batches", with_(RECORDS, IMPORTED_SQL) + """SELECT batch_id, total_count, error_count,
  CASE WHEN error_count > 0 THEN 'refused' WHEN rejects > 0 THEN 'partial' ELSE 'completed' END AS status FROM batches""")
def import_batches(t: Tables) -> DataFrame:
    """Loaded twice, joined once: each batch is there once."""
    path = shared_folder(t.spark, "store")
    with shuffles_released(t.spark):
        records = staged(_records(t), "records", compression=store.CODEC)
    for _ in range(2):
        load.import_job(records, LINE, path)
    return store.import_batches(t.spark, path).select("batch_id", "total_count", "error_count", "status")


@query("rejected_records", with_(RECORDS, IMPORTED_SQL) + f"""SELECT batch_id, concat_ws('/', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
  CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_cents AS VARCHAR)) AS position, rejected AS reason
FROM done WHERE rejected IS NOT NULL AND batch_id IN (SELECT batch_id FROM batches WHERE error_count = 0)""")
def rejected_records(t: Tables) -> DataFrame:
    return store.rejected_records(t.spark, _import(t)[1]).select("batch_id", "position", "reason")


@query("import_errors", with_(RECORDS, IMPORTED_SQL) + """SELECT batch_id, 'skuQuantity' AS field, 'SKU数量必须为正数' AS message, count(*) AS n
FROM done WHERE bad GROUP BY 1""")
def import_errors(t: Tables) -> DataFrame:
    return store.import_errors(t.spark, _import(t)[1]).groupBy("batch_id", "field", "message").agg(F.count(F.lit(1)).alias("n"))
