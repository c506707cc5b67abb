"""Loading records into the order store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import text_or_empty, trim
from consigna.operators.validate import validate_records
from consigna.session import emptied, shared_folder, shuffles_released
from consigna.sources.store import CODEC, QUANTITY, append, counted_side, new_attempt, write_orders

#: Days up to which each task writes its own file of each; records of more days are shuffled by day first.
FEW_DAYS = 4

# Column widths of the store, in characters.
WIDTHS = {
    "externalCode": 255, "storeName": 255, "receiverName": 100, "receiverPhone": 50,
    "skuCode": 255, "skuName": 255, "skuSpec": 255,
}

# A decimal number of any length, or NaN; the store keeps its text next to the decimal.
NUMBER = r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[nN][aA][nN])\z"


def _quantity() -> Column:
    """The quantity as text, absent ones 0."""
    return trim(F.coalesce(F.col("skuQuantity"), F.lit("0")))


def accept_reject(records: DataFrame) -> DataFrame:
    """Adds `rejected`, the first store rule a record breaks; NULL for records that load."""
    reason = F.when(F.lit(False), F.lit(""))
    for f, width in WIDTHS.items():
        reason = reason.when(F.length(text_or_empty(F.col(f))) > width, F.lit(f"{f} is longer than {width}"))
    reason = reason.when(~_quantity().rlike(NUMBER), F.lit("skuQuantity is not a number"))
    return records.withColumn("rejected", reason)


def order_id(batch: str, keys: list[str]) -> Column:
    """Id of the order of a record: the same record of the same batch always gets the same id."""
    return F.sha2(F.concat_ws("/", F.col(batch), *[text_or_empty(F.col(k).cast("string")) for k in keys]), 256)


def split_orders_items(records: DataFrame, keys: list[str], batch: str = "batch_id", created_at: str = "created_at"):
    """One order and one item per record; returns both tables. Absent text is '', absent quantity 0.

    sku_quantity_text is the exact quantity; sku_quantity is NULL for one beyond 20 digits before the
    point, and rounded to 18 after it. created_day goes along where records have it.
    """
    rows = records.withColumn("_id", order_id(batch, keys))
    laid = [c for c in ("created_day",) if c in records.columns]
    orders = rows.select(
        F.col("_id").alias("id"),
        *[text_or_empty(F.col(f)).alias(n) for n, f in {
            "external_code": "externalCode", "store_name": "storeName", "receiver_name": "receiverName",
            "receiver_phone": "receiverPhone", "receiver_address": "receiverAddress", "remark": "remark",
        }.items()],
        F.col(batch).alias("batch_id"), F.col(created_at).alias("created_at"), *laid,
    )
    items = rows.select(
        F.sha2(F.concat("_id", F.lit("/item")), 256).alias("id"), F.col("_id").alias("order_id"),
        text_or_empty(F.col("skuCode")).alias("sku_code"), text_or_empty(F.col("skuName")).alias("sku_name"),
        _quantity().try_cast(QUANTITY).alias("sku_quantity"), _quantity().alias("sku_quantity_text"), text_or_empty(F.col("skuSpec")).alias("sku_spec"),
        F.col(batch).alias("batch_id"), F.col(created_at).alias("created_at"), *laid,
    )
    return orders, items


def batch_summary(checked: DataFrame, batch: str = "batch_id", created_at: str | None = None) -> DataFrame:
    """Counts and status of each batch, and its first time if asked for. With a column `errors`, a batch that has any is refused whole."""
    errors = F.sum("errors") if "errors" in checked.columns else F.lit(0)
    counts = checked.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("rejected").isNull()).alias("success_count"),
        errors.cast("bigint").alias("error_count"),
        *([F.when(F.col(batch).isNotNull(), F.min(created_at)).alias("created_at")] if created_at else []),
    )
    refused = F.col("error_count") > 0
    success = F.when(refused, F.lit(0).cast("bigint")).otherwise(F.col("success_count"))
    return counts.select(
        batch, "total_count", success.alias("success_count"), (F.col("total_count") - success).alias("fail_count"), "error_count",
        F.when(refused, "refused").when(F.col("total_count") > F.col("success_count"), "partial").otherwise("completed").alias("status"),
        *(["created_at"] if created_at else []),
    )


def import_job(
    records: DataFrame, keys: list[str], path: str, batch: str = "batch_id", created_at: str = "created_at",
    faults: DataFrame | None = None,
) -> DataFrame:
    """Validate, load the batches without errors, and return one summary row for every batch.

    `faults` are errors found before, as (batch, position, message); a batch that has one is refused
    too, also when it has no records. Orders and items of accepted records, rejected records, the errors
    of refused batches and the summary are written to the store; the summary last, which publishes them.
    The records are checked once and written with what was found; all tables are made from that copy, whose disk
    is given back in the end. Records of a few days are written to the store by the tasks that read them; others are
    laid by day before ids, which are longer than most records, are made.
    """
    with shuffles_released(records.sparkSession):
        return _loaded(records, keys, path, batch, created_at, faults)


def _loaded(records: DataFrame, keys: list[str], path: str, batch: str, created_at: str, faults: DataFrame | None) -> DataFrame:
    spark = records.sparkSession
    staged, attempt = shared_folder(spark, "checked-records"), new_attempt()
    codec = {"compression": CODEC}
    validated = validate_records(records)
    accept_reject(validated.withColumns({"_messages": F.when(F.size("errors") > 0, F.col("errors")), "errors": F.size("errors")})).write.options(**codec).parquet(staged)
    checked = spark.read.parquet(staged)
    day = F.to_date(created_at)
    few = checked.select(day).distinct().limit(FEW_DAYS + 1).count() <= FEW_DAYS
    place = F.concat_ws("/", *[text_or_empty(F.col(k).cast("string")) for k in keys])
    found = checked.filter(F.col("errors") > 0).select(batch, place.alias("position"), F.explode("_messages").alias("field", "message"))
    summary = batch_summary(checked, batch, created_at)
    if faults is not None:
        before = faults.select(F.col(batch), F.col("position").cast("string").alias("position"), F.lit(None).cast("string").alias("field"), "message")
        found = found.unionByName(before)
        extra = before.groupBy(batch).agg(F.count(F.lit(1)).alias("_faults"))
        total = F.coalesce("total_count", F.lit(0)).cast("bigint")
        hit = F.col("_faults").isNotNull()
        summary = summary.join(extra, batch, "full").select(
            batch, total.alias("total_count"), F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("success_count")).alias("success_count"),
            F.when(hit, total).otherwise(F.col("fail_count")).alias("fail_count"),
            (F.coalesce("error_count", F.lit(0)) + F.coalesce("_faults", F.lit(0))).cast("bigint").alias("error_count"),
            F.when(hit, "refused").otherwise(F.col("status")).alias("status"), "created_at")
    folder = shared_folder(spark, "batch-summary")
    summary.write.parquet(folder)
    summary = spark.read.schema(summary.schema).parquet(folder)
    refused = summary.filter("status = 'refused' AND total_count > 0").select(batch)  # others have no records
    ready = checked.filter(F.col(batch).isNotNull()).join(counted_side(refused, refused.count()), batch, "left_anti").drop("errors", "_messages")
    fields = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    rejects = ready.filter(F.col("rejected").isNotNull()).select(F.col(batch).alias("batch_id"), place.alias("position"), F.col("rejected").alias("reason"), fields.alias("record"))
    append(rejects, path, "rejected_records", attempt)
    append(found.withColumnRenamed(batch, "batch_id"), path, "import_errors", attempt)
    accepted = ready.filter(F.col("rejected").isNull()).withColumn("created_day", day)
    orders, items = split_orders_items(accepted if few else accepted.hint("rebalance", "created_day"), keys, batch, created_at)
    write_orders(orders, items, path, summary.withColumnRenamed(batch, "batch_id"), attempt)
    emptied(spark, staged)
    return summary.drop("created_at")
