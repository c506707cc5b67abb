"""The order store as Parquet tables.

A load writes its rows under a new attempt and then publishes one row per batch that names the attempt.
Readers only see published attempts, of each batch the last one, so a load that was interrupted, or run
again with fewer rows, leaves nothing behind that anyone reads.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consigna.functions.text import text_or_empty
from consigna.schema import EXPORT_LABELS

QUANTITY = "decimal(38,18)"
#: Of the store's files: ids are hexadecimal digests, which need entropy coding to get smaller.
CODEC = "zstd"
#: Names of batches up to which they are broadcast. Spark would choose by the bytes of their files, where they are far smaller.
FEW_BATCHES = 100_000

# Tables are partitioned by day alone: a day holds many batches, a batch is found by its column.
SCHEMAS = {
    "orders": (
        "id STRING, external_code STRING, store_name STRING, receiver_name STRING, receiver_phone STRING, "
        "receiver_address STRING, remark STRING, batch_id STRING, created_at TIMESTAMP, attempt STRING, created_day DATE"),
    "order_items": (
        f"id STRING, order_id STRING, sku_code STRING, sku_name STRING, sku_quantity {QUANTITY}, sku_quantity_text STRING, "
        "sku_spec STRING, batch_id STRING, created_at TIMESTAMP, attempt STRING, created_day DATE"),
    "import_batches": (
        "batch_id STRING, total_count BIGINT, success_count BIGINT, fail_count BIGINT, error_count BIGINT, status STRING, "
        "created_at TIMESTAMP, attempt STRING"),
    "rejected_records": "batch_id STRING, position STRING, reason STRING, record STRING, attempt STRING",
    "import_errors": "batch_id STRING, position STRING, field STRING, message STRING, attempt STRING",
    # Look-up tables, see sources/index.py; a run that did not end is not in index_runs and is not read.
    # A run indexes one attempt of a batch, which index_runs names, so the two large tables need not.
    "order_codes": "code STRING, order_id STRING, batch_id STRING, created_at TIMESTAMP, run STRING, bucket INT",
    "order_grams": "order_id STRING, batch_id STRING, day DATE, field STRING, gram STRING, run STRING, bucket INT",
    "order_hours": "batch_id STRING, hour TIMESTAMP, orders BIGINT, rows BIGINT, attempt STRING, run STRING",
    "order_fields": "batch_id STRING, field STRING, filled BIGINT, total BIGINT, attempt STRING, run STRING",
    "index_runs": "batch_id STRING, attempt STRING, run STRING",
    "order_repeats": "code STRING, id STRING, seen_at TIMESTAMP, attempt STRING, repeated BOOLEAN, epoch INT",
}


def new_attempt() -> str:
    """A name for one load; later loads have greater names."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its schema; one that was never written has no rows."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def counted_side(batches: DataFrame, n: int) -> DataFrame:
    """The right side of a join, n batches: broadcast if few, else met by a shuffle, however small their files are."""
    return F.broadcast(batches) if n <= FEW_BATCHES else batches.hint("shuffle_hash")


def _many(batches: DataFrame) -> bool:
    return batches.count() > FEW_BATCHES


def published(spark: SparkSession, path: str) -> DataFrame:
    """What readers see of each batch, as summary rows: its last attempt that was not refused, and a later refusal.

    A batch that is loaded again and refused keeps the orders it had; the refusal is a row of its own.
    """
    rows = read_table(spark, path, "import_batches")
    good = F.max(F.when(F.col("status") != "refused", F.col("attempt"))).alias("good")
    last = rows.groupBy(F.col("batch_id").alias("b")).agg(good, F.max("attempt").alias("last"))
    last = last.hint("shuffle_hash") if _many(rows) else last
    return rows.join(last, (F.col("batch_id") == F.col("b")) & ((F.col("attempt") == F.col("good")) | (F.col("attempt") == F.col("last"))), "left_semi")


def _visible(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a table that readers see.

    With many batches, those whose rows are not seen are looked for first, in two columns of the table; there are
    none or few unless much was loaded again, so the rows are not shuffled for them.
    """
    at = ["batch_id", "attempt"]
    rows, seen = read_table(spark, path, name), published(spark, path).select(*at)
    if not _many(read_table(spark, path, "import_batches")):
        return rows.join(seen, at, "left_semi")
    seen, named = seen.hint("shuffle_hash"), rows.dropna(subset=at)
    hidden = named.select(*at).distinct().join(seen, at, "left_anti")
    n = hidden.limit(FEW_BATCHES + 1).count()
    if n > FEW_BATCHES:
        return rows.join(seen, at, "left_semi")
    return named.join(F.broadcast(hidden), at, "left_anti") if n else named


def _days(df: DataFrame, since, until) -> DataFrame:
    if since is not None:
        df = df.filter(F.col("created_day") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.filter(F.col("created_day") <= F.lit(until).cast("date"))
    return df


def orders_scan(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Orders of a day range; the day is the partition column, so other days are not read."""
    return _days(_visible(spark, path, "orders"), since, until).drop("attempt")


def items_scan(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Items of the orders of a day range; other days are not read."""
    return _days(_visible(spark, path, "order_items"), since, until).drop("attempt")


def import_batches(spark: SparkSession, path: str) -> DataFrame:
    """The load of each batch that readers see, and its refusal if that came later."""
    return published(spark, path).drop("attempt")


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """Records that broke a rule of the store, as JSON, with their position and the reason."""
    return _visible(spark, path, "rejected_records").drop("attempt")


def import_errors(spark: SparkSession, path: str) -> DataFrame:
    """Validation and parse errors of refused batches; a parse error has no field."""
    return _visible(spark, path, "import_errors").drop("attempt")


def export_records(records: DataFrame) -> DataFrame:
    """The ten fields under their sheet labels, absent ones empty."""
    return records.select(*[text_or_empty(F.col(f)).alias(label) for f, label in EXPORT_LABELS.items()])


def write_export(records: DataFrame, path: str) -> None:
    export_records(records).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def with_day(rows: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Rows with the partition column of the store."""
    return rows.withColumn("created_day", F.to_date(created_at))


def by_day(rows: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Rows shuffled so that few tasks write a day, a large day being split.

    append does this itself for rows without created_day. Rows that are narrow now and wide once their columns are
    derived are better laid by day before that.
    """
    return with_day(rows, created_at).hint("rebalance", "created_day")


def append(df: DataFrame, path: str, name: str, attempt: str) -> None:
    """Rows of one attempt, in the table's schema; columns the table lacks are left out.

    Rows with created_day are written by the tasks that have them, see by_day. What is the same in all rows is
    added behind the shuffle.
    """
    days = "created_day" in SCHEMAS[name]
    if days and "created_day" not in df.columns:
        df = by_day(df)
    want = [f.split() for f in SCHEMAS[name].split(", ")]
    df = df.withColumn("attempt", F.lit(attempt))
    df = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in want])
    writer = df.write.mode("append").option("compression", CODEC)
    (writer.partitionBy("created_day") if days else writer).parquet(f"{path}/{name}")


def write_orders(orders: DataFrame, items: DataFrame, path: str, summary: DataFrame | None = None, attempt: str | None = None) -> None:
    """Write batches and publish them; a batch written again replaces its earlier rows.

    `summary` is the row of each batch to publish; without it the orders are counted. Nothing of this
    load is read before its last write, that of the summary.
    """
    attempt = attempt or new_attempt()
    append(orders, path, "orders", attempt)
    append(items, path, "order_items", attempt)
    publish(counted(orders) if summary is None else summary, path, attempt)


def counted(orders: DataFrame) -> DataFrame:
    """The row to publish for each batch of orders that are all loaded."""
    n = F.count(F.lit(1))
    return orders.groupBy("batch_id").agg(n.alias("total_count"), n.alias("success_count"), F.min("created_at").alias("created_at")).withColumns({
        "fail_count": F.lit(0), "error_count": F.lit(0), "status": F.lit("completed")})


def publish(summary: DataFrame, path: str, attempt: str) -> None:
    """Let readers see the batches of a summary as an attempt wrote them; batches it leaves out stay unseen."""
    append(summary, path, "import_batches", attempt)
