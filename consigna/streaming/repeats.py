"""Codes that come again in a stream: flagged, never dropped, across micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from consigna.functions.text import text_or_empty, trim
from consigna.session import ship
from consigna.sources.store import SCHEMAS, orders_scan, read_table

#: Groups that all rows which have their answer are dealt to; they only pass through, batch by batch.
SPOTS = 64
FLAGGED = "code STRING, id STRING, seen_at TIMESTAMP, attempt STRING, repeated BOOLEAN"


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks rows whose code has an earlier row with another id in the same batch of rows.

    They are repeats whatever was seen before, so only the first row of a code has to ask the state; a code
    that fills a micro-batch does not bring all its rows to one task.
    """
    for rows in batches:
        rows = rows.sort_values(["seen_at", "id"], kind="stable")
        first = rows.groupby("code", sort=False)["id"].transform("first")
        rows["sure"] = (rows["id"] != first) & (rows["code"] != "")
        # One of a few spots for rows that have their answer, by their id, whatever their code; one group for each code that has to ask.
        known = rows["sure"] | (rows["code"] == "")
        spots = (pd.util.hash_array(rows["id"].to_numpy(dtype=object)) % SPOTS).astype(str)
        rows["spot"] = pd.Series(spots, index=rows.index).where(known, "")
        rows["asks"] = rows["code"].mask(known, "")
        yield rows


def _ask(retention_ms: int):
    def ask(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        code, spot = key
        if state.hasTimedOut:
            state.remove()
            return
        if spot:
            for rows in batches:
                yield rows[["code", "id", "seen_at", "attempt"]].assign(repeated=rows["sure"])
            return
        rows = pd.concat(list(batches)).sort_values(["seen_at", "id"], kind="stable")
        first, last = state.get if state.exists else (rows["id"].iloc[0], 0)
        last = max(last, int(rows["seen_at"].max().timestamp() * 1000))
        state.update((first, last))
        state.setTimeoutTimestamp(max(last + retention_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"code": code, "id": rows["id"], "seen_at": rows["seen_at"], "attempt": rows["attempt"], "repeated": rows["id"] != first})

    return ask


def flag_repeats(records: DataFrame, retention_days: float = 30, late: str = "1 day") -> DataFrame:
    """Rows (code, id, seen_at, attempt) of a stream with `repeated`: whether the code came before with another id.

    The first row of a code, by time and then id, is not repeated; the same id again is not either, so a
    batch that is loaded again does not repeat itself. Blank codes are never repeated. The state holds one id
    for each code, in Spark's state store, until the watermark passes its last row by the retention; a code
    that comes after that is new. `late` is how far rows may come behind the latest time; rows that are later
    get no flag.
    """
    rows = records.select(
        trim(text_or_empty(F.col("code"))).alias("code"), F.col("id").cast("string").alias("id"), F.col("seen_at").cast("timestamp").alias("seen_at"),
        F.col("attempt").cast("string").alias("attempt")).where("seen_at IS NOT NULL AND id IS NOT NULL")
    rows = rows.mapInPandas(_thin, "code STRING, id STRING, seen_at TIMESTAMP, attempt STRING, sure BOOLEAN, spot STRING, asks STRING")
    return rows.withWatermark("seen_at", late).groupBy("asks", "spot").applyInPandasWithState(
        _ask(int(retention_days * 86_400_000)), FLAGGED, "first STRING, last LONG", "append", GroupStateTimeout.EventTimeTimeout)


def watch_repeats(
    spark: SparkSession, path: str, checkpoint: str, retention_days: float = 30, late: str = "1 day", once: bool = False, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Follow the orders of a store as they are loaded and write their flags to its table `order_repeats`.

    Each micro-batch is a folder named by its number, written whole, so one that is run again after a crash
    replaces itself.
    """
    ship(spark)
    orders = spark.readStream.schema(SCHEMAS["orders"]).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/orders")
    flags = flag_repeats(orders.select(F.col("external_code").alias("code"), "id", F.col("created_at").alias("seen_at"), "attempt"), retention_days, late)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/order_repeats/epoch={epoch}")

    writer = flags.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def repeated_orders(spark: SparkSession, path: str) -> DataFrame:
    """id and code of the orders that readers of the store see and whose code came before.

    An order that is loaded again with its code keeps its flag, also when that load is too late for the state.
    """
    flags = read_table(spark, path, "order_repeats").where("repeated").select("id", "code").distinct()
    orders = orders_scan(spark, path).select("id", trim(text_or_empty(F.col("external_code"))).alias("code")).distinct()
    return flags.join(orders, ["id", "code"], "left_semi")
