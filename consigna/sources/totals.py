"""Counts over the whole order store, from what each load has counted.

A load's partial counts carry its attempt. Those of attempts that readers no longer see fall out of the sum,
so a load that replaces or refuses another needs no correction; loads without counts are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consigna.sources.index import _indexed, _rest, field_rows
from consigna.sources.store import published, read_table

LOAD = ["batch_id", "attempt"]


def _total(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))


def _inside(time: Column, since: Column | None, until: Column | None) -> Column:
    cond = F.lit(True)
    if since is not None:
        cond = cond & (time >= since)
    if until is not None:
        cond = cond & (time < until)
    return cond


def stored_orders_count(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """total: the orders of since <= created_at < until, each bound optional; without any, all orders.

    Whole hours are added up from order_hours. Orders are only read for the part of an hour at each bound,
    from the days of the bounds, and for loads that are not indexed. Orders without a time count when
    there is no bound. An empty store, or a range that ends before it starts, gives 0.
    """
    since, until = (None if x is None else F.lit(x).cast("timestamp") for x in (since, until))
    hour, time = F.col("hour"), F.col("created_at")
    counted, range_ = F.col("orders").alias("n"), _inside(time, since, until)
    new = _rest(spark, path, "orders").where(range_).agg(F.count(F.lit(1)).alias("n"))
    hours = _indexed(spark, path, "order_hours")
    if since is None and until is None:
        return _total(hours.select(counted), new)
    first = last = None
    edge, days = F.lit(False), []
    if since is not None:
        floor = F.date_trunc("hour", since)
        first = F.when(floor < since, floor + F.expr("INTERVAL 1 HOUR")).otherwise(floor)
        edge, days = edge | (time < first), [F.to_date(since), F.to_date(first)]
    if until is not None:
        last = F.date_trunc("hour", until)
        edge, days = edge | (time >= last), [*days, F.to_date(until)]
    known = _indexed(spark, path, "order_hours").select(*LOAD).distinct()
    cut = read_table(spark, path, "orders").where(F.col("created_day").isin(days) & range_ & edge).join(known, LOAD, "left_semi")
    return _total(hours.where(_inside(hour, first, last)).select(counted), cut.agg(F.count(F.lit(1)).alias("n")), new)


def stored_field_coverage(spark: SparkSession, path: str) -> DataFrame:
    """field, filled, total, percent: how many orders (or items, for their fields) have a value.

    A field of a table without rows is not there. Loads indexed before order_fields was kept are scanned.
    """
    kept = _indexed(spark, path, "order_fields")
    rest = published(spark, path).where("status <> 'refused'").select(*LOAD).join(kept.select(*LOAD).distinct(), LOAD, "left_anti")
    orders, items = (read_table(spark, path, t).join(rest, LOAD, "left_semi") for t in ("orders", "order_items"))
    parts = kept.select("field", "filled", "total").unionByName(field_rows(orders, items).select("field", "filled", "total"))
    sums = parts.groupBy("field").agg(F.sum("filled").alias("filled"), F.sum("total").alias("total"))
    return sums.select("field", "filled", "total", F.round(F.col("filled") * 100.0 / F.col("total")).cast("bigint").alias("percent"))
