"""Queries on the order store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import text_or_empty, trim
from consigna.operators.skew import join_children, number_rows

ORDER_COLUMNS = {
    "externalCode": "external_code", "storeName": "store_name", "receiverName": "receiver_name",
    "receiverPhone": "receiver_phone", "receiverAddress": "receiver_address", "remark": "remark",
}
ITEM_COLUMNS = {
    "skuCode": "sku_code", "skuName": "sku_name", "skuQuantity": "sku_quantity", "skuSpec": "sku_spec",
}

# Largest page set (page × page size) that is broadcast; deeper pages shuffle.
BROADCAST_PAGE = 100_000


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _newest(created: str, *ids: str) -> list[Column]:
    return [F.col(created).desc_nulls_first(), *[F.col(i) for i in ids]]


def _like(c: Column, part: str) -> Column:
    """Contains, with % and _ as wild cards and a backslash before a literal one."""
    pattern, i = "", 0
    while i < len(part):
        if part[i] == "\\" and part[i + 1:i + 2] not in ("%", "_", "\\", ""):
            i += 1
        step = 2 if part[i] == "\\" else 1
        pattern += part[i:i + step]
        i += step
    return c.like(f"%{pattern}%")


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(1, page), max(1, min(100, size))


def filter_orders(
    orders: DataFrame, external_code: str = "", receiver_name: str = "", start: str = "", end: str = ""
) -> DataFrame:
    """Orders that meet all given conditions; the end day counts as a whole, next midnight included."""
    kind = orders.schema["created_at"].dataType
    if external_code:
        orders = orders.filter(_like(F.col("external_code"), external_code))
    if receiver_name:
        orders = orders.filter(_like(F.col("receiver_name"), receiver_name))
    if start:
        since = F.lit(start).cast(kind)
        orders = _day_range(orders, since=since).filter(F.col("created_at") >= since)
    if end:
        until = F.lit(end).cast(kind) + F.expr("INTERVAL 1 DAY")
        orders = _day_range(orders, until=until).filter(F.col("created_at") <= until)
    return orders


def orders_with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item, one row for an order without items."""
    children = items.select(
        F.col("order_id").alias("orderId"), F.col("id").alias("itemId"),
        *[F.col(c).alias(n) for n, c in ITEM_COLUMNS.items()],
    )
    parents = orders.select(
        F.col("id").alias("orderId"), *[F.col(c).alias(n) for n, c in ORDER_COLUMNS.items()], "created_at"
    )
    return join_children(parents, children, "orderId")


def orders_count(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("total"))


def orders_count_distinct(orders: DataFrame) -> DataFrame:
    return orders.agg(F.countDistinct("id").alias("total"))


def _first_orders(orders: DataFrame, k: int) -> DataFrame:
    return orders.orderBy(*_newest("created_at", "id")).limit(k)


def _few(df: DataFrame, k: int) -> DataFrame:
    return F.broadcast(df) if k <= BROADCAST_PAGE else df


def orders_search(orders: DataFrame, items: DataFrame, page: int = 1, page_size: int = 10, **conditions: str) -> DataFrame:
    """One page of joined rows, newest orders first.

    Each order gives at least one row, so page p of size s lies in the first p × s orders and in
    their first p × s items. Both are taken before anything is joined; no join sees the full store.
    """
    page, page_size = clamp_page(page, page_size)
    k = page * page_size
    first = _first_orders(filter_orders(orders, **conditions), k)
    day = _day_key(first, items)
    hits = (
        items.select(F.col("id").alias("item_id"), "order_id", *ITEM_COLUMNS.values(), *day)
        .join(_few(first.select(F.col("id").alias("order_id"), "created_at", *day), k), ["order_id", *day])
        .orderBy(*_newest("created_at", "order_id", "item_id")).limit(k)
        .drop("created_at", *day)
    )
    return (
        first.join(_few(hits, k), first["id"] == hits["order_id"], "left")
        .select(
            F.col("id").alias("orderId"), *[F.col(c).alias(n) for n, c in ORDER_COLUMNS.items()],
            first["created_at"].alias("created_at"), "item_id",
            *[F.col(c).alias(n) for n, c in ITEM_COLUMNS.items()],
        )
        .orderBy(*_newest("created_at", "orderId", "item_id"))
        .offset(k - page_size).limit(page_size)
        .select("orderId", *ORDER_COLUMNS, _iso(F.col("created_at")).alias("createdAt"), *ITEM_COLUMNS)
    )


def page_of(orders: DataFrame, items: DataFrame, skip: int, page_size: int) -> DataFrame:
    """Joined rows skip + 1 .. skip + page_size of some orders and their items, newest orders first."""
    own = items.select(F.col("id").alias("item_id"), "order_id", *ITEM_COLUMNS.values())
    return (
        orders.join(own, orders["id"] == own["order_id"], "left")
        .select(
            F.col("id").alias("orderId"), *[F.col(c).alias(n) for n, c in ORDER_COLUMNS.items()], "created_at", "item_id",
            *[F.col(c).alias(n) for n, c in ITEM_COLUMNS.items()])
        .orderBy(*_newest("created_at", "orderId", "item_id")).offset(skip).limit(page_size)
        .select("orderId", *ORDER_COLUMNS, _iso(F.col("created_at")).alias("createdAt"), *ITEM_COLUMNS)
    )


def _day_key(orders: DataFrame, items: DataFrame) -> list[str]:
    """The partition column, where both tables have it: an item lies in the day of its order, so days of no order are not read."""
    return [c for c in ("created_day",) if c in orders.columns and c in items.columns]


def items_nested(items: DataFrame, block: list[Column] | None = None) -> DataFrame:
    """Items of each order in id order, as rows: order_id, position (from 1) and the item's fields.

    Rows put together by position are the order's list. `block` cuts an order's items into runs along
    the id, by default by the first characters of the hexadecimal ids, so an order of any size is
    numbered by many tasks.
    """
    numbered = number_rows(items, ["order_id"], block or [F.substring("id", 1, 3)], [F.col("id")], "position")
    return numbered.select("order_id", F.col("position").cast("bigint").alias("position"), *[F.col(c).alias(n) for n, c in ITEM_COLUMNS.items()])


def _with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Each order with one list of its items in id order; the answer has the list as one value."""
    item = F.struct("id", *[F.col(c).alias(n) for n, c in ITEM_COLUMNS.items()])
    nested = items.groupBy("order_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    nested = nested.select("order_id", F.transform("_items", lambda i: i.dropFields("id")).alias("items"))
    struct = nested.schema["items"].dataType.simpleString()
    return (
        orders.join(nested, orders["id"] == nested["order_id"], "left")
        .select(
            F.col("id").alias("orderId"), *[F.col(c).alias(n) for n, c in ORDER_COLUMNS.items()],
            _iso(F.col("created_at")).alias("createdAt"), F.lit(None).cast("double").alias("amount"),
            F.coalesce("items", F.array().cast(struct)).alias("items"),
        )
    )


def _day_range(orders: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The same orders; on a stored table the partitions of other days are not read."""
    if "created_day" in orders.columns:
        if since is not None:
            orders = orders.filter(F.col("created_day") >= F.to_date(since))
        if until is not None:
            orders = orders.filter(F.col("created_day") <= F.to_date(until))
    return orders


def orders_sync(
    orders: DataFrame, items: DataFrame, updated_after: str | None = None, page: int = 1, page_size: int = 50,
    after: tuple[str, str] | None = None,
) -> DataFrame:
    """One page of orders changed since a time, with nested items.

    The page is taken on orders first; items only meet the page. With `after`, the (created_at, id) of
    the last order seen, the page starts behind it and its number is not used: no deep page is sorted.
    """
    page, page_size = clamp_page(page, page_size)
    kind = orders.schema["created_at"].dataType
    if updated_after:
        since = F.lit(updated_after).cast(kind)
        orders = _day_range(orders, since=since).filter(F.col("created_at") >= since)
    skip = (page - 1) * page_size
    if after:
        at = F.lit(after[0]).cast(kind)
        orders = _day_range(orders, until=at).filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > after[1])))
        skip = 0
    chosen = orders.orderBy(*_newest("created_at", "id")).offset(skip).limit(page_size)
    day = _day_key(chosen, items)
    own = items.join(F.broadcast(chosen.select(F.col("id").alias("order_id"), *day)), ["order_id", *day], "left_semi")
    return _with_items(chosen, own)


def first_order_of_code(orders: DataFrame) -> DataFrame:
    """One order per code: the oldest, then the smallest id."""
    columns = [c for c in orders.columns if c != "external_code"]
    return (
        orders.groupBy("external_code")
        .agg(F.min_by(F.struct(*columns), F.struct("created_at", "id")).alias("_o"))
        .select("external_code", "_o.*")
    )


def order_detail(codes: DataFrame, orders: DataFrame, items: DataFrame, code: str = "code") -> DataFrame:
    """Order and nested items of each asked code, with a status for codes that have none."""
    asked = codes.select(trim(F.col(code)).alias("code")).distinct()
    wanted = orders.join(asked.select(F.col("code").alias("external_code")), "external_code", "left_semi")
    chosen = first_order_of_code(wanted)
    # Items are joined by order alone, so that the joins and the lists read one exchange of them.
    own = items.join(chosen.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    found = _with_items(chosen, own)
    found = found.select(F.col("externalCode").alias("code"), *found.columns)
    # Codes without an order are told before items come in, so that found orders are not moved back to their codes.
    without = asked.join(wanted.select(F.col("external_code").alias("code")), "code", "left_anti")
    without = without.select("code", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields[1:]])
    status = (
        F.when(text_or_empty(F.col("code")) == "", "invalid_external_code")
        .when(F.col("orderId").isNull(), "order_not_found").otherwise("found")
    )
    return found.unionByName(without).withColumn("status", status)


def sku_in_order(
    pairs: DataFrame, orders: DataFrame, items: DataFrame, code: str = "externalCode", sku: str = "skuCode", details: bool = True,
) -> DataFrame:
    """Whether each (code, sku) pair is in the store, with the first order and item that has it.

    Without details only the status is told: of orders and items no more than their keys is moved.
    """
    asked = pairs.select(
        trim(text_or_empty(F.col(code))).alias("code"), trim(text_or_empty(F.col(sku))).alias("sku")
    ).distinct()
    codes = asked.select(F.col("code").alias("external_code")).distinct()
    known = orders.join(codes, "external_code", "left_semi")
    wanted = items.select(F.col("id").alias("item_id"), "order_id", *ITEM_COLUMNS.values())
    rows = known.join(wanted, known["id"] == F.col("order_id"))
    info = ["store_name", "receiver_name", "sku_name", "sku_quantity", "sku_spec"]
    hits = rows.groupBy(F.col("external_code").alias("code"), F.col("sku_code").alias("sku"))
    first = hits.agg((F.min(F.struct("created_at", "id", "item_id", *info)) if details else F.lit(True)).alias("_hit"))
    have = known.groupBy(F.col("external_code").alias("code")).agg(F.lit(True).alias("_known"))
    status = (
        F.when((F.col("code") == "") | (F.col("sku") == ""), "invalid_payload")
        .when(F.col("_hit").isNotNull(), "valid")
        .when(F.col("_known"), "sku_not_in_order").otherwise("order_not_found")
    )
    hit = {
        "orderId": "id", "storeName": "store_name", "receiverName": "receiver_name",
        "skuName": "sku_name", "skuQuantity": "sku_quantity", "skuSpec": "sku_spec",
    }
    return (
        asked.join(have, "code", "left").join(first, ["code", "sku"], "left")
        .withColumn("status", status)
        .select("code", "sku", "status", *[
            F.when(F.col("status") == "valid", F.col("_hit")[c]).alias(n) for n, c in hit.items() if details
        ])
    )


def marker_existence(markers: DataFrame, orders: DataFrame, code: str = "externalCode") -> DataFrame:
    """Which exception markers are accepted: those whose trimmed code has an order."""
    known = orders.select(F.col("external_code").alias("_code")).distinct().withColumn("_known", F.lit(True))
    trimmed = markers.withColumn("_code", trim(text_or_empty(F.col(code))))
    return (
        trimmed.join(known, "_code", "left")
        .withColumn("status", F.when(F.col("_code") == "", "invalid_external_code")
                    .when(F.col("_known"), "accepted").otherwise("order_not_found"))
        .drop("_code", "_known")
    )
