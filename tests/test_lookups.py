"""The store's look-up tables, refused loads, and codes that come again in a stream."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from consigna.operators import load, query
from consigna.session import shared_folder
from consigna.sources import index, store, totals
from consigna.streaming.repeats import repeated_orders, watch_repeats

T0 = datetime.datetime(2024, 3, 1)


def tables(spark, rows, batch="b", items=2):
    """rows: (id, code, receiver, created_at); every third order has no items."""
    orders = spark.createDataFrame(
        [(i, c, "", r, "", "", "", batch, t) for i, c, r, t in rows],
        "id string, external_code string, store_name string, receiver_name string, receiver_phone string, receiver_address string, remark string, batch_id string, created_at timestamp")
    lines = [(f"{i}-{k}", i, f"sku{k}", "n", "1", "s", batch, t) for n, (i, _, _, t) in enumerate(rows) if n % 3 for k in range(items)]
    return orders, spark.createDataFrame(lines, "id string, order_id string, sku_code string, sku_name string, sku_quantity_text string, sku_spec string, batch_id string, created_at timestamp")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    return [(f"o{i:04d}", f"ORD_{rnd.randrange(5000):05d}" + rnd.choice(["", "%", "\\", " Ä"]), "".join(rnd.choices("abc é", k=rnd.randrange(9))),
             T0 + datetime.timedelta(hours=rnd.randrange(24 * 12))) for i in range(600)]


@pytest.fixture(scope="module")
def path(spark, rows):
    """Two thirds of the orders are indexed, the last load is not."""
    path = shared_folder(spark, "lookup-store")
    for k in range(2):
        store.write_orders(*tables(spark, rows[k * 200:(k + 1) * 200], f"b{k}"), path)
        assert index.index_store(spark, path) == 1
    assert index.index_store(spark, path) == 0
    store.write_orders(*tables(spark, rows[400:], "b2"), path)
    return path


def plain(df):
    return sorted(map(repr, df.collect()))


def test_codes(spark, path, rows, monkeypatch):
    asked = spark.createDataFrame([(f" {rows[i][1]} ",) for i in (0, 3, 250, 401, 599)] + [("none",), (" ",), (None,)], "externalCode string")
    codes = asked.withColumnRenamed("externalCode", "code")
    orders, items = store.orders_scan(spark, path), store.items_scan(spark, path)
    for most in (1000, 2):  # named in filters, and joined
        monkeypatch.setattr(index, "MAX_CODES", most)
        assert plain(index.stored_order_detail(spark, path, codes)) == plain(query.order_detail(codes, orders, items))
        assert plain(index.stored_marker_existence(spark, path, asked)) == plain(query.marker_existence(asked, orders))
        pairs = asked.withColumn("skuCode", F.lit("sku1"))
        assert plain(index.stored_sku_in_order(spark, path, pairs)) == plain(query.sku_in_order(pairs, orders, items.drop("created_day")))
        assert {r.externalCode for r in index.stored_dup_vs_store(spark, path, asked).where("in_store").collect()} == {f" {rows[i][1]} " for i in (0, 3, 250, 401, 599)}


def test_few_days_are_read(spark, path, rows):
    found = index.stored_orders_of_codes(spark, path, spark.createDataFrame([(rows[0][1],)], "code string"))
    days = {t.date() for _, c, _, t in rows if c.strip() == rows[0][1].strip()}
    assert set(found.days) == days and len(days) < 4
    for df in (found.orders(), found.items()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
        assert any("created_day" in f for f in filters)
    codes = index._codes(spark, path, spark.createDataFrame([(rows[0][1],)], "code string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", codes) and re.search(r"PushedFilters: \[[^\]]*code", codes)


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_the_scan(spark, path, rows, seed):
    rnd = random.Random(seed)
    orders, items = store.orders_scan(spark, path), store.items_scan(spark, path)
    used = 0
    for k in range(6):
        _, code, receiver, _ = rnd.choice(rows)
        part = code[(a := rnd.randrange(6)):a + rnd.randrange(2, 8)]
        if rnd.random() < 0.3 and len(part) > 4:
            part = part[:3] + rnd.choice("%_") + part[4:]
        how = {"external_code": part, "receiver_name": rnd.choice(["", receiver[:3], "zzz"]), "page": rnd.randrange(1, 3), "page_size": 7}
        used += bool(index.pattern_grams(part))
        assert plain(index.stored_search(spark, path, **how)) == plain(query.orders_search(orders, items, **how)), how
    assert used


def test_pattern_grams():
    assert index.pattern_grams("abcd") == ["abc", "bcd"]
    assert index.pattern_grams("ab%cd_efg") == ["efg"]
    assert index.pattern_grams(r"a\%b\_c\\d") == sorted({"a%b", "%b_", "b_c", "_c\\", "c\\d"})
    assert index.pattern_grams("ab") == [] == index.pattern_grams("%_")


def test_page_by_place(spark, rows):
    path = shared_folder(spark, "page-store")
    for k in range(3):
        store.write_orders(*tables(spark, rows[k * 200:(k + 1) * 200], f"b{k}"), path)
    store.write_orders(*tables(spark, rows[:150], "b0"), path)  # a load that replaces another
    index.index_store(spark, path)
    orders, items = store.orders_scan(spark, path), store.items_scan(spark, path)
    every = query.page_of(orders, items, 0, 10_000).collect()
    n = len(every)
    for page, size in ((1, 10), (2, 100), (n // 10, 10), (n // 10 + 1, 10), (n, 10), (7, 33)):
        got = index.stored_search(spark, path, page=page, page_size=size).collect()
        assert list(map(repr, got)) == list(map(repr, every[(page - 1) * size:page * size]))
    hours, before = index.hours_of_page(index._indexed(spark, path, "order_hours"), n - 5, 5)
    assert before < n - 4 and max(hours) < T0 + datetime.timedelta(days=2)


def test_broken_index_run_is_not_read(spark, rows, monkeypatch):
    path = shared_folder(spark, "broken-store")
    store.write_orders(*tables(spark, rows[:50]), path)
    monkeypatch.setattr(index, "hour_rows", lambda orders, items: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.index_store(spark, path)
    monkeypatch.undo()
    monkeypatch.setattr(index, "code_rows", index.code_rows)
    assert index._indexed(spark, path, "order_codes").count() == 0
    asked = spark.createDataFrame([(rows[0][1],)], "code string")
    assert index.stored_order_detail(spark, path, asked).collect()[0].status == "found"
    assert index.index_store(spark, path) == 1
    assert index._indexed(spark, path, "order_codes").count() == 50


# Totals that loads keep

def coverage(df):
    return {(r.field, r.filled, r.total) for r in df.collect()}


def test_totals_equal_full_counts(spark, rows):
    """After each load, a rerun with other rows, a refusal and a load without an index, over random ranges."""
    path, rnd = shared_folder(spark, "total-store"), random.Random(9)
    assert totals.stored_orders_count(spark, path).collect()[0].total == 0 and totals.stored_field_coverage(spark, path).count() == 0
    untimed = [("null", "N", None, None)]

    def refuse():
        orders, items = tables(spark, [], "b1")
        summary = spark.createDataFrame([("b1", 3, 0, 3, 1, "refused", T0)], "batch_id string, total_count long, success_count long, fail_count long, error_count long, status string, created_at timestamp")
        store.write_orders(orders, items, path, summary)

    steps = [
        lambda: store.write_orders(*tables(spark, rows[:200] + untimed, "b0"), path), lambda: index.index_store(spark, path),
        lambda: store.write_orders(*tables(spark, rows[200:400], "b1"), path), lambda: index.index_store(spark, path),
        lambda: store.write_orders(*tables(spark, rows[50:90], "b0"), path), refuse, lambda: index.index_store(spark, path)]
    for step in steps:
        step()
        orders, items = store.orders_scan(spark, path), store.items_scan(spark, path)
        assert coverage(totals.stored_field_coverage(spark, path)) == coverage(index.field_rows(orders, items).groupBy("field").agg(F.sum("filled").alias("filled"), F.sum("total").alias("total")))
        times = [r.created_at for r in orders.select("created_at").collect()]
        assert totals.stored_orders_count(spark, path).collect()[0].total == len(times)
        for _ in range(2):
            a, b = (T0 + datetime.timedelta(minutes=rnd.choice([30, 60]) * rnd.randrange(600)) for _ in range(2))
            for since, until in ((a, b), (a, None), (None, b), (a, a + datetime.timedelta(minutes=10))):
                got = totals.stored_orders_count(spark, path, since and str(since), until and str(until)).collect()[0].total
                assert got == sum(t is not None and (since is None or t >= since) and (until is None or t < until) for t in times), (since, until)
    assert len(times) == 240


def test_totals_read_few_days(spark, path):
    plan = totals.stored_orders_count(spark, path, "2024-03-02 10:30:00", "2024-03-09 11:15:00")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*created_day#[0-9]+ IN \(", plan)


def test_loads_without_kept_fields_are_scanned(spark, rows):
    path = shared_folder(spark, "old-store")
    store.write_orders(*tables(spark, rows[:60]), path)
    runs = spark.createDataFrame([("b", r.attempt, "old") for r in store.published(spark, path).collect()], store.SCHEMAS["index_runs"])
    runs.write.parquet(f"{path}/index_runs")
    assert ("external_code", 60, 60) in coverage(totals.stored_field_coverage(spark, path))


# Refused loads

def test_refused_rerun_hides_nothing(spark):
    path = shared_folder(spark, "refused-store")

    def run(quantities):
        fields = "externalCode string, storeName string, receiverName string, receiverPhone string, receiverAddress string, skuCode string, skuName string, skuQuantity string, skuSpec string, remark string"
        df = spark.createDataFrame([(k, f"C{k}", "s", "", "", "", "x", "y", q, "", "", "B", T0) for k, q in enumerate(quantities)], f"k int, {fields}, batch_id string, created_at timestamp")
        return load.import_job(df, ["k"], path).collect()[0].status

    visible = lambda: sorted(r.external_code for r in store.orders_scan(spark, path).collect())
    states = lambda: sorted(r.status for r in store.import_batches(spark, path).collect())
    assert run(["no"]) == "refused" and visible() == [] and states() == ["refused"]
    assert run(["1", "2", "3"]) == "completed" and visible() == ["C0", "C1", "C2"] and states() == ["completed"]
    assert run(["1", "no", "3"]) == "refused" and visible() == ["C0", "C1", "C2"] and states() == ["completed", "refused"]
    assert store.import_errors(spark, path).count() == 1 and store.items_scan(spark, path).count() == 3
    assert run(["1", "2"]) == "completed" and visible() == ["C0", "C1"] and states() == ["completed"]
    assert store.import_errors(spark, path).count() == 0


# Codes that come again

def load_codes(spark, path, batch, codes, day):
    orders, items = tables(spark, [(f"{batch}-{i}", c, "r", T0 + datetime.timedelta(days=day, minutes=i)) for i, c in enumerate(codes)], batch)
    store.write_orders(orders, items, path)


def test_repeats_over_epochs_and_restarts(spark):
    path, state = shared_folder(spark, "repeats"), shared_folder(spark, "repeats-state")
    seen, want = set(), set()
    for day, codes in enumerate([["a", "b", "a", "", " "], ["b ", "c", "", "d"], ["d", "e", "a"], ["f"]]):
        load_codes(spark, path, f"e{day}", codes, day)
        for i, c in enumerate(codes):
            if c.strip() and c.strip() in seen:
                want.add(f"e{day}-{i}")
            seen.add(c.strip())
        watch_repeats(spark, path, state, once=True).awaitTermination()  # each call starts from the checkpoint
        assert {r.id for r in repeated_orders(spark, path).collect()} == want
    assert want
    load_codes(spark, path, "e2", ["d", "e", "a"], 2)  # the same batch again does not repeat itself
    watch_repeats(spark, path, state, once=True).awaitTermination()
    assert {r.id for r in repeated_orders(spark, path).collect()} == want


def test_hot_code_and_many_batches(spark):
    path, state = shared_folder(spark, "repeats"), shared_folder(spark, "repeats-state")
    load_codes(spark, path, "h", ["hot"] * 3000 + [f"c{i}" for i in range(500)], 0)
    watch_repeats(spark, path, state, once=True, files_per_batch=1).awaitTermination()
    assert repeated_orders(spark, path).groupBy("code").count().collect()[0]["count"] == 2999


def test_forgotten_after_the_retention(spark):
    path, state = shared_folder(spark, "repeats"), shared_folder(spark, "repeats-state")
    for n, (codes, day) in enumerate([(["x", "y"], 0), (["y"], 4), (["z"], 30), (["z"], 31), (["x", "y", "z"], 32)]):
        load_codes(spark, path, f"r{n}", codes, day)
        watch_repeats(spark, path, state, retention_days=5, late="1 hour", once=True).awaitTermination()
    assert {r.id for r in repeated_orders(spark, path).collect()} == {"r1-0", "r3-0", "r4-2"}


def test_status_without_details(spark, rows):
    orders, items = tables(spark, rows[:9])
    items = items.withColumn("sku_quantity", F.lit(1))
    pairs = spark.createDataFrame([(rows[i][1], s) for i in (1, 3, 4) for s in ("sku1", "none", "")], "externalCode string, skuCode string")
    short = query.sku_in_order(pairs, orders, items, details=False)
    assert short.columns == ["code", "sku", "status"]
    assert plain(short) == plain(query.sku_in_order(pairs, orders, items).select("code", "sku", "status"))


# What moves

def test_batches_are_seen_once_published(spark, rows):
    path, attempt = shared_folder(spark, "two-steps"), store.new_attempt()
    (o1, i1), (o2, i2) = tables(spark, rows[:20], "b1"), tables(spark, rows[20:30], "b2")
    store.write_orders(o1.unionByName(o2), i1.unionByName(i2), path, store.counted(o1), attempt)
    assert index.index_store(spark, path) == 1 and index._indexed(spark, path, "order_codes").count() == 20
    assert store.orders_scan(spark, path).count() == 20
    store.publish(store.counted(o2), path, attempt)
    assert store.orders_scan(spark, path).count() == 30 and index._unindexed(spark, path).count() == 1


def test_items_of_order_detail_move_once(spark, rows):
    orders, items = (store.with_day(x) for x in tables(spark, rows[:9]))
    items = items.withColumn("sku_quantity", F.lit(1))
    codes = spark.createDataFrame([(rows[1][1],)], "code string")
    found = query.order_detail(codes, orders.hint("merge"), items.hint("merge"))
    moved = re.findall(r"Exchange hashpartitioning\(order_id[^)]*\)", found._jdf.queryExecution().executedPlan().toString())
    assert len(moved) == 2 and not any("created_day" in m for m in moved), moved  # the items, and the ids of the orders


def test_monthly_items_are_not_laid_by_day(spark):
    from consigna.catalog.registry import Tables
    from consigna.catalog.store import _monthly
    orders, items = (x._jdf.queryExecution().optimizedPlan().toString() for x in _monthly(Tables(spark, "/root/testdata/sf0.001")))
    assert "RebalancePartitions" not in items and "RebalancePartitions" in orders
    assert "concat" not in orders.split("RebalancePartitions")[1]  # texts are made behind the shuffle


def test_rows_with_their_answer_share_few_groups():
    import pandas as pd
    from consigna.streaming import repeats
    n = 4000
    rows = pd.DataFrame({"code": [f"c{i % 500}" if i % 9 else "" for i in range(n)], "id": [f"i{i}" for i in range(n)], "seen_at": T0, "attempt": "a"})
    out = pd.concat(repeats._thin(iter([rows])))
    asking = out[out["spot"] == ""]
    assert sorted(asking["asks"]) == sorted(set(rows["code"]) - {""})
    assert len(out[out["spot"] != ""].groupby(["asks", "spot"])) <= repeats.SPOTS and len(out) == n


def test_items_are_sorted_while_they_are_numbers(spark):
    from consigna.catalog.registry import Tables
    from consigna.catalog.store import _monthly
    for rows in _monthly(Tables(spark, "/root/testdata/sf0.001")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort [created_day" in plan and "concat" not in plan.split("Sort [created_day")[1]  # texts are made behind the sort


def test_large_buckets_are_cut(spark, rows, monkeypatch):
    """Each part of a bucket has a task, and look-ups read them all."""
    orders = tables(spark, rows)[0]
    grams = index.gram_rows(orders)
    n = index._gram_count(orders)
    assert grams.count() <= n
    monkeypatch.setattr(index, "PART_ROWS", -(-n // (index.BUCKETS * 3)))
    cut = index.by_bucket(grams, n).select("*", F.spark_partition_id().alias("task"))
    assert {r.c for r in cut.groupBy("task").agg(F.countDistinct("bucket").alias("c")).collect()} == {1}
    assert cut.groupBy("bucket").agg(F.countDistinct("task").alias("c")).agg(F.max("c")).first()[0] == 3
    assert plain(cut.drop("task")) == plain(grams)
    path = shared_folder(spark, "cut-store")
    store.write_orders(*tables(spark, rows), path)
    assert index.index_store(spark, path) == 1
    for part in ("ORD_0", "12", "%", "_99"):
        got, want = (f(page_size=50, external_code=part) for f in (
            lambda **k: index.stored_search(spark, path, **k), lambda **k: query.orders_search(store.orders_scan(spark, path), store.items_scan(spark, path), **k)))
        assert plain(got) == plain(want)
