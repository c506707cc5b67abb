"""Loads of so many batches that their names do not fit the driver."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from consigna.operators import load
from consigna.sources import store

N = store.FEW_BATCHES + 1 if hasattr(store, "FEW_BATCHES") else 100_001
READ = [store.orders_scan, store.items_scan, store.rejected_records, store.import_errors, store.import_batches]


def records(spark, rows):
    """(batch, key, quantity, specification) as records."""
    df = spark.createDataFrame(rows, "batch_id string, k int, skuQuantity string, skuSpec string")
    return df.withColumns({f: F.lit("x") for f in ("externalCode", "storeName", "receiverName", "receiverAddress", "skuCode", "skuName", "remark")} | {
        "receiverPhone": F.lit("13800138000"), "created_at": F.lit("2024-01-01 08:00:00").cast("timestamp")})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_of_many_batches_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(N).select(F.format_string("file-%09d", "id").alias("batch_id"), F.col("id").cast("string").alias("id"))
    orders = rows.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    store.write_orders(orders, orders.withColumn("order_id", F.col("id")), path)
    for read in (store.orders_scan, store.items_scan, store.import_batches):
        df = read(spark, path)
        assert "Broadcast" not in plan(df)
        assert df.count() == N


@pytest.mark.parametrize("few", [0, 1, 3])
def test_many_batches_are_read_as_few(spark, tmp_path, monkeypatch, few):
    """Batches loaded twice, refused, refused later, left unseen and without a name."""
    def loaded(path):
        first = [("a", 1, "1", "s"), ("a", 2, "1", "s" * 300), ("b", 3, "0", "s"), ("b", 4, "1", "s"), ("c", 5, "2", "s"), ("d", 6, "2", "s"), (None, 7, "1", "s")]
        faults = spark.createDataFrame([("d", "p", "bad"), ("e", "p", "bad")], "batch_id string, position string, message string")
        got = [load.import_job(records(spark, first), ["k"], path, faults=faults)]
        again = [("a", 1, "1", "t"), ("b", 3, "2", "t"), ("c", 5, "n/a", "t"), ("f", 8, "1", "t")]
        got.append(load.import_job(records(spark, again), ["k"], path))
        orders, items = load.split_orders_items(records(spark, [("g", 9, "1", "s"), ("a", 1, "5", "s")]), ["k"])
        store.append(orders, path, "orders", "0")
        store.append(items, path, "order_items", "0")
        rows = [read(spark, path) for read in READ]
        return [sorted(map(str, df.drop("attempt").collect())) for df in got + rows]

    want = loaded(str(tmp_path / "few"))
    assert [len(x) for x in want[2:4]] == [4, 4] and "'e'" in str(want[0])
    monkeypatch.setattr(store, "FEW_BATCHES", few)
    assert loaded(str(tmp_path / "many")) == want


def test_load_gives_its_disk_back(spark, tmp_path):
    """The copy of the records that a load makes for itself is empty in the end; its summary can still be read."""
    kept = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(kept.glob("checked-records-*"))
    got = load.import_job(records(spark, [("a", i, "1", f"s{i}") for i in range(5000)]), ["k"], str(tmp_path))
    own, = set(kept.glob("checked-records-*")) - before
    assert sum(f.stat().st_size for f in own.glob("*.parquet")) < 2000
    assert [r.status for r in got.collect()] == ["completed"] and store.orders_scan(spark, str(tmp_path)).count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_second_load_does_not_join_again(spark, monkeypatch):
    """import_batches loads one copy of its records twice."""
    loaded, job = [], load.import_job
    monkeypatch.setattr(load, "import_job", lambda df, *a, **k: (loaded.append(plan(df)), job(df, *a, **k))[1])
    assert entry.queries()["import_batches"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(loaded) == 2 and not any("Join" in p for p in loaded)
