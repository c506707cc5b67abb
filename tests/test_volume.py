"""Bytes that queries shuffle, as Spark counts them: what is derived from few bytes is not moved."""

import pytest

import __spark_entry__ as entry
from consigna.catalog import registry
from consigna.catalog.registry import Tables

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def moved(spark):
    """Bytes shuffled for each line while a query runs, no table being broadcast."""
    jobs = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = jobs.stageList(None, False, False, getattr(jobs, "stageList$default$4")(), getattr(jobs, "stageList$default$5")())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    def of(name):
        limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
        try:
            before = total()
            entry.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            return sum(b for k, b in total().items() if k not in before) / lines
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

    lines = Tables(spark, FOLDER).read("lineitem").count()
    return of


@pytest.mark.parametrize("name, most", [("write_orders", 235), ("import_job", 90)])
def test_moved_for_each_line(moved, name, most):
    assert moved(name) < most


@pytest.fixture
def no_broadcast(spark):
    """Tables as large as none that Spark broadcasts on its own."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("together", [False, True])
def test_lines_are_not_moved_for_suppliers(no_broadcast, together):
    plan = no_broadcast.records(together)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(l_suppkey" not in plan


def test_many_suppliers_are_met_before_orders(no_broadcast, monkeypatch):
    """With more suppliers than are broadcast, lines of an order still leave the joins together, and the rows are the same."""
    want = sorted(no_broadcast.records(together=True).collect())
    monkeypatch.setattr(registry, "FEW_SUPPLIERS", 0)
    many = no_broadcast.records(together=True)
    last = next(x for x in many._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x)
    assert "l_orderkey" in last and "o_orderkey" in last
    assert sorted(many.collect()) == want
