"""Shape of the physical plans."""

import re

import pytest

import __spark_entry__ as entry
from consigna.catalog import QUERIES
from consigna.catalog.registry import Tables

FOLDER = "/root/testdata/sf0.001"

# Queries whose answer is one row, one page or a set of globally largest keys.
GLOBAL = {
    "field_coverage", "orders_count", "orders_count_distinct", "orders_search", "orders_sync", "suite_summary",
}
WRITERS = {"stored_orders_count", "stored_field_coverage", "stored_order_detail", "stored_sku_in_order", "stored_marker_existence", "stored_search", "stored_page", "import_stream_repeats", "write_orders", "orders_scan", "items_scan", "import_job", "import_batches", "rejected_records", "import_errors", "import_stream", "parse_files"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_plan(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin|ObjectHashAggregate.*UDF", plan)
    if name not in GLOBAL:
        assert "Exchange SinglePartition" not in plan


def test_search_reads_pages_not_the_store(spark):
    plan = entry.queries()["orders_search"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") >= 3
    assert "SortMergeJoin" not in plan


def test_pruning(spark):
    plan = entry.queries()["orders_count"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_totalprice" not in plan
    plan = entry.queries()["rules_for_type"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[-1]


def test_merging_scans_no_values(spark):
    """Windows of merge_groups hold states; what values become leaves a block after them only."""
    node = entry.queries()["merge_groups"](spark, FOLDER)._jdf.queryExecution().optimizedPlan()
    windows, todo = [], [node]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Window":
            windows.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert windows
    for w in windows:
        names = {w.output().apply(i).name() for i in range(w.output().size())}
        assert not names & {"_x", "_rows", "_two", "_first", "_blocks"}, names


def test_cards_without_inner_table_are_shuffled_without_cells(spark):
    windows, todo = 0, [entry.queries()["parse_card"](spark, FOLDER)._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Window":
            windows += 1
            assert "cells" not in {node.output().apply(i).name() for i in range(node.output().size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert windows


@pytest.mark.parametrize("name, most", [("parse_table", 4), ("parse_multi_sheet", 2), ("parse_matrix", 2), ("parse_summary", 6)])
def test_rows_are_read_few_times(spark, name, most):
    """A sheet is read for its profile and for its rows; choosing the sheet and its errors read it again."""
    plan = QUERIES[name](Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= most
