"""Operators on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from consigna.functions import cells as C
from consigna.functions.regex import translate
from consigna.functions.text import to_number
from consigna.operators import cleanup, duplicates, edits, load, query, rules_table, sheets, splitting, suggest, summary, validate
from consigna.operators.extract import cell_at
from consigna.plans.presets import PRESETS
from consigna.schema import FIELDS, MAX_TEXT, TEXT_TOO_LONG
from consigna.sources import files, grid, store, texts


def records(spark, *rows):
    """Records from dicts, absent fields NULL."""
    data = [(i, *[r.get(f) for f in FIELDS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "pos int, " + ", ".join(f"{f} string" for f in FIELDS))


GOOD = {"storeName": "s", "skuCode": "c", "skuName": "n", "skuQuantity": "1"}


def faults(spark, **change):
    got = validate.error_list(records(spark, {**GOOD, **change}), ["pos"]).collect()
    return {r.field: r.message for r in got}


def test_check_recipient(spark):
    got = faults(spark, storeName="", receiverName="x", receiverPhone="13800138000", receiverAddress=" ")
    assert set(got) == {"storeName", "receiverAddress"}
    assert faults(spark, storeName=None, receiverName="x", receiverPhone="0571-87654321", receiverAddress="y") == {}
    assert set(faults(spark, storeName="　")) == {"storeName", "receiverName", "receiverPhone", "receiverAddress"}


@pytest.mark.parametrize("value,want", [
    (None, "missing"), ("", "missing"), (" ", "invalid"), ("0", "invalid"), ("-1", "invalid"), ("5,7", "invalid"),
    ("1e3", None), ("12d", "invalid"), ("0x10", None), ("Infinity", None), (" 7 ", None), ("0.5", None),
])
def test_check_quantity(spark, value, want):
    got = faults(spark, skuQuantity=value).get("skuQuantity")
    assert got == (validate.MESSAGES[f"quantity_{want}"] if want else None)


@pytest.mark.parametrize("phone,ok", [
    ("13800138000", True), ("0571-87654321", True), ("05718765432", True), ("12345", False), (" ", True), (None, True),
    (" 13800138000\n", True), ("23800138000x", False), ("138001380001", True), ("1380013800011", False),
])
def test_check_phone(spark, phone, ok):
    assert ("receiverPhone" not in faults(spark, receiverPhone=phone)) == ok


def test_errors_map_and_gate(spark):
    df = records(spark, GOOD, {**GOOD, "skuCode": " "}, {"receiverPhone": "1"}).withColumn("batch", F.when(F.col("pos") == 0, "a").otherwise("b"))
    checked = validate.validate_records(df)
    assert [r.fields for r in checked.orderBy("pos").select(F.map_keys("errors").alias("fields")).collect()] == [
        [], ["skuCode"], ["storeName", "receiverName", "receiverPhone", "receiverAddress", "skuCode", "skuName", "skuQuantity"]]
    assert {r.batch: r.errors for r in validate.error_count(checked, ["batch"]).collect()} == {"a": 0, "b": 8}
    assert [r.pos for r in validate.submit_gate(checked, "batch").collect()] == [0]


def test_cleanup_order(spark):
    df = records(spark, {"remark": " "}, {"remark": "a "}, {})
    got = cleanup.fill_defaults(df, {"remark": "d", "extra": "e"}).orderBy("pos").collect()
    assert [(r.remark, r.extra) for r in got] == [(" ", "e"), ("a ", "e"), ("d", "e")]
    got = cleanup.fill_defaults(cleanup.trim_fields(df, FIELDS), {"remark": "d"}).orderBy("pos").collect()
    assert [r.remark for r in got] == ["d", "a", "d"]
    assert cleanup.drop_empty(df).count() == 2
    assert cleanup.drop_empty(cleanup.trim_fields(df, FIELDS)).count() == 1
    assert cleanup.drop_empty(cleanup.override_static(df, {"skuQuantity": "0"})).count() == 3


def test_duplicates(spark):
    df = records(spark, *[{"externalCode": c} for c in ["A", " A ", "B", "", "", None]])
    assert sorted((r.code, r.pos, r.n) for r in duplicates.dup_in_batch(df, ["pos"]).collect()) == [("A", 0, 2), ("A", 1, 2)]
    stored = spark.createDataFrame([("A",), ("A",), ("",), (" B",)], "external_code string")
    got = duplicates.dup_vs_store(df, stored).orderBy("pos").collect()
    assert [r.in_store for r in got] == [True, True, False, False, False, False]


def test_corrections_and_deletion(spark):
    df = records(spark, {"remark": "a", "skuQuantity": "1"}, {"remark": "b", "skuQuantity": "2"}, {"remark": "c", "skuQuantity": "3"})
    changes = spark.createDataFrame([
        (0, "remark", "x", 1), (0, "remark", "y", 2), (0, "skuQuantity", "007", 3), (1, "skuQuantity", "", 1),
        (2, "skuQuantity", "abc", 1), (2, "remark", None, 1), (2, "odd", "z", 1)], "pos int, field string, value string, ts int")
    got = edits.apply_corrections(df, changes, ["pos"], ["remark", "skuQuantity"], ["ts"]).orderBy("pos").collect()
    assert [(r.remark, r.skuQuantity) for r in got] == [("y", "7"), ("b", ""), (None, "NaN")]
    gone = spark.createDataFrame([(1,), (1,)], "pos int")
    left = edits.delete_rows(df.withColumn("file", F.lit("f")), gone, ["pos"], ["file"], [F.col("pos")], [F.floor(F.col("pos") / 2)])
    assert sorted((r.pos, r.row_idx) for r in left.collect()) == [(0, 1), (2, 2)]


def test_resolve_column(spark):
    heads = spark.createDataFrame([(["", "物品编码*", "编码"],)], "h array<string>")
    got = heads.select(*[C.resolve(F.col("h"), n).alias(f"c{i}") for i, n in enumerate(["编码", "物品", "", "无"])]).first()
    assert tuple(got) == (2, 1, 0, None)
    heads = spark.createDataFrame([(["SKU Name", "sku"],)], "h array<string>")
    assert heads.select(C.resolve(F.col("h"), " SKU "), C.resolve(F.col("h"), "name"), C.resolve(F.col("h"), "")).first()[:] == (1, 0, 0)


def test_cell_addresses(spark, grid):
    assert [C.address(a) for a in ("A1", "aa3", "B0", "1B", "", "A1B")] == [(0, 0), (2, 26), (-1, 1), None, None, None]
    got = cell_at(grid({"f": [("s", [["a", None], ["b"]])]}), {"x": "A2", "y": "B1", "z": "C9", "w": "B0"}).first()
    assert (got.x, got.y, got.z, got.w) == ("b", "", "", "")


def test_auto_end(grid):
    rows = grid({"f": [("s", [["h"], ["x"], [" ", None], ["　"]]), ("t", [[None], [""]])]})
    assert [tuple(r) for r in sheets.auto_data_end(rows).collect()] == [("f", 0, 2)]
    kept = sheets.region_rows(rows, sheets.Region.of({"dataEndRow": 3, "skipRows": [2]}))
    assert sorted((r.sheet_idx, r.row_idx) for r in kept.collect()) == [(0, 2), (1, 1)][:1]


@pytest.mark.parametrize("value,want", [
    (None, [(None, "q")]), ("", [("", "q")]), ("a", [("a", "q")]), ("ax2", [("ax2", "q")]), ("ax2\n", [("a", "2")]),
    ("\n\n", []), (" bx3 \nplain\n\ncx4x5", [("b", "3"), ("plain", "q"), ("c", "4")]),
])
def test_cell_split(spark, value, want):
    df = records(spark, {"skuName": value, "skuQuantity": "q"})
    got = splitting.cell_split(df, "skuName", translate(r"\n"), translate(r"(.+?)[xX×](\d+)"), ["skuName", "skuQuantity"])
    assert [(r.skuName, r.skuQuantity) for r in got.orderBy("split").collect()] == want


def test_cell_split_variants(spark):
    df = records(spark, {"remark": "a;b"})
    got = splitting.cell_split(df, "remark", translate(";"), None, ["skuName"]).orderBy("split").collect()
    assert [(r.remark, r.skuName) for r in got] == [("a;b", "a"), ("a;b", "b")]
    got = splitting.cell_split(df, "remark", translate(";"), translate("(a)"), ["skuCode", "skuName"]).orderBy("split").collect()
    assert [(r.skuCode, r.skuName) for r in got] == [("a", ""), ("b", None)]
    assert splitting.cell_split(df, "remark", None, None, ["skuName"]).count() == 1
    assert splitting.cell_split(df, "nope", translate(";"), None, ["skuName"]).count() == 1


def test_routing(spark):
    names = ["周配送计划.xlsx", "周配送计划.pdf", "多门店分Sheet出库单.xlsx", "x.csv", "门店配送确认单.DOC", "dir/湖南仓.XLS"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, file_name string")
    got = rules_table.match_rule_by_filename(df, PRESETS).orderBy("i").collect()
    assert [r.rule_id for r in got] == [
        "preset-zhou-peisong-jihua", None, "preset-duo-mendian-chuku", None, "preset-mendian-peisong-queren", "preset-hunan-cang"]
    sized = df.withColumn("size", F.when(F.col("i") == 0, 0).otherwise(1))
    got = files.file_type_from_name(sized, size="size").orderBy("i").collect()
    assert [(r.file_type, r.rejected) for r in got] == [
        ("excel", "empty"), ("pdf", None), ("excel", None), (None, "unsupported"), (None, "unsupported"), ("excel", None)]
    rules = spark.createDataFrame([("a", "pdf"), ("b", "word")], "id string, file_type string")
    assert [rules_table.rules_for_type(rules, k).count() for k in ("pdf", "excel", None)] == [1, 0, 2]


def test_upsert(spark):
    stored = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("3", "b", "x")], "id string, name string, description string")
    stored = stored.withColumns({"created_at": F.lit("old"), "updated_at": F.lit("old")})
    incoming = spark.createDataFrame([("a", "y", 1), ("c", "z", 2), ("c", "w", 3)], "name string, description string, seq int")
    got = rules_table.upsert_snapshot(stored, incoming, "name", ["description"], "seq", F.lit("now"), F.concat(F.lit("n-"), F.col("name")))
    assert sorted((r.id, r.name, r.description, r.created_at, r.updated_at, r.action) for r in got.collect()) == [
        ("1", "a", "y", "old", "now", "updated"), ("2", "a", "x", "old", "old", "kept"),
        ("3", "b", "x", "old", "old", "kept"), ("n-c", "c", "w", "now", "now", "inserted")]


def test_accept_reject(spark):
    df = records(spark, GOOD, {**GOOD, "skuQuantity": ""}, {**GOOD, "receiverName": "x" * 101}, {**GOOD, "skuQuantity": None},
                 {**GOOD, "receiverName": "店" * 100}, {**GOOD, "remark": "r" * 5000})
    checked = load.accept_reject(df).withColumn("batch_id", F.lit("b"))
    assert [r.rejected is None for r in checked.orderBy("pos").collect()] == [True, False, False, True, True, True]
    got = load.batch_summary(checked).first().asDict()
    assert got == {"batch_id": "b", "total_count": 6, "success_count": 4, "fail_count": 2, "error_count": 0, "status": "partial"}


def test_import_is_idempotent(spark, tmp_path):
    df = records(spark, GOOD, {**GOOD, "receiverName": "x" * 101}, {**GOOD, "skuCode": ""}).withColumns({
        "batch_id": F.when(F.col("pos") < 2, "ok").otherwise("bad"), "created_at": F.lit("2024-01-02 03:04:05").cast("timestamp")})
    for _ in range(2):
        got = [tuple(r) for r in load.import_job(df, ["pos"], str(tmp_path)).collect()]
        assert sorted(got) == [("bad", 1, 0, 1, 1, "refused"), ("ok", 2, 1, 1, 0, "partial")]
    assert sorted((r.batch_id, r.status) for r in store.import_batches(spark, str(tmp_path)).collect()) == [("bad", "refused"), ("ok", "partial")]
    assert [(r.batch_id, r.reason) for r in store.rejected_records(spark, str(tmp_path)).collect()] == [("ok", "receiverName is longer than 100")]
    assert [(r.batch_id, r.field) for r in store.import_errors(spark, str(tmp_path)).collect()] == [("bad", "skuCode")]
    orders, items = store.orders_scan(spark, str(tmp_path)), store.items_scan(spark, str(tmp_path))
    assert (orders.count(), items.count()) == (1, 1)
    assert orders.join(items, orders["id"] == items["order_id"]).count() == 1
    assert store.orders_scan(spark, str(tmp_path), since="2024-01-03").count() == 0


def test_retry_with_fewer_rows_leaves_none(spark, tmp_path):
    df = records(spark, GOOD, {**GOOD, "skuCode": "B"}).withColumns({"batch_id": F.lit("b"), "created_at": F.lit("2024-01-02").cast("timestamp")})
    load.import_job(df, ["pos"], str(tmp_path))
    load.import_job(df.filter("pos = 0").withColumn("created_at", F.lit("2024-02-02").cast("timestamp")), ["pos"], str(tmp_path))
    assert store.orders_scan(spark, str(tmp_path)).count() == store.items_scan(spark, str(tmp_path)).count() == 1
    plan = store.items_scan(spark, str(tmp_path), since="2024-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_day" in plan
    stored = query.filter_orders(store.orders_scan(spark, str(tmp_path)), start="2024-02-01")
    assert "(created_day" in stored._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_empty_store(spark, tmp_path):
    df = records(spark, {**GOOD, "skuCode": ""}).withColumns({"batch_id": F.lit("b"), "created_at": F.lit("2024-01-02").cast("timestamp")})
    assert store.orders_scan(spark, str(tmp_path / "none")).count() == 0
    load.import_job(df, ["pos"], str(tmp_path))
    assert store.orders_scan(spark, str(tmp_path)).count() == store.items_scan(spark, str(tmp_path)).count() == 0


def test_long_quantities(spark, tmp_path):
    texts = ["1234567890123456789012345", "0.0000000000000000001", "0xFF", "1e3"]
    df = records(spark, *[{**GOOD, "skuQuantity": q} for q in texts]).withColumns({"batch_id": F.lit("b"), "created_at": F.lit("2024-01-02").cast("timestamp")})
    got = load.import_job(df, ["pos"], str(tmp_path)).first()
    assert (got.success_count, got.fail_count) == (3, 1)
    assert sorted(r.sku_quantity_text for r in store.items_scan(spark, str(tmp_path)).collect()) == sorted(t for t in texts if t != "0xFF")


def test_number_literals(spark):
    rnd = random.Random(5)
    texts = ["0xFFFFFFFFFFFFFFFFFF", "0b" + "1" * 70, "0o" + "7" * 40, "0x0", "0b" + "0" * 90 + "101", "0x" + "F" * 300, "0x20000000000001", "0x20000000000003"]
    texts += ["0x" + "".join(rnd.choices("0123456789abcdef", k=rnd.randrange(1, 40))) for _ in range(60)]
    texts += ["0b1" + "".join(rnd.choices("01", k=rnd.randrange(1, 140))) for _ in range(60)] + ["0o" + "".join(rnd.choices("01234567", k=rnd.randrange(1, 60))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_number(F.col("t")).alias("n")).collect()
    for r in got:
        whole = int(r.t, 0)
        assert r.n == (float(whole) if whole < 2**1024 - 2**970 else float("inf")), r.t


def test_search_details(spark):
    orders = spark.createDataFrame([
        ("1", "A_1", "r", "2024-01-01 00:00:00"), ("2", "AB1", "r", "2024-01-02 00:00:00"), ("3", "zz", None, None)],
        "id string, external_code string, receiver_name string, created_at string")
    orders = orders.withColumns({"created_at": F.col("created_at").cast("timestamp"), **{
        c: F.lit("") for c in ("store_name", "receiver_phone", "receiver_address", "remark", "batch_id")}})
    items = spark.createDataFrame([(f"i{n}", "2", "s", "n", 1, "p") for n in range(3)],
                                  "id string, order_id string, sku_code string, sku_name string, sku_quantity int, sku_spec string")

    def ids(**kw):
        return [(r.orderId, r.skuCode) for r in query.orders_search(orders, items, **kw).collect()]

    assert ids() == [("3", None), ("2", "s"), ("2", "s"), ("2", "s"), ("1", None)]
    assert ids(page=2, page_size=2) == [("2", "s"), ("2", "s")]
    assert ids(page=3, page_size=2) == [("1", None)]
    assert ids(external_code="A_1") == [("2", "s")] * 3 + [("1", None)]
    assert ids(external_code="A\\_1") == [("1", None)]
    assert ids(external_code="\\A") == [("2", "s")] * 3 + [("1", None)]
    # The end day and the following midnight count.
    assert ids(end="2024-01-01") == [("2", "s")] * 3 + [("1", None)]
    assert ids(start="2024-01-02", end="2024-01-02") == [("2", "s")] * 3
    first = query.orders_sync(orders, items, page_size=1).collect()
    assert [(r.orderId, r["items"], r.createdAt) for r in first] == [("3", [], None)]
    second = query.orders_sync(orders, items, page=2, page_size=1).first()
    assert (second.orderId, second.createdAt, len(second["items"])) == ("2", "2024-01-02T00:00:00.000Z", 3)
    asked = spark.createDataFrame([(" A_1 ",), ("",), ("no",)], "code string")
    assert {r.code: r.status for r in query.order_detail(asked, orders, items).collect()} == {
        "A_1": "found", "": "invalid_external_code", "no": "order_not_found"}


def test_export(spark, tmp_path):
    store.write_export(records(spark, {"remark": 'a "b"\nc'}, {"skuCode": "1"}), str(tmp_path / "x"))
    back = spark.read.csv(str(tmp_path / "x"), header=True, multiLine=True, escape='"')
    assert back.columns[0] == "外部编码" and back.columns[-1] == "备注"
    assert {r["备注"] for r in back.collect()} == {'a "b"\nc', None}


def test_json_sources(spark):
    docs = spark.createDataFrame([
        ("a", '{"type":"excel","sheets":[{"name":"s","data":[["x",2.5,null],[]]},{"name":"t","data":[]}]}'),
        ("b", '{"type":"pdf","pages":["p","q"]}'), ("c", '{"type":"word","text":"t","pages":["p"]}'), ("d", '{"type":"pdf"}')],
        "file_id string, body string")
    rows = {(r.file_id, r.sheet_idx, r.row_idx): r.cells for r in grid.grid_from_json(docs).collect()}
    assert rows == {("a", 0, 0): ["x", "2.5", None], ("a", 0, 1): [], ("a", 1, None): None,
                    ("b", None, None): None, ("c", None, None): None, ("d", None, None): None}
    got = {r.file_id: (r.text, r.error) for r in texts.text_from_pages(grid.texts_from_json(docs)).collect()}
    assert got["b"] == ("p\nq", None) and got["c"] == ("t", None) and got["d"] == (None, texts.NO_TEXT)
    long = texts.text_from_pages(grid.texts_from_json(docs), max_chars=2).filter("file_id = 'b'").first()
    assert (long.text, long.error) == (None, TEXT_TOO_LONG) and MAX_TEXT == 536870888


def test_grid_from_lines(spark):
    df = spark.createDataFrame([("f", 0, "s", "a\tb\n \tc\n"), ("f", 1, "t", "x")], "file_id string, sheet_idx int, sheet_name string, text string")
    got = [(r.sheet_idx, r.row_idx, r.cells) for r in grid.grid_from_lines(df, "text", "\t").orderBy("row_idx").collect()]
    assert got == [(0, 0, ["a", "b"]), (0, 1, [None, "c"]), (0, 2, [None])]
    assert grid.grid_from_lines(df, "text", "\t", sheet=None).count() == 4


def test_prompt(spark, grid):
    rows = grid({"f": [("一", [["a", None], ['q"', "b\n"]]), ("二", [["x"]])]})
    got = suggest.prompt_table(suggest.preview_sample(rows).withColumn("file_type", F.lit("excel"))).first().prompt
    assert got == (
        '文件类型: excel\nSheet名称: 一, 二\n总行数: 2\n\n文件内容前20行:\na\t\nq"\tb\n\n\n'
        '原始数据样本(JSON格式):\n[\n  [\n    "a",\n    ""\n  ],\n  [\n    "q\\"",\n    "b\\n"\n  ]\n]\n\n'
        "请分析此文件的结构并生成解析规则。")


@pytest.mark.parametrize("text,by", [
    ('{"a":1}', "whole"), (' [1] ', "whole"), ('x\n```json\n{"a":1}\n```\ny', "fence"), ('```{"a":1}```', "fence"),
    ('a {"a":1} b', "braces"), ('```json\nbad\n```{"a":1}', "braces"), ("none", None), ("} {", None), ('{"a":1} trailing', "braces"), ("", None),
])
def test_recover_json(spark, text, by):
    got = suggest.recover_json(spark.createDataFrame([(text,)], "text string")).first()
    assert got.found_by == by and (got.json is None) == (by is None)


def test_confidence(spark):
    df = spark.createDataFrame([({"a": 0.8, "b": 0.5, "c": 0.499},)], "confidence map<string,double>")
    assert {r.field: (r.percent, r.band) for r in suggest.confidence_band(df).collect()} == {
        "a": (80, "high"), "b": (50, "medium"), "c": (50, "low")}


def test_coverage_and_samples(spark):
    df = records(spark, {"remark": "a"}, {"remark": ""}, {"remark": "b", "skuCode": " "}).withColumn("file_id", F.lit("f"))
    got = {r.field: r.percent for r in summary.field_coverage(df).collect()}
    assert got["remark"] == 67 and got["skuCode"] == 33 and got["skuName"] == 0
    assert summary.field_coverage(df.limit(0)).count() == 0
    assert [r.remark for r in summary.sample_records(df, 2, order=["pos"]).orderBy("position").collect()] == ["a", ""]
