import pytest
from pyspark.sql import functions as F

import fixtures as X
from consigna.operators import summary
from consigna.operators.validate import error_list
from consigna.plans.parse import NO_RULE, NO_SOURCE, parse, parse_files
from consigna.plans.presets import BY_ID, PRESETS
from consigna.schema import ORDER_KEYS


def rows_of(parsed, *cols):
    return [tuple(r) for r in parsed.records.orderBy("file_id", *ORDER_KEYS).select(*cols).collect()]


def errors_of(parsed):
    return sorted((r.file_id, r.message) for r in parsed.errors.collect())


def test_table_with_metadata(grid):
    got = parse(grid({"f": [("s", X.NOTE_ROWS)]}), None, BY_ID["preset-peisong-fahuodan"])
    common = ("PS2512220005001", "海口龙湖天街店", "王五", "13800138000", "海口市龙华区")
    rows = rows_of(got, "row_idx", "externalCode", "storeName", "receiverName", "receiverPhone", "receiverAddress",
                   "skuCode", "skuName", "skuSpec", "skuQuantity")
    # The rows below the table are data rows too: the preset only skips totals.
    assert rows[0] == (5, *common, "W001", "酸菜", "袋", "10")
    assert rows[1] == (6, *common, "W002", "粉条", "箱", "5")
    assert [r[0] for r in rows] == [5, 6, 8, 9]
    assert errors_of(got) == []


def test_matrix(grid):
    got = parse(grid({"f": [("s", X.PLAN_ROWS)]}), None, BY_ID["preset-zhou-peisong-jihua"])
    assert rows_of(got, "row_idx", "storeName", "remark", "skuName", "skuQuantity") == X.PLAN_GOLD


def test_multi_sheet(grid):
    sheets = [("甲", X.store_sheet("甲店", "张三", "138", "路1", "AB")), ("乙", X.store_sheet("乙店", "李四", "139", "路2", "C"))]
    got = parse(grid({"f": sheets}), None, BY_ID["preset-duo-mendian-chuku"])
    rows = [r for r in rows_of(got, "sheet_idx", "row_idx", "storeName", "receiverName", "receiverPhone",
                               "receiverAddress", "skuCode", "skuQuantity") if r[6]]
    assert rows == [
        (0, 5, "甲店", "张三", "138", "路1", "A", "1"), (0, 6, "甲店", "张三", "138", "路1", "B", "2"),
        (1, 5, "乙店", "李四", "139", "路2", "C", "1"),
    ]


def test_multi_sheet_quirks(grid):
    sheets = [("a1", [["h"], ["x"]]), ("b", [["h"], ["y"]]), ("a2", [["h"], ["z"]])]
    rows = grid({"f": sheets, "none": []})
    rule = {"source": {"type": "multi-sheet"}, "fieldMapping": {"skuCode": {"type": "column", "column": 0}}}

    def run(**config):
        got = parse(rows, None, {**rule, "source": {"type": "multi-sheet", "sheetConfig": config}})
        return [r[0] for r in rows_of(got, "skuCode")], [m for f, m in errors_of(got) if f == "f"]

    assert run(sheetNamePattern="^a") == (["x", "z"], [])
    assert run(sheetIndex=0) == (["x"], [])
    assert run(sheetIndex=1) == ([], ["Sheet index 1 out of range"])
    assert run(sheetIndex=9) == ([], [])
    assert run(allSheets=True, sheetNamePattern="^a") == (["x", "z"], ["No sheet matches pattern: ^a"])
    assert run(sheetNamePattern="(") == ([], ["Invalid sheetNamePattern: ("] * 3)
    got = parse(rows, None, rule)
    assert ("none", "No sheet data available for multi-sheet mode") in errors_of(got)


def test_select_sheet_errors(grid):
    rows = grid({"f": [("a", [["h"], ["x"]]), ("b", [["h"], ["y"]])], "none": [], "blank": [("q", []), ("b", [["h"], ["w"]])]})
    rule = {"fieldMapping": {"skuCode": {"type": "column", "column": 0}}}

    def run(**config):
        got = parse(rows, None, {**rule, "source": {"type": "table", "sheetConfig": config}})
        return rows_of(got, "file_id", "skuCode"), errors_of(got)

    none = ("none", "No sheet data available")
    assert run() == ([("f", "x")], [none])
    assert run(sheetIndex=1) == ([("blank", "w"), ("f", "y")], [none])
    assert run(sheetIndex=2) == ([], [("blank", "Sheet index 2 out of range"), ("f", "Sheet index 2 out of range"), none])
    assert run(sheetNamePattern="^q") == ([], [("f", "No sheet matches pattern: ^q"), none])
    assert run(sheetNamePattern="[") == ([], [("blank", "Invalid sheetNamePattern: ["), ("f", "Invalid sheetNamePattern: ["), none])


def test_stock_and_inference(grid):
    rows = grid({"f": [("s", X.STOCK_ROWS)]})
    rule = BY_ID["preset-huanshu-muchang"]
    want = [("26/30海老盒装熟虾4KG", "07010747", "欢乐牧场"), ("牛肉", "07010748", "欢乐牧场")]
    assert rows_of(parse(rows, None, rule), "skuName", "skuCode", "storeName") == want
    bare = {k: v for k, v in rule.items() if k != "source"}
    assert rows_of(parse(rows, None, bare), "skuName", "skuCode", "storeName") == want
    got = parse(rows, None, {"name": "x", "fileType": "excel"})
    assert (rows_of(got, "skuName"), errors_of(got)) == ([], [("f", NO_SOURCE)])
    got = parse(rows, None, None)
    assert (rows_of(got, "skuName"), errors_of(got)) == ([], [("f", NO_RULE)])
    got = parse(rows, None, {"source": {"type": "odd"}})
    assert errors_of(got) == [("f", "Unknown source type: odd")]


@pytest.mark.parametrize("block", [65536, 2, 1])
def test_aggregation(grid, block):
    got = parse(grid({"f": [("s", X.LINES_ROWS)]}), None, BY_ID["preset-hunan-cang"], block_rows=block)
    assert rows_of(got, "row_idx", "externalCode", "skuCode", "skuQuantity", "remark", "storeName") == [
        (3, "H1", "A,B,A", "5,7,5", "急", "甲店"), (6, "H2", "C", "4", "", "乙店")]
    errors = error_list(got.records, ["row_idx"]).collect()
    assert [(r.row_idx, r.field) for r in errors] == [(3, "skuQuantity")]
    assert errors_of(got) == []


@pytest.mark.parametrize("block", [65536, 3])
def test_cards(grid, block):
    got = parse(grid({"f": [("s", X.CARD_ROWS)]}), None, BY_ID["preset-mendian-diaobo"], block_rows=block)
    assert rows_of(got, "row_idx", "externalCode", "storeName", "receiverName", "receiverPhone", "receiverAddress", "skuCode", "skuQuantity") == [
        (7, None, "甲店", "张三", "13800138000", "杭州路1号", "T1", "1"),
        (8, None, "甲店", "张三", "13800138000", "杭州路1号", "T2", "2"),
        (14, None, "乙店", "李四", "13900139000", "武汉路2号", "T3", "3"),
    ]


def test_card_rules(grid):
    rows = grid({"f": [("s", [["x"], ["start 1"], ["a 1"], ["end"], ["lost"], ["start 2"], ["b 2"], ["start 3"]])], "e": [("s", [])]})
    card = {"cardStartPattern": "^start", "cardEndPattern": "^end", "metadataPatterns": {"remark": r"^[ab] (\d)", "skuSpec": "["}}
    rule = {"source": {"type": "card"}, "cardParsing": card}
    assert rows_of(parse(rows, None, rule), "row_idx", "remark") == [(2, "1"), (6, "2"), (8, None)]
    inner = {"fieldMapping": {"skuCode": {"type": "column", "column": 0}, "skuName": {"type": "cell", "cell": "A2"},
                              "remark": {"type": "column", "column": "nope"}}}
    got = parse(rows, None, {**rule, "cardParsing": {**card, "innerTableConfig": inner}})
    # The row above is the header, the end row is data, inner fields win even when empty.
    assert rows_of(got, "row_idx", "skuCode", "skuName", "remark") == [
        (3, "a 1", "a 1", ""), (4, "end", "a 1", ""), (7, "b 2", "b 2", "")]
    zero = {**inner, "dataStartOffset": 0}
    assert rows_of(parse(rows, None, {**rule, "cardParsing": {**card, "innerTableConfig": zero}}), "row_idx") == []
    got = parse(rows, None, {**rule, "cardParsing": {**card, "cardStartPattern": "("}})
    assert errors_of(got) == [("f", "Engine error: Cannot read properties of null (reading 'test')")]
    assert rows_of(got, "row_idx") == []


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
def test_confirmation_text(grid, pages, gap):
    got = parse(grid({}), pages({"f": [X.confirm_text(gap)]}), BY_ID["preset-mendian-peisong-queren"])
    want = [(f"PS{c}", s, p, t, a, *map(str, i)) for c, s, p, t, a, items in X.ORDERS for i in items]
    assert rows_of(got, "externalCode", "storeName", "receiverName", "receiverPhone", "receiverAddress",
                   "skuCode", "skuName", "skuSpec", "skuQuantity") == want


def test_signed_pages(grid, pages):
    got = parse(grid({}), pages({"f": X.signed_pages()}), BY_ID["preset-peisong-qianshou"])
    want = [(f"DS{c}", p, t, i[0], str(i[3])) for c, _, p, t, _, items in X.ORDERS for i in items]
    assert rows_of(got, "externalCode", "receiverName", "receiverPhone", "skuCode", "skuQuantity") == want


def test_single_text(grid, pages):
    got = parse(grid({}), pages({"f": [X.SINGLE_TEXT], "blank": [" \n"]}), BY_ID["preset-qian-zhaizhai"])
    assert rows_of(got, "externalCode", "storeName", "receiverName", "skuCode", "skuName", "skuSpec", "skuQuantity", "extra") == [
        ("QZ001", "鞍山店", "孙六", "ZBWP0001", "烙锅酱", "500g*10包", "3", {"_unit": "件"}),
        ("QZ001", "鞍山店", "孙六", "ZBWP0002", "辣椒面", "1kg", "12", {"_unit": "包"}),
    ]
    assert errors_of(got) == [("blank", "No text content available for text mode parsing")]


def test_text_faults(grid, pages):
    base = {"recordSeparator": ";", "fieldPatterns": {"remark": "(.)x"}}

    def run(**change):
        return parse(grid({}), pages({"f": ["ax;b"]}), {"source": {"type": "text"}, "textParsing": {**base, **change}})

    assert rows_of(run(), "text_part", "remark") == [(0, "a"), (1, None)]
    assert errors_of(run(recordSeparator="(")) == [("f", "Invalid recordSeparator regex: (")]
    assert rows_of(run(itemPattern="(", itemFields=["skuCode"]), "remark") == [("a",), (None,)]
    assert errors_of(run(itemPattern="a*", itemFields=["skuCode"])) == [("f", "Engine error: itemPattern matches empty text")]
    assert rows_of(run(itemPattern="[ab]", itemFields=["skuCode"]), "remark", "skuCode") == [("a", ""), (None, "")]


def test_specific_row_zero(grid):
    rule = {**BY_ID["preset-huanshu-muchang"], "metadataExtraction": [{"targetField": "remark", "searchArea": "specific-row", "row": 0}]}
    got = parse(grid({"f": [("s", X.STOCK_ROWS)]}), None, rule)
    assert errors_of(got) == [("f", "Engine error: Cannot read properties of undefined (reading 'map')")]
    assert rows_of(got, "skuCode") == []


def test_whole_suite(spark, grid, pages):
    sheets = [("甲", X.store_sheet("甲店", "张三", "138", "路1", "AB"))]
    books = {X.NOTE: [("s", X.NOTE_ROWS)], X.PLAN: [("s", X.PLAN_ROWS)], X.STORES: sheets, X.STOCK: [("s", X.STOCK_ROWS)],
             X.LINES: [("s", X.LINES_ROWS)], X.CARDS: [("s", X.CARD_ROWS)], "x.csv": [("s", [["a"]])]}
    texts = {X.CONFIRM: [X.confirm_text()], X.SIGNED: X.signed_pages(), X.SINGLE: [X.SINGLE_TEXT]}
    files = spark.createDataFrame([(n, n) for n in [*books, *texts]], "file_id string, file_name string")
    got = parse_files(files, grid(books), pages(texts), PRESETS)
    counts = {r.file_id: r.n for r in got.records.groupBy("file_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {X.NOTE: 4, X.PLAN: 14, X.STORES: 7, X.STOCK: 2, X.LINES: 2, X.CARDS: 3, X.CONFIRM: 10, X.SIGNED: 10, X.SINGLE: 2}
    assert errors_of(got) == [("x.csv", "未找到匹配的预设规则")]
    per_file = summary.parse_summary(files, got.records, got.errors)
    from consigna.operators.rules_table import match_rule_by_filename
    routed = match_rule_by_filename(files, PRESETS)
    assert {r.file_name: r.rule_id for r in routed.collect()} == dict(zip([
        X.NOTE, X.PLAN, X.STORES, X.STOCK, X.LINES, X.CARDS, X.CONFIRM, X.SIGNED, X.SINGLE, "x.csv"],
        [p["id"] for p in PRESETS] + [None]))
    total = summary.suite_summary(routed, per_file).first().asDict()
    assert total == {"files": 10, "matched": 9, "passed": 9, "failed": 1, "without_rows": 1}


def test_files_without_anything_to_read(spark, grid, pages):
    files = spark.createDataFrame([("a", "x-1.xlsx"), ("b", "x-2.xlsx"), ("c", "y-1.docx"), ("d", "y-2.docx"), ("e", "z.pdf")], "file_id string, file_name string")
    rules = [
        {"id": "t", "fileType": "excel", "keywords": ["x-"], "source": {"type": "table"}, "fieldMapping": {"skuCode": {"type": "column", "column": 0}}},
        {"id": "p", "fileType": "word", "keywords": ["y-"], "source": {"type": "text"}, "textParsing": {"recordSeparator": "#", "fieldPatterns": {"remark": "(.)"}}},
    ]
    got = parse_files(files, grid({"b": [("s", [["h"], ["v"]])], "d": [("s", [["h"], ["v"]])]}), pages({"a": ["text"], "c": ["text"]}), rules)
    assert [e[0] for e in errors_of(got)] == ["a", "d", "e"]
    done = {r.file_id: (r.success, r.total_rows) for r in summary.parse_summary(files, got.records, got.errors).collect()}
    assert done == {"a": (False, 0), "b": (True, 1), "c": (True, 1), "d": (False, 0), "e": (False, 0)}


def test_errors_of_texts_gather_no_text(spark, pages):
    rule = {"source": {"type": "text"}, "textParsing": {"recordSeparator": "\\n", "fieldPatterns": {"remark": "(.+)"}}}
    got = parse(spark.createDataFrame([], "file_id string, sheet_idx int"), pages({"a": ["x", "y"], "b": [" ", None]}), rule)
    assert "collect_list" not in got.errors._jdf.queryExecution().optimizedPlan().toString()
    assert [r.file_id for r in got.errors.collect()] == ["b"]
    assert sorted((r.file_id, r.remark) for r in got.records.collect()) == [("a", "x"), ("a", "y")]
