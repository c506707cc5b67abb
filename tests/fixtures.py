"""Document fixtures: hand-made grids and texts in the shapes the preset rules read."""

NOTE = "12.25海口龙湖天街-配送发货单PS2512220005001(1).xlsx"
NOTE_ROWS = [
    ["黎明屯配送中心-配送发货单"],
    ["收货机构", "海口龙湖天街店", "供货机构", "配送中心"],
    [None],
    ["序号", "物品编码", "物品名称", "规格型号", "发货数量"],
    ["1", "W001", "酸菜", "袋", "10"],
    ["2", "W002", " 粉条 ", "箱", "5"],
    ["合计", None, None, None, "15"],
    ["单据号", "PS2512220005001"],
    ["收货人", "王五", "收货电话", "13800138000", "收货地址", "海口市龙华区"],
    [" ", None],
    ["　"],
]

PLAN = "周配送计划.xlsx"
PLAN_ROWS = [
    ["盛鼎食材公司周配送计划 2024年第3周", "", "", "", "", ""],
    ["", "周一(1/15)", "周二(1/16)", "周三(1/17)", "周四(1/18)", "周五(1/19)"],
    ["尹三顺(银泰店)", "肥牛卷x20\n羊肉片x15", "金针菇x30", "", "肥牛卷x10\n鸭血x20", ""],
    ["海底捞(城西店)", "毛肚x25\n鸭血x40", "", "肥牛卷x30\n虾滑x20", "", "毛肚x15"],
    ["呷哺呷哺(万象城)", "", "羊肉x18\n豆腐皮x50", "金针菇x25", "", "羊肉x10"],
]
PLAN_GOLD = [
    (3, "尹三顺(银泰店)", "周一(1/15)", "肥牛卷", "20"),
    (3, "尹三顺(银泰店)", "周一(1/15)", "羊肉片", "15"),
    (3, "尹三顺(银泰店)", "周二(1/16)", "金针菇x30", None),
    (3, "尹三顺(银泰店)", "周四(1/18)", "肥牛卷", "10"),
    (3, "尹三顺(银泰店)", "周四(1/18)", "鸭血", "20"),
    (4, "海底捞(城西店)", "周一(1/15)", "毛肚", "25"),
    (4, "海底捞(城西店)", "周一(1/15)", "鸭血", "40"),
    (4, "海底捞(城西店)", "周三(1/17)", "肥牛卷", "30"),
    (4, "海底捞(城西店)", "周三(1/17)", "虾滑", "20"),
    (4, "海底捞(城西店)", "周五(1/19)", "毛肚x15", None),
    (5, "呷哺呷哺(万象城)", "周二(1/16)", "羊肉", "18"),
    (5, "呷哺呷哺(万象城)", "周二(1/16)", "豆腐皮", "50"),
    (5, "呷哺呷哺(万象城)", "周三(1/17)", "金针菇x25", None),
    (5, "呷哺呷哺(万象城)", "周五(1/19)", "羊肉x10", None),
]

STORES = "多门店分Sheet出库单.xlsx"


def store_sheet(store, person, phone, address, codes):
    rows = [[f"{store}出库单"], [None], [None], ["物品编码", "物品名称", "规格型号", "出库数量", "备注"]]
    rows += [[c, f"品{c}", "件", str(i + 1), ""] for i, c in enumerate(codes)]
    rows += [[None]] * (11 - len(rows)) + [["合计", None, None, "9"]]
    return rows + [[None], [f"联系人：{person}"], [f"联系电话：{phone} 收货地址：{address}"]]


STOCK = "欢乐牧场模板0430.xlsx"
STOCK_ROWS = [
    ["货主名称", "SKU名称", "外部商品编码", "规格", "在库数量的总和"],
    ["欢乐牧场", "26/30海老盒装熟虾4KG", "07010747", "4KG", "12"],
    ["欢乐牧场", "牛肉", "07010748", "1KG", "3"],
]

LINES = "湖南仓.xlsx"
LINES_HEAD = ["配送汇总单号*", "收货机构", "物品编码*", "物品名称", "规格型号", "发货数量*", "收货人", "收货电话", "收货地址", "单据备注"]
LINES_ROWS = [
    ["湖南仓发货明细"],
    LINES_HEAD,
    ["H1", "甲店", "A", "a", "x", "5", "张三", "13800138000", "路1", ""],
    ["H1", "甲店", "B", "b", "x", "7", "张三", "13800138000", "路1", "急"],
    ["H1", "甲店", "A", "a", "x", "5", "张三", "13800138000", "路1", ""],
    ["H2", "乙店", "C", "c", "y", "4", "李四", "13800138001", "路2", ""],
    ["H2", "乙店", "C", "c", "y", "4", "李四", "13800138001", "路2", ""],
]

CARDS = "门店调拨单-卡片式.xlsx"
CARD_HEAD = ["物品编码", "物品名称", "规格", "数量"]
CARD_ROWS = [
    ["武汉配送中心门店调拨单"],
    ["调拨单号：DB001"],
    ["▶ 调拨记录 #1"],
    ["调入门店", "甲店", "收货人", "张三", "电话", "13800138000"],
    ["收货地址", "杭州路1号"],
    CARD_HEAD,
    ["T1", "一", "件", "1"],
    ["T2", "二", "件", "2"],
    [None, ""],
    ["▶ 调拨记录 #2"],
    ["调入门店", "乙店", "收货人", "李四", "电话", "13900139000"],
    ["收货地址", "武汉路2号"],
    CARD_HEAD,
    ["T3", "三", "箱", "3"],
]

ORDERS = [
    ("2401150001", "尹三顺自助烤肉（银泰店）", "李明", "13800138001", "杭州市西湖区银泰城B1层", [
        ("SKU0001", "精品肥牛卷500g", "盒装", 20), ("SKU0002", "新鲜羊肉片300g", "盒装", 15),
        ("SKU0003", "金针菇200g", "袋装", 30)]),
    ("2401150002", "海底捞（城西银泰店）", "王芳", "13900139002", "杭州市西湖区城西银泰3楼", [
        ("SKU0004", "鲜毛肚200g", "盒装", 25), ("SKU0005", "鸭血豆腐400g", "盒装", 40),
        ("SKU0001", "精品肥牛卷500g", "盒装", 30), ("SKU0006", "虾滑150g", "盒装", 20)]),
    ("2401150003", "呷哺呷哺（万象城店）", "赵强", "13700137003", "杭州市江干区万象城4楼", [
        ("SKU0007", "手切羊肉250g", "盒装", 18), ("SKU0008", "豆腐皮100g", "袋装", 50),
        ("SKU0003", "金针菇200g", "袋装", 25)]),
]

CONFIRM = "门店配送确认单.docx"


def confirm_text(gap="\n\n"):
    bar = "━" * 20
    lines = ["门店配送确认单", "日期：2024-01-15", "制单人：张三", bar]
    for code, store, person, phone, address, items in ORDERS:
        lines += [f"配送单号：PS{code}", f"收货门店：{store}", f"收货人：{person}", f"联系电话：{phone}",
                  f"收货地址：{address}", "物品明细："]
        lines += [f"{i + 1}. {s} | {n} | {p} | {q}" for i, (s, n, p, q) in enumerate(items)]
        lines.append(bar)
    return gap.join(lines) + gap


SIGNED = "配送签收单-多单.pdf"


def signed_pages():
    out = []
    for i, (code, store, person, phone, address, items) in enumerate(ORDERS):
        lines = [f"配送签收单 #{i + 1}", f"配送单号：DS{code}", f"收货门店：{store}", f"收货人：{person}",
                 f"联系电话：{phone}", f"  收货地址：{address}", "编码 名称 规格 数量"]
        lines += [f"{s} {n} {p} {q}" for s, n, p, q in items]
        out.append("\n".join(lines))
    return out


SINGLE = "黔寨寨贵州烙锅（鞍山店）常温.pdf"
SINGLE_TEXT = (
    "单据编号：QZ001\n收货机构：鞍山店 订货机构：总部\n收货人：孙六 \n收货电话：13600136000\n收货地址：鞍山市铁东区\n"
    "1 调料 ZBWP0001 烙锅酱 500g*10包 件 3\n2 调料 ZBWP0002 辣椒面 1kg 包 12\n"
)
