"""Rules for nine known document layouts."""

from __future__ import annotations


def _columns(**fields: str | int) -> dict[str, dict]:
    return {f: {"type": "column", "column": c} for f, c in fields.items()}


def _row(field: str, row: int, regex: str, search: str | None = None, column: int | None = None) -> dict:
    place = {"targetField": field, "searchArea": "specific-row", "row": row, "regex": regex}
    if search:
        place["searchPattern"] = search
    if column is not None:
        place["column"] = column
    return place


_FIRST_SHEET = {"sheetConfig": {"sheetIndex": 0}}
_CLEAN = {"trimWhitespace": True, "removeEmptyRows": True}
_ITEM_FIELDS = ["skuCode", "skuName", "skuSpec", "skuQuantity"]

# Ids, file name keywords, layouts and patterns of the nine rules, in match order.
PRESETS: list[dict] = [
    {
        "id": "preset-peisong-fahuodan", "name": "配送发货单（龙湖天街格式）", "fileType": "excel",
        "keywords": ["配送发货单", "龙湖天街"],
        "source": {"type": "table", **_FIRST_SHEET},
        "dataRegion": {"headerRow": 4, "dataStartRow": 5, "dataEndRow": "auto", "skipPatterns": ["合计"]},
        "fieldMapping": _columns(skuCode="物品编码", skuName="物品名称", skuSpec="规格型号", skuQuantity="发货数量"),
        "metadataExtraction": [
            _row("externalCode", 8, r"单据号\s+(\S+)", "单据号"),
            _row("storeName", 2, r"收货机构\s+(.+?)\s+供货机构", "收货机构"),
            _row("receiverName", 9, r"收货人\s+(.+?)\s+收货电话", "收货人"),
            _row("receiverPhone", 9, r"收货电话\s+(\S+)", "收货电话"),
            _row("receiverAddress", 9, r"收货地址\s+(.+)", "收货地址"),
        ],
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-zhou-peisong-jihua", "name": "周配送计划（矩阵格式）", "fileType": "excel",
        "keywords": ["周配送计划"],
        "source": {"type": "matrix", **_FIRST_SHEET},
        "dataRegion": {"headerRow": 2, "dataStartRow": 3, "dataEndRow": "auto"},
        "matrixTranspose": {
            "fixedColumns": [0], "transposeStartCol": 1, "transposeHeaderRow": 2,
            "valueField": "skuName", "headerField": "remark", "skipEmptyValues": True,
        },
        "fieldMapping": _columns(storeName=0),
        "cellSplitting": {
            "targetField": "skuName", "splitPattern": r"\n", "extractPattern": r"(.+?)[xX×](\d+)",
            "extractFields": ["skuName", "skuQuantity"],
        },
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-duo-mendian-chuku", "name": "多门店分Sheet出库单", "fileType": "excel",
        "keywords": ["多门店", "分Sheet", "出库单"],
        "source": {"type": "multi-sheet", "sheetConfig": {"allSheets": True}},
        "dataRegion": {"headerRow": 4, "dataStartRow": 5, "dataEndRow": 12, "skipPatterns": ["合计"]},
        "fieldMapping": _columns(
            skuCode="物品编码", skuName="物品名称", skuSpec="规格型号", skuQuantity="出库数量", remark="备注"),
        "metadataExtraction": [
            _row("storeName", 1, r"^(.+?)出库单", column=0),
            _row("receiverName", 14, r"联系人[：:]\s*(.+)", "联系人"),
            _row("receiverPhone", 15, r"联系电话[：:]\s*(\S+)", "联系电话"),
            _row("receiverAddress", 15, r"收货地址[：:]\s*(.+)", "收货地址"),
        ],
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-huanshu-muchang", "name": "欢乐牧场库存报表", "fileType": "excel",
        "keywords": ["欢乐牧场"],
        "source": {"type": "table", **_FIRST_SHEET},
        "dataRegion": {"headerRow": 1, "dataStartRow": 2, "dataEndRow": "auto"},
        "fieldMapping": _columns(
            storeName="货主名称", skuName="SKU名称", skuCode="外部商品编码", skuSpec="规格", skuQuantity="在库数量的总和"),
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-hunan-cang", "name": "湖南仓发货明细", "fileType": "excel",
        "keywords": ["湖南仓"],
        "source": {"type": "table", **_FIRST_SHEET},
        "dataRegion": {"headerRow": 2, "dataStartRow": 3, "dataEndRow": "auto", "skipRows": [1]},
        "fieldMapping": _columns(
            externalCode="配送汇总单号*", storeName="收货机构", skuCode="物品编码*", skuName="物品名称",
            skuSpec="规格型号", skuQuantity="发货数量*", receiverName="收货人", receiverPhone="收货电话",
            receiverAddress="收货地址", remark="单据备注"),
        "aggregation": {
            "groupBy": "externalCode",
            "sharedFields": ["storeName", "receiverName", "receiverPhone", "receiverAddress"],
        },
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-mendian-diaobo", "name": "门店调拨单（卡片式）", "fileType": "excel",
        "keywords": ["调拨单", "卡片式"],
        "source": {"type": "card", **_FIRST_SHEET},
        "cardParsing": {
            "cardStartPattern": r"▶\s*调拨记录",
            "metadataPatterns": {
                "storeName": r"调入门店\s+(.+?)(?:\s+收货人|$)",
                "receiverName": r"收货人\s+(.+?)(?:\s+电话|$)",
                "receiverPhone": r"电话\s+(\S+)",
                "receiverAddress": r"收货地址\s+(.+)",
            },
            "innerTableConfig": {
                "headerOffset": 3, "dataStartOffset": 4,
                "fieldMapping": _columns(skuCode="物品编码", skuName="物品名称", skuSpec="规格", skuQuantity="数量"),
            },
        },
        "metadataExtraction": [_row("externalCode", 2, r"调拨单号[：:]\s*(\S+)", "调拨单号")],
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-mendian-peisong-queren", "name": "门店配送确认单（Word格式）", "fileType": "word",
        "keywords": ["配送确认单"],
        "source": {"type": "text"},
        "textParsing": {
            "recordSeparator": r"━{10,}",
            "fieldPatterns": {
                "externalCode": r"配送单号[：:]?\s*(\S+)",
                "storeName": r"收货门店[：:]?\s*(.+)",
                "receiverName": r"收货人[：:]?\s*(.+)",
                "receiverPhone": r"联系电话[：:]?\s*(\S+)",
                "receiverAddress": r"收货地址[：:]?\s*(.+)",
            },
            "itemPattern": r"\d+\.\s+(\S+)\s*\|\s*(.+?)\s*\|\s*(.+?)\s*\|\s*(\d+)",
            "itemFields": _ITEM_FIELDS,
        },
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-peisong-qianshou", "name": "配送签收单（PDF多单格式）", "fileType": "pdf",
        "keywords": ["签收单", "多单"],
        "source": {"type": "text"},
        "textParsing": {
            "recordSeparator": r"配送签收单\s*#\d+",
            "fieldPatterns": {
                "externalCode": r"配送单号[：:]?\s*(\S+)",
                "storeName": r"收货门店[：:]?\s*(.+)",
                "receiverName": r"收货人[：:]?\s*(.+)",
                "receiverPhone": r"联系电话[：:]?\s*(\d[\d\s]+)",
                "receiverAddress": r"收货地址[：:]?\s*(.+)",
            },
            "itemPattern": r"(SKU\d+)\s+(.+?)\s+(盒装|袋装|件|包|箱)\s+(\d+)",
            "itemFields": _ITEM_FIELDS,
        },
        "postProcessing": _CLEAN,
    },
    {
        "id": "preset-qian-zhaizhai", "name": "黔寨寨配送单（PDF格式）", "fileType": "pdf",
        "keywords": ["黔寨寨", "烙锅"],
        "source": {"type": "text"},
        "textParsing": {
            "recordSeparator": r"(?=NEVERMATCH_9999)",
            "fieldPatterns": {
                "externalCode": r"单据编号[：:]\s*(\S+)",
                "storeName": r"收货机构[：:]\s*(.+?)(?:\s+订货机构|$)",
                "receiverName": r"收货人[：:]\s*(.+?)\s",
                "receiverPhone": r"收货电话[：:]\s*(\S+)",
                "receiverAddress": r"收货地址[：:]\s*(.+)",
            },
            "itemPattern": (
                r"(ZBWP\d+)\s+(.+?)\s+(\d[\d.a-zA-Z*\/包袋件杯桶]*.*?)\s+(件|包|瓶|桶)\s+(\d+)"
            ),
            "itemFields": ["skuCode", "skuName", "skuSpec", "_unit", "skuQuantity"],
        },
        "postProcessing": {**_CLEAN, "defaultValues": {"skuQuantity": "0"}},
    },
]

BY_ID = {r["id"]: r for r in PRESETS}
