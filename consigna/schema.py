"""Names and schemas shared by all operators."""

# The ten canonical fields of a shipping record, in export order.
FIELDS = [
    "externalCode", "storeName", "receiverName", "receiverPhone", "receiverAddress",
    "skuCode", "skuName", "skuQuantity", "skuSpec", "remark",
]

# Column labels of an exported record sheet.
EXPORT_LABELS = {
    "externalCode": "外部编码",
    "storeName": "收货门店",
    "receiverName": "收件人姓名",
    "receiverPhone": "收件人电话",
    "receiverAddress": "收件人地址",
    "skuCode": "SKU编码",
    "skuName": "SKU名称",
    "skuQuantity": "SKU数量",
    "skuSpec": "SKU规格",
    "remark": "备注",
}

# One row per grid row. A sheet without rows is one row with a NULL row_idx, a file without
# sheets is one row with a NULL sheet_idx, so neither gets lost on the way to the error table.
RAW_ROWS = "file_id STRING, sheet_idx INT, sheet_name STRING, row_idx INT, cells ARRAY<STRING>"

RAW_TEXTS = "file_id STRING, file_type STRING, page_idx INT, text STRING"

GRID_JSON = (
    "type STRING, text STRING, pages ARRAY<STRING>, "
    "sheets ARRAY<STRUCT<name: STRING, data: ARRAY<ARRAY<STRING>>>>"
)

# Position of a record inside its source row or text; together with the row it is unique and
# gives the record order of a file.
SEQ = ["matrix_col", "text_part", "item", "split"]
ORDER_KEYS = ["sheet_idx", "row_idx", *SEQ]

SHEET = ["file_id", "sheet_idx"]

# Rows of one sheet (or parts of one text) handled by one task when an operator needs order.
BLOCK_ROWS = 65536

# Longest string of a single process running the same rules; a longer joined text is an error there.
MAX_TEXT = 2**29 - 24
TEXT_TOO_LONG = "Engine error: Invalid string length"
