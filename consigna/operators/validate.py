"""Record validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.functions.text import is_blank, is_empty, to_number, trim

# Validation messages.
MESSAGES = {
    "storeName": "门店名称必填（或填写完整收件人信息）",
    "receiverName": "收件人姓名必填（或填写门店名称）",
    "receiverPhone": "收件人电话必填（或填写门店名称）",
    "receiverAddress": "收件人地址必填（或填写门店名称）",
    "skuCode": "SKU编码必填",
    "skuName": "SKU名称必填",
    "quantity_missing": "SKU数量必填",
    "quantity_invalid": "SKU数量必须为正数",
    "phone_format": "电话格式不正确（需11位手机号或座机格式）",
}

# A mobile number or a land line.
PHONE = r"^(?:1[0-9]{10}|[0-9]{3,4}-?[0-9]{7,8})\z"

CHECKED = ["storeName", "receiverName", "receiverPhone", "receiverAddress", "skuCode", "skuName", "skuQuantity"]


def check_recipient(blank: dict[str, Column] | None = None) -> dict[str, Column]:
    """A store name, or receiver name, phone and address; else an error on each blank one."""
    names = CHECKED[:4]
    blank = blank or {f: is_blank(F.col(f)) for f in names}
    unknown = blank["storeName"] & (blank["receiverName"] | blank["receiverPhone"] | blank["receiverAddress"])
    return {f: F.when(blank[f] & unknown, F.lit(MESSAGES[f])) for f in names}


def check_sku(blank: dict[str, Column] | None = None) -> dict[str, Column]:
    return {f: F.when(blank[f] if blank else is_blank(F.col(f)), F.lit(MESSAGES[f])) for f in ("skuCode", "skuName")}


def check_quantity() -> Column:
    q = F.col("skuQuantity")
    n = to_number(q)
    return (
        F.when(is_empty(q), F.lit(MESSAGES["quantity_missing"]))
        .when(~q.rlike(r"^[1-9][0-9]*\z") & (F.isnan(n) | (n <= 0)), F.lit(MESSAGES["quantity_invalid"]))
    )


def check_phone() -> Column:
    phone = trim(F.col("receiverPhone"))
    return F.when((phone != "") & ~phone.rlike(PHONE), F.lit(MESSAGES["phone_format"]))


def _entries(records: DataFrame) -> tuple[DataFrame, Column]:
    """Records with blank flags, worked out once, and the (field, message) pairs built on them."""
    blank = {f: F.col(f"_blank_{f}") for f in CHECKED[:6]}
    flagged = records.withColumns({f"_blank_{f}": is_blank(F.col(f)) for f in blank})
    errors = check_recipient(blank) | check_sku(blank) | {"skuQuantity": check_quantity()}
    errors["receiverPhone"] = F.coalesce(errors["receiverPhone"], check_phone())
    return flagged, F.array(*[F.struct(F.lit(f).alias("field"), errors[f].alias("message")) for f in CHECKED])


def validate_records(records: DataFrame) -> DataFrame:
    """Adds `errors`, a map from field to message."""
    flagged, entries = _entries(records)
    errors = F.map_from_entries(F.filter(entries, lambda e: e["message"].isNotNull()))
    return flagged.select(*records.columns, errors.alias("errors"))


def error_list(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record and field in error."""
    flagged, entries = _entries(records)
    return flagged.select(*keys, F.inline(entries)).filter(F.col("message").isNotNull())


def error_count(validated: DataFrame, by: list[str] | None = None) -> DataFrame:
    total = F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("errors")
    return validated.groupBy(*(by or [])).agg(total)


def submit_gate(validated: DataFrame, by: str) -> DataFrame:
    """Records of the imports without any error."""
    clean = error_count(validated, [by]).filter(F.col("errors") == 0).select(by)
    return validated.join(clean, by, "left_semi")
