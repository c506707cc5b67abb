"""Cell access on an ARRAY<STRING> row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from consigna.functions.text import WS, text_or_empty, trim


def cell(cells: Column, i: int | Column) -> Column:
    """Cell at a 0-based index, '' when there is none."""
    if isinstance(i, float) and i != int(i):
        return F.lit("")
    return text_or_empty(F.get(cells, F.lit(int(i)) if not isinstance(i, Column) else i))


def address(a1: str) -> tuple[int, int] | None:
    """(row, column) of an A1 style address, 0-based; None when it is not one."""
    m = re.fullmatch(r"([A-Za-z]+)([0-9]+)", a1 or "")
    if not m:
        return None
    col = 0
    for ch in m.group(1).upper():
        col = col * 26 + ord(ch) - 64
    return int(m.group(2)) - 1, col - 1


def headers(cells: Column) -> Column:
    return F.transform(cells, lambda c: trim(text_or_empty(c)))


def resolve(heads: Column, name: str) -> Column:
    """Index of a named column: equal name first, else the first header that contains it."""
    want = name.lower().strip(WS)
    low = F.transform(heads, lambda h: F.lower(h))
    same = F.array_position(F.transform(low, lambda h: trim(h)), want)
    part = F.array_position(F.transform(low, lambda h: F.contains(h, F.lit(want))), F.lit(True))
    hit = F.when(same > 0, same).when(part > 0, part)
    return (hit - 1).cast("int")


