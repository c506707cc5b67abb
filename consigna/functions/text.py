"""String and number semantics of the rule language as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming and \s cover in the rule language.
WS = (
    "\t\n\v\f\r\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


_NOT_WS = "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in WS) + "]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_empty(c: Column) -> Column:
    return text_or_empty(c) == ""


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(_NOT_WS), F.lit(False))


def row_text(cells: Column) -> Column:
    """All cells joined by one space; an empty cell keeps its place."""
    return F.array_join(cells, " ", "")


def has_content(cells: Column) -> Column:
    return F.exists(cells, lambda c: ~is_blank(c))


def _based(t: Column, bits: int, digits: int) -> Column:
    """Value of a literal of any length in base 2**bits, rounded once to DOUBLE.

    The first significant digits fill at least 54 bits of a BIGINT; one more bit says whether any digit
    after them is not zero, so the cast rounds as the whole number would. The rest is a power of two.
    """
    all_ = F.regexp_replace(F.substr(t, F.lit(3)), "^0+", "")
    rest = F.greatest(F.length(all_) - digits, F.lit(0))
    head = F.coalesce(F.conv(F.concat(F.lit("0"), F.substring(all_, 1, digits)), 2 ** bits, 10).cast("bigint"), F.lit(0))
    sticky = F.substr(all_, F.lit(digits + 1)).rlike("[1-9a-fA-F]").cast("bigint")
    return (head * 2 + sticky).cast("double") * F.pow(F.lit(2.0), (rest * bits).cast("double") - 1)


def to_number(c: Column) -> Column:
    """Text to DOUBLE: blank is 0, hex/octal/binary literals count, anything else is NaN."""
    t = trim(c)
    plain = t.rlike(r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|Infinity)$")
    return (
        F.when(t == "", F.lit(0.0))
        .when(plain, t.try_cast("double"))
        .when(t.rlike("^0[xX][0-9a-fA-F]+$"), _based(t, 4, 15))
        .when(t.rlike("^0[oO][0-7]+$"), _based(t, 3, 19))
        .when(t.rlike("^0[bB][01]+$"), _based(t, 1, 60))
        .otherwise(F.lit(float("nan")))
    )


def number_text(d: Column) -> Column:
    """DOUBLE to the shortest decimal text: 5, 2.5, 1e+21, NaN."""
    s = d.cast("string")
    fraction = F.regexp_replace(s.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    sci = F.regexp_replace(F.regexp_replace(s, r"\.0E", "E"), "E([0-9])", "E+$1")
    plain = (F.abs(d) >= 1e-6) & (F.abs(d) < 1e21)
    return (
        F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), s)
        .when(d == 0, F.lit("0"))
        .when(plain & (d % 1 == 0), s.try_cast("decimal(38,0)").cast("string"))
        .when(plain, fraction)
        .otherwise(F.lower(sci))
    )
