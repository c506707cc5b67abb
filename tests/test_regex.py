import pytest
from pyspark.sql import functions as F

from consigna.functions import regex as R
from consigna.functions.text import WS, number_text, to_number, trim


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("pattern,text,group,want", [
    ("ab", "abc", 1, "ab"),
    ("z(.)", "abc", 1, ""),
    (r"a\s(\S+)", "a　b", 1, "b"),
    (r"a\s(b)", "a﻿b", 1, "b"),
    (r"(a+)$", "xaa\n", 1, ""),
    (r"(a+)$", "xaa", 1, "aa"),
    (r"(.+)", "x\u0085y\nz", 1, "x\u0085y"),
    (r"([\s\S]+)", "a\nb　c", 1, "a\nb　c"),
    (r"([^\S ]+)", "a \tb", 1, "\t"),
    (r"([\S ]+)", "a b\tc", 1, "a b"),
    (r"([[a]+)", "x[a[", 1, "[a["),
    (r"([a&&b]+)", "x&a", 1, "&a"),
    (r"\bfoo\b", "a foo b", 1, "foo"),
    (r"(a)|(b)", "b", 1, "b"),
    (r"x(\d)?y", "xy", 1, "xy"),
    (r"(a)(b)", "ab", 2, "b"),
    (r"(a)(b)", "ab", 7, "ab"),
    (r"(a)(b)", "ab", 0, "ab"),
    (r"a{,2}", "a{,2}", 1, "a{,2}"),
    (r"配送单号[：:]?\s*(\S+)", "配送单号：PS1 x", 1, "PS1"),
    (r"(?<code>\d+)-", "a12-", 1, "12"),
    (r"\/(\-)", "/-", 1, "-"),
    (r"\q(.)", "q1", 1, "1"),
])
def test_extract(spark, pattern, text, group, want):
    assert one(spark, text, lambda t: R.extract(t, R.translate(pattern), group)) == want


@pytest.mark.parametrize("pattern", ["(", "[a", "a**", "(?i)a", "a++", ")", "*", "\\"])
def test_invalid(spark, pattern):
    assert R.translate(pattern) is None


def test_groups(spark):
    assert R.translate(r"(a)(?:b)(?<n>c)[(](\()").groups == 3
    assert R.translate(r"(a)?(b)(?:(c)|d)((e))*").optional == {1, 3, 4, 5}
    assert R.translate("a*").matches_empty and not R.translate("a").matches_empty


@pytest.mark.parametrize("pattern,text,want", [
    (r"\n", "a\n", ["a", ""]),
    (r"\n", "\n\n", ["", "", ""]),
    (r"(?=NEVERMATCH_9999)", "abc", ["abc"]),
    (r"([-+])", "a+b-c", ["a", "+", "b", "-", "c"]),
    (",", "", [""]),
])
def test_split(spark, pattern, text, want):
    assert one(spark, text, lambda t: R.split(t, R.translate(pattern))) == want


def test_trim(spark):
    assert one(spark, WS + "a b" + WS, trim) == "a b"


@pytest.mark.parametrize("text,want", [
    ("", 0), (" ", 0), ("5", 5), ("+1.5e2", 150), (".5", 0.5), ("5.", 5), ("0x10", 16), ("0b11", 3), ("0o17", 15),
    ("Infinity", float("inf")), ("　7\n", 7),
])
def test_number(spark, text, want):
    assert one(spark, text, to_number) == want


@pytest.mark.parametrize("text", ["12d", "1,000", "1f", "inf", "NaN", "5,7", "--1", "1 2"])
def test_not_a_number(spark, text):
    assert str(one(spark, text, to_number)) == "nan"


@pytest.mark.parametrize("text,want", [
    ("007", "7"), ("2.50", "2.5"), ("1e21", "1e+21"), ("1e20", "100000000000000000000"), ("x", "NaN"), ("", "0"),
    ("0.000001", "0.000001"), ("1e-7", "1e-7"), ("-3", "-3"), ("Infinity", "Infinity"), ("123456789.25", "123456789.25"),
    ("1.5e-9", "1.5e-9"),
])
def test_number_text(spark, text, want):
    assert one(spark, text, lambda t: number_text(to_number(t))) == want
