"""Paths for very large groups, forced with tiny limits, against plain Python."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from consigna.functions.regex import translate
from consigna.operators import cards, query
from consigna.operators.merge import merge_groups
from consigna.operators.skew import join_children, number_rows


def fold(values):
    acc = ""
    for v in values:
        if v and v != acc:
            acc = f"{acc},{v}" if acc else v
    return acc


def expected(rows):
    groups = defaultdict(list)
    for pos, key, a, b, shared in sorted(rows):
        groups[key or ""].append((pos, a, b, shared))
    return {k: (fold([r[1] or "" for r in g]), fold([r[2] or "" for r in g]), g[0][3], g[0][0]) for k, g in groups.items()}


def merged(spark, rows, block, trim=False):
    df = spark.createDataFrame(rows, "pos int, k string, a string, b string, shared string")
    out = merge_groups(df, "k", ["shared"], ["k", "a", "b", "shared"], ["pos"], [F.floor(F.col("pos") / block)], trim_ends=trim)
    got = out.collect()
    assert len({r.k or "" for r in got}) == len(got) and not any(r.too_long for r in got)
    return {r.k or "": (r.a, r.b, r.shared, r.pos) for r in got}


@pytest.mark.parametrize("block", [1, 4, 1000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_groups(spark, seed, block):
    rnd = random.Random(seed)
    values = [None, "", "x", "y", "x,y", "z", "x,z"]
    weights = [1, 1, 8, 2, 1 if seed != 2 else 0, 2, 0 if seed < 3 else 2]
    rows = [(i, rnd.choice([None, "", "h", "h", "h", "u", f"k{i}"]), *rnd.choices(values, weights, k=2), f"s{i}") for i in range(80)]
    assert merged(spark, rows, block) == expected(rows)


@pytest.mark.parametrize("block", [1, 1000])
def test_merge_groups_trims_whole_text(spark, block):
    rows = [(i, "k", v, "  ", "s") for i, v in enumerate([" a ", " a ", " b ", "", " c ", " d "])]
    (a, b, _, _), = merged(spark, rows, block, trim=True).values()
    assert (a, b) == ("a , b , c , d", "")


def test_merge_echo(spark):
    rows = [(i, "k", v, v, "s") for i, v in enumerate(["a", "b", "a,b", "a,b", "c", "a,b", "a,b,c,a,b", "a,b"])]
    want = expected(rows)
    assert want["k"][0] == "a,b,c,a,b,a,b"
    assert merged(spark, rows, 1) == want == merged(spark, rows, 3) == merged(spark, rows, 100)


def test_merge_large_group(spark):
    n = 300_000
    rows = spark.range(n).select(
        F.col("id").cast("int").alias("pos"), F.lit("k").alias("k"),
        F.when(F.col("id") == 2, "v0,v1").otherwise(F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias("a"))
    got = merge_groups(rows, "k", [], ["k", "a"], ["pos"], [F.floor(F.col("pos") / 4096)]).collect()
    assert [r.a for r in got] == [fold(["v0,v1" if i == 2 else f"v{i % 7}" for i in range(n)])]


def test_merge_too_long(spark):
    rows = spark.createDataFrame([(i, "k" if i < 9 else "u", "abc" + str(i)) for i in range(10)], "pos int, k string, a string")
    got = merge_groups(rows, "k", [], ["k", "a"], ["pos"], [F.floor(F.col("pos") / 4)], max_chars=20).collect()
    assert sorted((r.k, r.a, r.too_long) for r in got if r.k == "u") == [("u", "abc9", False)]
    assert [(r.a, r.too_long) for r in got if r.k == "k"] == [(None, True)]


def test_merge_long_values_and_null_scope(spark):
    """Values that differ behind the characters of their name, echoes of long texts, and groups of no file."""
    long = "v" * 100
    values = [long, long, long + "x", f"{long},{long}x", long, "", f"{long},{long}x,{long}"]
    rows = [(f, i, "k", v) for f in (None, "f") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "f string, pos int, k string, a string")
    for block in (1, 3, 10):
        got = merge_groups(df, "k", [], ["k", "a"], ["pos"], [F.floor(F.col("pos") / block)], ["f"]).collect()
        assert sorted((r.f or "", r.a) for r in got) == [("", fold(values)), ("f", fold(values))]
    assert merge_groups(df.limit(0), "k", [], ["k", "a"], ["pos"], [F.col("pos")]).collect() == []
    only = merge_groups(df, "k", ["a"], ["k", "a"], ["pos"], [F.floor(F.col("pos") / 3)], ["f"]).collect()  # nothing to fold
    assert sorted((r.f or "", r.a) for r in only) == [("", long), ("f", long)]


def test_merge_of_one_block_moves_once(spark):
    """Without a group of several blocks no pieces of texts are shuffled, only rows and the keys of blocks."""
    rows = [(i, f"k{i % 5}", f"a{i}", "b", "s") for i in range(20)]
    df = spark.createDataFrame(rows, "pos int, k string, a string, b string, shared string")
    got = merge_groups(df, "k", ["shared"], ["k", "a", "b", "shared"], ["pos"], [F.floor(F.col("pos") / 1000)])
    assert {r.k: (r.a, r.b, r.shared, r.pos) for r in got.collect()} == expected(rows)
    assert "pieces" not in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "h", "g"]), st.sampled_from(["", "x", "y"]), st.sampled_from(["", "q", "q,x"])), min_size=1, max_size=20))
def test_merge_property(spark, data):
    rows = [(i, k, a, b, "s") for i, (k, a, b) in enumerate(data)]
    assert merged(spark, rows, 2) == expected(rows)


def test_join_children(spark):
    parents = spark.createDataFrame([(k, f"p{k}") for k in "abcd"], "k string, p string")
    children = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 100), ("c", 101), ("c", 102)], "k string, id int")
    got = sorted((r.k, r.p, r.id) for r in join_children(parents, children, "k").fillna(-1).collect())
    assert got == sorted([("a", "pa", i) for i in range(20)] + [("b", "pb", 100), ("c", "pc", 101), ("c", "pc", 102), ("d", "pd", -1)])


@pytest.mark.parametrize("width", [1, 2, 40])
def test_items_in_order(spark, width):
    rnd = random.Random(9)
    ids = [f"{rnd.randrange(16**6):06x}" for _ in range(33)]
    items = spark.createDataFrame([(i, "o" if n < 30 else "p", str(n), "n", 1, "s") for n, i in enumerate(ids)],
                                  "id string, order_id string, sku_code string, sku_name string, sku_quantity int, sku_spec string")
    got = query.items_nested(items, [F.substring("id", 1, width)]).collect()
    for order, own in (("o", range(30)), ("p", range(30, 33))):
        rows = sorted((r.position, r.skuCode) for r in got if r.order_id == order)
        assert rows == [(k + 1, str(n)) for k, n in enumerate(sorted(own, key=lambda n: ids[n]))]


def test_number_rows(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), n) for n in rnd.sample(range(1000), 60)]
    got = number_rows(spark.createDataFrame(rows, "g string, n int"), ["g"], [F.floor(F.col("n") / 100)], [F.col("n")], "pos").collect()
    for g in "ab":
        own = sorted((r.pos, r.n) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert [n for _, n in own] == sorted(n for k, n in rows if k == g)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_card_blocks(spark, grid, seed):
    rnd = random.Random(seed)
    lines = [rnd.choices(["start", "end", "start end", "x", ""], [2, 2, 1, 6, 1])[0] for _ in range(60)]
    want, start = [], None
    for i, line in enumerate(lines):
        if line.startswith("start"):
            start = i
        if start is not None:
            want.append((i, start, i - start))
            if line == "end":
                start = None
    rows = grid({"f": [("s", [[x] for x in lines])]})
    for block in (4, 7, 1000):
        got = cards.card_segment(rows, translate("^start"), translate("end$"), block)
        assert sorted((r.row_idx, r.card_start, r.card_off) for r in got.collect()) == want
