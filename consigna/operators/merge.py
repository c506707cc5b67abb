"""Ordered merging of records that share one field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consigna.functions.text import is_empty, text_or_empty, trim
from consigna.schema import MAX_TEXT


#: Characters of a value that stand in its name; a longer value is named by these and its digest.
NAMED = 64


def _chars(values: Column) -> Column:
    """Characters that values add to a text, a comma before each."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x) + 1)


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _second(values: Column) -> Column:
    """Place of the first value that differs from the first one; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(values, lambda x: x != _first(values)), True).cast("int"), F.lit(0))


def _from(values: Column, place: Column) -> Column:
    return F.slice(values, F.greatest(place, F.lit(1)), F.when(place > 0, F.size(values)).otherwise(0))


def _name(value: Column) -> Column:
    """A text of bounded length that only equal values share: the value, or its start and digest."""
    return F.when(F.length(value) <= NAMED, value).otherwise(F.concat(F.substring(value, 1, NAMED), F.sha2(value, 256)))


def _may_echo(values: Column, second: Column) -> Column:
    """Whether a value could equal the text that starts with these values: as long as it, and beginning with the first."""
    return F.aggregate(
        _from(values, second), F.struct(F.length(_first(values)).cast("bigint").alias("n"), F.lit(False).alias("hit")),
        lambda a, x: F.struct(
            (a["n"] + F.length(x) + 1).alias("n"),
            (a["hit"] | ((F.length(x) == a["n"]) & F.startswith(x, F.concat(_first(values), F.lit(","))))).alias("hit")),
        lambda a: a["hit"],
    )


def _state(values: Column, second: Column) -> Column:
    """What other blocks need to know of a block's values of a field; its size is bounded. NULL without values.

    lead and rest are the characters before and from the second different value; comma is the length of
    the longest value with a comma, as no other value can equal a text of two values.
    """
    first = _first(values)
    return F.when(F.size(values) > 0, F.struct(
        _name(first).alias("name"), F.length(first).cast("bigint").alias("length"), (second > 0).alias("differs"),
        (F.when(second > 0, second - 1).otherwise(F.size(values)) * (F.length(first) + 1)).cast("bigint").alias("lead"),
        _chars(_from(values, second)).alias("rest"), F.array_max(F.transform(values, F.length)).alias("longest"),
        F.coalesce(F.array_max(F.transform(F.filter(values, lambda x: F.contains(x, F.lit(","))), F.length)), F.lit(0)).alias("comma"),
        _may_echo(values, second).alias("echo"),
    ))


def _alone(values: Column, second: Column, max_chars: int) -> Column:
    """The text of a group that is one block, and whether it is too long to be one value.

    Only a value with a comma can equal a text of two values, so most groups are joined without being folded.
    """
    others = _from(values, second)
    total = F.coalesce(F.length(_first(values)) + F.when(second > 0, _chars(others)).otherwise(0), F.lit(0))
    echo = F.exists(values, lambda x: F.contains(x, F.lit(","))) & _may_echo(values, second)
    whole = F.when(second == 0, _first(values)).when(echo, _folded(values, F.array_max(F.transform(values, F.length)))).otherwise(
        F.array_join(F.concat(F.slice(values, 1, 1), others), ","))
    return _first(F.transform(F.array(total), lambda n: F.struct(F.when(n <= max_chars, whole).alias("text"), (n > max_chars).alias("too_long"))))


def _scanned(states: DataFrame) -> DataFrame:
    """For each block of groups with several: how its values of each field enter the text of the group.

    states has _g (group), _r (run) and _s (a state for each field); windows hold no values. `whole`: all values
    of the block count, not only those from the second different one on; `head`: the group's first value is
    here; `total`, `longest` and `echo` are of the group.
    """
    group = Window.partitionBy("_g", "field")
    along = group.orderBy("_r")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = states.select("_g", "_r", F.posexplode("_s").alias("field", "s"))
    rows = rows.withColumn("v", F.first("s", ignorenulls=True).over(every))
    other = F.col("s.name") != F.col("v.name")
    rows = rows.withColumns({
        "head": F.col("s").isNotNull() & (F.coalesce(F.count("s").over(before), F.lit(0)) == 0),
        "whole": F.coalesce(F.max(other | F.col("s.differs")).over(before), F.lit(False)) | F.coalesce(other, F.lit(False))})
    rows = rows.withColumn("added", F.coalesce(F.when(F.col("whole"), F.col("s.lead")).otherwise(0) + F.col("s.rest"), F.lit(0)))
    rows = rows.withColumn("start", F.col("v.length") + F.coalesce(F.sum("added").over(before), F.lit(0)))
    hit = F.when(F.col("head"), F.col("s.echo")).otherwise(F.col("start") <= F.col("s.comma"))
    rows = rows.select("_g", "_r", "field", F.struct(
        "whole", (F.col("v.length") + F.sum("added").over(every)).alias("total"), F.max("s.longest").over(every).alias("longest"),
        F.coalesce(F.max(hit).over(every), F.lit(False)).alias("echo"), "head").alias("p"))
    found = rows.groupBy("_g", "_r").agg(F.sort_array(F.collect_list(F.struct("field", "p"))).alias("_all"))
    return found.select(F.struct(F.col("_g").alias("group"), F.col("_r").alias("runs")).alias("_at"), F.col("_all.p").alias("_several"))


def _folded(values: Column, longest: Column) -> Column:
    """Ordered fold: a value equal to the text so far is skipped.

    A text longer than the longest value can equal none; from there on values are joined at once.
    """
    return F.aggregate(
        values, F.struct(_first(values).alias("t"), F.lit(0).alias("k")),
        lambda a, x: F.when(F.length(a["t"]) > longest, a).otherwise(F.struct(
            F.when(x == a["t"], a["t"]).otherwise(F.concat(a["t"], F.lit(","), x)).alias("t"), (a["k"] + 1).alias("k"))),
        lambda a: F.when(a["k"] >= F.size(values), a["t"]).otherwise(
            F.concat(a["t"], F.lit(","), F.array_join(F.slice(values, a["k"] + 1, F.size(values)), ","))))


def merge_groups(
    records: DataFrame, group_by: str, shared: list[str], fields: list[str], order: list[str],
    block: list[Column], scope: list[str] | None = None, trim_ends: bool = False, max_chars: int = MAX_TEXT,
) -> DataFrame:
    """One record per value of `group_by`, however many rows it has; blanks form one group.

    Shared fields, the key and the order columns come from the first record. The other `fields`
    are folded in record order: an empty value and a value equal to the text so far are skipped,
    others are appended after a comma. `scope` (the file) limits a group, `order` is unique in it.
    `trim_ends` strips white space from both ends of the folded text.

    `block` cuts a group into runs along `order`. Rows are folded inside their block, and a block has a
    small state: the name of its first value, lengths and flags. The states of a group are scanned in order,
    without the values; a block's values leave it only as its piece of a text that fits. A group of one block
    is told by the keys of all blocks, and ends where its block is: nothing of it moves again. Only a group in
    which a value may equal the text so far, told by lengths, is folded value by value. A text longer than
    max_chars cannot be one value: it is NULL and `too_long` is true, and none of its values move.
    """
    scope = scope or []
    folded = [f for f in fields if f != group_by and f not in shared]
    keep = [f for f in fields if f not in folded]
    group = F.struct(*[F.col(c) for c in scope], text_or_empty(F.col(group_by)).alias("_key"))
    runs = F.struct(*[b.alias(f"_b{i}") for i, b in enumerate(block)])
    rows = records.withColumn("_at", F.struct(group.alias("group"), runs.alias("runs")))
    blocks = rows.groupBy("_at").agg(
        F.min(F.struct(*order, *keep)).alias("_first"),
        F.sort_array(F.collect_list(F.struct(*order, *[F.when(~is_empty(F.col(f)), F.col(f)).alias(f"_v_{f}") for f in folded]))).alias("_rows"),
    ).where(F.col("_first").isNotNull() & (F.size("_rows") > 0))  # all are; asked so that keys, states and values read the same exchange
    keys = blocks.select(F.col("_at.group").alias("_g"), F.col("_at.runs").alias("_r"))
    several = keys.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_g"))).where("_n > 1").select(
        F.struct(F.col("_g").alias("group"), F.col("_r").alias("runs")).alias("_at"))

    def listed(some: DataFrame) -> DataFrame:
        return some.select("_at", "_first", F.transform(
            F.array(*[F.col("_rows")[f"_v_{f}"] for f in folded]) if folded else F.array().cast("array<array<string>>"),
            lambda values: F.filter(values, lambda x: x.isNotNull())).alias("_x"))

    ends = trim if trim_ends else (lambda c: c)
    alone = listed(blocks.join(several, "_at", "left_anti")).withColumn("_two", F.transform("_x", _second)).select(
        F.col("_at.group").alias("_g"), "_first", F.zip_with("_x", "_two", lambda values, second: _alone(values, second, max_chars)).alias("_a"))
    alone = alone.select(
        "_g", "_first", F.transform("_a", lambda a: F.when(~a["too_long"], ends(text_or_empty(a["text"])))).alias("_t"),
        F.exists("_a", lambda a: a["too_long"]).alias("too_long"))
    parts = listed(blocks.join(several, "_at", "left_semi")).withColumn("_two", F.transform("_x", _second))
    parts = parts.withColumn("_s", F.zip_with("_x", "_two", _state))
    scanned = _scanned(parts.select(F.col("_at.group").alias("_g"), F.col("_at.runs").alias("_r"), "_s"))
    parts = parts.join(scanned, "_at", "left").withColumn("_p", F.coalesce("_several", F.array().cast(scanned.schema["_several"].dataType)))

    def piece(z: Column) -> Column:
        """A block's text behind the blocks before, or its values where these are to be folded."""
        x, p = z["_x"], z["_p"]
        added = F.when(p["whole"], x).otherwise(_from(x, z["_two"]))
        both = F.when(p["head"], F.concat(F.slice(x, 1, 1), added)).otherwise(added)
        text = F.concat(F.when(p["head"] | (F.size(both) == 0), F.lit("")).otherwise(F.lit(",")), F.array_join(both, ","))
        return F.when(F.coalesce(p["total"], F.lit(0)) <= max_chars, F.struct(
            F.when(~p["echo"], text).alias("text"), F.when(p["echo"], both).alias("values")))

    pieces = F.transform(F.arrays_zip("_x", "_two", "_p"), piece)
    merged = parts.groupBy(F.col("_at.group").alias("_g")).agg(
        F.min("_first").alias("_first"), F.sort_array(F.collect_list(F.struct("_at.runs", pieces.alias("pieces")))).alias("_blocks"),
        F.max(F.transform("_p", lambda p: F.struct(p["total"].alias("total"), p["longest"].alias("longest"), p["echo"].alias("echo")))).alias("_p"))  # the same in each block

    def text(p: Column, i: Column) -> Column:
        joined = F.array_join(F.transform("_blocks", lambda b: F.get(b["pieces"], i)["text"]), "")
        values = F.flatten(F.transform("_blocks", lambda b: F.get(b["pieces"], i)["values"]))
        whole = F.when(p["echo"], _folded(values, p["longest"])).otherwise(joined)
        return F.when(F.coalesce(p["total"], F.lit(0)) <= max_chars, ends(text_or_empty(whole)))

    merged = merged.select("_g", "_first", F.transform("_p", text).alias("_t"), F.exists("_p", lambda p: F.coalesce(p["total"], F.lit(0)) > max_chars).alias("too_long"))
    return alone.unionByName(merged).select(
        *[F.col("_g")[c].alias(c) for c in scope], *[F.col("_first")[c].alias(c) for c in [*order, *keep]],
        *[F.col("_t")[i].alias(f) for i, f in enumerate(folded)], "too_long",
    ).select(*scope, *order, *fields, "too_long")
