"""Help for groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def join_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Left join of unique parents with children, where one parent may own most children.

    The inner join can be split by adaptive execution at any key; the parents without children come
    from an anti join against the distinct keys. No list of large keys is needed.
    """
    with_ = parents.join(children, key)
    childless = parents.join(children.select(key).distinct(), key, "left_anti")
    return with_.unionByName(childless, allowMissingColumns=True)


def number_rows(
    df: DataFrame, keys: list[str], block: list[Column], order: list[Column], name: str
) -> DataFrame:
    """Dense 1-based position of each row in its group, without one task per group.

    `block` cuts a group into consecutive runs along `order`: rows are numbered inside their run,
    and each run adds the row count of the runs before it.
    """
    cols = [f"_b{i}" for i in range(len(block))]
    df = df.withColumns(dict(zip(cols, block)))
    before = Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(before))
        .filter(F.col("_before") > 0)
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, *cols).orderBy(*order)
    return (
        df.withColumn(name, F.row_number().over(inside))
        .join(offsets, [*keys, *cols], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop(*cols, "_before")
    )
