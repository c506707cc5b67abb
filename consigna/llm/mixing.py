"""Mixing sources to target weights by pivotal dependent rounding.

A source whose words should grow r-fold gives each of its documents r copies on average: floor(r)
certain ones and one more with probability p = r - floor(r). Two documents of a source at a time
trade mass (probability times size) until one probability is 0 or 1, so the words taken are kept
exactly while each document's own chance stays p. What is left of a bucket is one open document for
each source; these meet in a tree of small groups, level by level, until one is left.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged, words

COPIES_MAX = 3


def source_targets(sizes: DataFrame, cap: int = COPIES_MAX) -> DataFrame:
    """source, source_size, target, rate from (source, size) rows.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... All words are shared by weight;
    a share stops at cap times the source's size and what is over goes to the others by weight. That
    share is min(cap * size, level * weight) for one level, found from running sums over the sources
    in the order in which they reach the cap. One row for each source; a source of size 0 gets 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # binary order of UTF-8 is that of code points
    by = by.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every),
        "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap, "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # The level if this source and all after it stay under the cap; the first for which that holds counts.
    by = by.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("used")))
    first = F.struct(F.row_number().over(order).alias("at"), "level")
    by = by.withColumn("first", F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), first))
    by = by.withColumn("level", F.min("first").over(every)["level"])
    by = by.withColumn("target", F.least(F.col("source_size") * float(cap), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return by.select("source", "source_size", "target", rate.alias("rate"))


def _draw(seed: int, level: int, *keys) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    h = hashlib.blake2b(repr((seed, level, *keys)).encode(), digest_size=8).digest()
    return int.from_bytes(h, "big") / 2.0**64


def _pivot(rows: list[tuple], seed: int, level: int, last: bool) -> list[float]:
    """New probabilities of (key, source, p, size) rows, in their order. Open at most: one per source."""
    p = [r[2] for r in rows]
    open_: dict = {}
    for i, (key, source, _, size) in enumerate(rows):
        if not 0.0 < p[i] < 1.0 or size <= 0:
            continue
        j = open_.get(source)
        if j is None:
            open_[source] = i
            continue
        wi, wj = float(size), float(rows[j][3])
        up = min((1.0 - p[j]) * wj, p[i] * wi)
        down = min(p[j] * wj, (1.0 - p[i]) * wi)
        if _draw(seed, level, key, rows[j][0]) * (up + down) < down:
            full, empty = (1.0 - p[j]) * wj <= p[i] * wi, p[i] * wi <= (1.0 - p[j]) * wj
            p[j], p[i] = (1.0 if full else p[j] + up / wj), (0.0 if empty else p[i] - up / wi)
        else:
            empty, full = p[j] * wj <= (1.0 - p[i]) * wi, (1.0 - p[i]) * wi <= p[j] * wj
            p[j], p[i] = (0.0 if empty else p[j] - down / wj), (1.0 if full else p[i] + down / wi)
        still = [k for k in (j, i) if 0.0 < p[k] < 1.0]
        if still:
            open_[source] = still[0]
        else:
            del open_[source]
    if last:
        for i in open_.values():
            p[i] = 1.0 if _draw(seed, level, rows[i][0], "last") < p[i] else 0.0
    return p


def _settle(seed: int, level: int, last: bool):
    def settle(rows: pa.Table) -> pa.Table:
        at = list(zip(*[rows[c].to_pylist() for c in ("key", "source", "p", "size")], strict=True))
        order = sorted(range(len(at)), key=lambda i: (at[i][0] is None, at[i][0] or 0, at[i][1] is None, at[i][1] or "", at[i][3]))
        p = [0.0] * len(at)
        for i, v in zip(order, _pivot([at[i] for i in order], seed, level, last), strict=True):
            p[i] = v
        return rows.set_column(rows.column_names.index("p"), rows.schema.field("p"), pa.array(p, pa.float64()))

    return settle


def round_copies(docs: DataFrame, seed: int = 20, bucket_rows: int = 20_000, fan_in: int = 64) -> DataFrame:
    """(key, source, size, rate, ...) rows with their whole number of copies.

    Buckets are hashes of the key, so a source that holds most rows is spread over all of them. Their
    number follows the number of rows; a bucket holds about bucket_rows small rows. Each level is
    written to the shared folder. Rows with equal keys are told apart by their size and source only;
    they may get different numbers of copies. The outcome depends on keys, sizes and seed alone.
    """
    n = docs.count()
    buckets = max(1, -(-n // bucket_rows))
    first = docs.withColumns({
        "p": F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)),
        "bucket": F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(buckets)),
    })
    done, level = [], 0
    now = first
    schema = now.schema
    while True:
        last = buckets == 1

        after = staged(now.groupBy("bucket").applyInArrow(_settle(seed, level, last), schema), f"mix-{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(after.where(~open_))
        if last:
            break
        buckets, level = -(-buckets // fan_in), level + 1
        now = after.where(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in)).select(*schema.names)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.withColumn("copies", (F.floor("rate") + F.col("p")).cast("long")).drop("p", "bucket")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null and empty texts have none)."""
    return spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def mix(docs: DataFrame, seed: int = 20, bucket_rows: int = 20_000) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    Null sources are one source, null ids one key. Empty input gives no rows. Only ids, sources and
    sizes are shuffled. The words taken of a source differ from its target by less than its largest
    document.
    """
    sizes = staged(document_sizes(docs), "mix-sizes")
    targets = source_targets(sizes).withColumnRenamed("source", "__s")
    # One small row for each source: Spark broadcasts it when it is under its own threshold.
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("__s")), "left").select(
        F.col("doc_id").alias("key"), "source", "size", "source_size", "target", "rate")
    out = round_copies(rows, seed, bucket_rows)
    return out.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
