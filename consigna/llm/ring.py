"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at many places of a ring; a document belongs to the shard at the first place clockwise
from the hash of its id. A shard is full when its bytes reach its capacity, the mean load and some slack;
documents that come to a full shard continue clockwise to the next shard that is not. So no shard holds
more than its capacity and one document, and a document leaves its own shard only because that is full.

Everything is done by DataFrame functions. A shard takes its documents in an order (large ones first, then
by another hash), cut into buckets: sums of buckets tell which buckets it takes whole, and only in the one
bucket where it becomes full are documents looked at one by one. Each turn fills one more shard at least.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged

#: Places of each shard on the ring.
PLACES = 256
#: Places on the ring are numbers under 2**62, found by their first bits.
RING_BITS = 62
CELL_BITS = 12
#: Documents over this share of a shard's capacity are taken first, so that what is over a capacity is small.
LARGE = 1 / 1024


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("/".join(map(str, parts)).encode()).digest()[:8], "big") >> 64 - RING_BITS


def ring(shards: int, places: int = PLACES) -> list[tuple[int, list[int]]]:
    """(place, shards in the order in which a walk clockwise from there meets them), by place."""
    at = sorted((_hash(s, k), s) for s in range(shards) for k in range(places))
    out, nearest = [], []
    for place, s in reversed(at + at):  # twice around, so that each walk meets all shards
        nearest = [s, *[x for x in nearest if x != s]]
        out.append((place, nearest))
    return out[::-1][:len(at)]


def _cells(df: DataFrame, shards: int, places: int) -> DataFrame:
    """cell, arcs: the places in each cell of the ring and the first one behind it. Its size is set by the parameters alone."""
    every = ring(shards, places)
    width = 1 << RING_BITS - CELL_BITS
    rows, k = [], 0
    for cell in range(1 << CELL_BITS):
        j = k
        while j < len(every) and every[j][0] < (cell + 1) * width:
            j += 1
        end = [(1 << RING_BITS, every[j % len(every)][1])]
        rows.append({"cell": cell, "arcs": [{"to": p, "walk": w} for p, w in [*every[k:j], *end]]})
        k = j
    schema = "array<struct<cell:long,arcs:array<struct<to:long,walk:array<int>>>>>"
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("x")).select("x.*")


def _first(walk: Column, full: list[int]) -> Column:
    """The first shard of a walk that is not full."""
    open_ = F.filter(walk, lambda s: ~s.isin(full)) if full else walk
    return F.get(open_, F.lit(0))


def _running(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """by, bucket, sum of value (name) and the sum over the buckets before (name_before)."""
    sums = rows.groupBy(by, "bucket").agg(F.sum(value).alias(name))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    return sums.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0).cast("long")))


def place(docs: DataFrame, shards: int, capacity: int, places: int = PLACES, buckets: int = 1) -> DataFrame:
    """(doc_id, size, ...) rows with home and shard: where the ring puts them and where they are.

    docs is read several times and should be a stored table with a column uid that tells equal rows apart.
    """
    position = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("ring")), 64 - RING_BITS)
    cells = F.broadcast(_cells(docs, shards, places))  # 2**CELL_BITS rows, whatever the documents are
    rows = docs.withColumns({"at": position, "draw": F.xxhash64("doc_id", F.lit("order"))})
    large = F.col("size") >= capacity * LARGE
    rows = rows.withColumn("bucket", F.when(large, F.lit(-1)).otherwise(F.pmod("draw", F.lit(buckets))).cast("long"))
    rows = rows.join(cells, F.shiftright("at", RING_BITS - CELL_BITS) == F.col("cell"))
    walk = F.get(F.filter("arcs", lambda a: a["to"] >= F.col("at")), F.lit(0))["walk"]
    rows = rows.withColumn("walk", walk).drop("arcs", "cell", "at").withColumn("home", F.get("walk", F.lit(0)))
    loads, done, now = dict.fromkeys(range(shards), 0), [], staged(rows, "ring-rows")
    while True:
        full = [s for s, n in loads.items() if n >= capacity]
        now = now.withColumn("shard", _first(F.col("walk"), full))
        room = F.lit(capacity)
        for s, n in loads.items():
            room = F.when(F.col("shard") == s, F.lit(capacity - n)).otherwise(room)
        sums = staged(_running(now, "shard", F.col("size"), "sum").withColumn("room", room), "ring-sums")
        sums = sums.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), "room", F.col("sum_before").alias("before"), (F.col("sum_before") + F.col("sum")).alias("after"))
        now = now.join(sums, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
        # The bucket in which a shard becomes full: a document is taken when there is room before it.
        several = Window.partitionBy("shard", "bucket").rowsBetween(Window.unboundedPreceding, -1)
        by_size, by_draw = several.orderBy(F.desc("size"), "draw", "doc_id", "uid"), several.orderBy("draw", "doc_id", "size", "uid")
        held = F.when(F.col("bucket") < 0, F.sum("size").over(by_size)).otherwise(F.sum("size").over(by_draw))
        edge = now.where("before < room AND after > room").withColumn("taken", F.col("before") + F.coalesce(held, F.lit(0)) < F.col("room"))
        sure = now.where("before >= room OR after <= room").withColumn("taken", F.col("after") <= F.col("room"))
        turn = staged(sure.union(edge).drop("after", "before", "room"), "ring-turn")
        done.append(turn.where("taken").drop("walk", "taken"))
        state = turn.groupBy("shard", "taken").agg(F.sum("size").alias("n")).collect()  # two rows for each shard
        for r in state:
            loads[r["shard"]] += r["n"] if r["taken"] else 0
        if all(r["taken"] for r in state):
            break
        now = turn.where("NOT taken").drop("shard", "taken")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def shard_documents(docs: DataFrame, shards: int = 16, slack: float = 0.0, places: int = PLACES, bucket_rows: int = 20_000) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, home.

    The law is `bytes`: a shard's bytes are under its capacity, the mean times 1 + slack rounded up, and one
    document that is small unless it is larger than what is left alone. slot numbers the documents of a shard
    from 0 without gaps. The outcome depends on ids, sizes and the number of shards; equal ids with equal
    sizes are told apart by their place in the input. Null texts have size 1 and the CRC of no bytes; null
    ids hash like each other. No documents, no rows. grown_shard is null: with one more shard, documents
    move to it, and some between the others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = spread(docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")))
    rows = staged(rows.select(
        "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("uid")), "ring-documents")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    capacity = max(1, -(-int(total["bytes"] * (1 + slack)) // shards))
    buckets = max(1, total["n"] // (shards * bucket_rows) + 1) * 4
    placed = place(rows, shards, capacity, places, buckets)
    counts = _running(placed, "shard", F.lit(1).cast("long"), "n").select(F.col("shard").alias("s"), F.col("bucket").alias("b"), "n_before")
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("draw", "doc_id", "size", "uid")).cast("long")
    out = placed.withColumn("within", within).join(counts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("n_before") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("home").cast("int").alias("home"))
