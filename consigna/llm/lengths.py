"""Token counts: an exact histogram of encoded lengths that answers every context limit.

Documents are encoded once; after that only (length, number of documents) rows remain. Suffix sums
over the lengths give, for any limit L, how many documents and tokens are longer, how many tokens
are left when every document is cut at L, and the quantiles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY_MAX = 64 * 2**20
#: Fixed split pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in one block of the suffix sums; lengths are under 2**31, so there are at most 2**18 blocks.
BLOCK = 2**13

_ENCODERS: dict[int, object] = {}


def vocabulary(folder: str = TOKENIZERS, name: str = RANKS) -> bytes:
    """The vocabulary file, read on the driver; tasks get its bytes, which VOCABULARY_MAX bounds."""
    with open(f"{folder}/{name}", "rb") as f:
        ranks = f.read(VOCABULARY_MAX + 1)
    if len(ranks) > VOCABULARY_MAX:
        raise ValueError(f"{name} is larger than {VOCABULARY_MAX} bytes")
    return ranks


def encoder(ranks: bytes):
    """The encoder for a vocabulary, made once in each Python process."""
    import tiktoken

    at = hash(ranks)
    if at not in _ENCODERS:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[at] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _ENCODERS[at]


def token_lengths(docs: DataFrame, by: list[str], ranks: bytes) -> DataFrame:
    """Columns by and length (tokens of the whole text) of each document; null and empty texts have 0."""
    own = [f"k{i}" for i in range(len(by))]
    docs = spread(docs.select(*[F.col(b).alias(o) for b, o in zip(by, own, strict=True)], F.col("text").alias("text")))
    vocab = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(o) for o in own], pa.array(n, pa.int64())], [*own, "length"])

    fields = ", ".join([*[f"{o} {docs.schema[o].dataType.simpleString()}" for o in own], "length long"])
    out = docs.mapInArrow(count, fields)
    return out.select(*[F.col(o).alias(b) for b, o in zip(by, own, strict=True)], "length")


#: Different limits that answer_limits takes.
LIMITS = 10_000


def length_histogram(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each length that occurs, within each group of by.

    n_docs, docs_at_least, tokens_at_least (documents this long or longer and their tokens),
    docs_at_most, truncated_total (tokens left when all documents are cut at this length) and
    share_at_most. Null group values are a group. No documents, no rows. Sums run inside blocks of
    lengths and over one row per block, so no task ranges over more than BLOCK lengths or 2**18 blocks
    of a group. Documents combine into counts before the shuffle, so a frequent length costs nothing.
    """
    by = by or []
    counts = staged(lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n_docs")), "length-counts")  # documents are encoded once
    counts = counts.withColumn("block", F.floor(F.col("length") / BLOCK))
    tokens = F.col("length") * F.col("n_docs")
    blocks = counts.groupBy(*by, "block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    after = Window.partitionBy(*by).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    blocks = blocks.select(
        *[F.col(b).alias(f"b_{i}") for i, b in enumerate(by)], F.col("block").alias("b_block"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    same: Column = F.col("block") == F.col("b_block")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"b_{i}"))
    here = Window.partitionBy(*by, "block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumns({"in_docs": F.sum("n_docs").over(here), "in_tokens": F.sum(tokens).over(here)}).join(blocks, same)
    docs_at_least, tokens_at_least = F.col("in_docs") + F.col("d"), F.col("in_tokens") + F.col("t")
    at_most = F.col("all_docs") - docs_at_least + F.col("n_docs")
    below = F.col("all_tokens") - tokens_at_least
    return out.select(
        *by, "length", "n_docs", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), at_most.alias("docs_at_most"),
        (below + F.col("length") * docs_at_least).alias("truncated_total"), (at_most / F.col("all_docs")).alias("share_at_most"))


def answer_limits(histogram: DataFrame, limits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of limits (column limit) with the answers for each group, from the suffix sums of length_histogram.

    docs_longer, tokens_longer (documents longer than the limit) and truncated_total: the sums at the next
    length that occurs. A null or negative limit counts as 0, equal limits as one; an empty histogram
    has no answer. More than LIMITS different limits are refused, as they go to each group as a list.
    Lengths and limits are ordered inside blocks of lengths, and a row per block names the next one's first.
    """
    by = by or []
    limit = F.greatest(F.coalesce(F.col("limit"), F.lit(0)), F.lit(0)).cast("long")
    asked = sorted(r["limit"] for r in limits.select(limit.alias("limit")).distinct().limit(LIMITS + 1).collect())
    if len(asked) > LIMITS:
        raise ValueError(f"more than {LIMITS} limits")
    sums = F.struct("length", "docs_at_least", "tokens_at_least")
    known = histogram.select(*by, F.col("length").alias("at"), sums.alias("x"))
    groups = histogram.groupBy(*by).agg(F.max("tokens_at_least").alias("all_tokens")).where(F.col("all_tokens").isNotNull())
    each = F.explode(F.lit(asked).cast("array<bigint>") if asked else F.array().cast("array<bigint>"))
    rows = known.withColumn("all_tokens", F.lit(None).cast("long")).unionByName(groups.select(*by, each.alias("at"), "all_tokens"), allowMissingColumns=True)
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    after = Window.partitionBy(*by).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*by, "block").agg(F.min("x").alias("x")).select(
        *[F.col(b).alias(f"b_{i}") for i, b in enumerate(by)], F.col("block").alias("b_block"), F.last("x", ignorenulls=True).over(after).alias("later"))
    # Downwards; at one length the limits come first, so what is before a limit is longer.
    longer = Window.partitionBy(*by, "block").orderBy(F.desc("at"), F.col("x").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    same: Column = F.col("block") == F.col("b_block")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"b_{i}"))
    found = rows.withColumn("next", F.last("x", ignorenulls=True).over(longer)).where("x IS NULL").join(heads, same)
    found = found.withColumn("next", F.coalesce("next", "later"))
    docs, tokens = (F.coalesce(F.col(f"next.{c}_at_least"), F.lit(0)).cast("long") for c in ("docs", "tokens"))
    return found.select(
        *by, F.col("at").alias("limit"), docs.alias("docs_longer"), tokens.alias("tokens_longer"), (F.col("all_tokens") - tokens + F.col("at") * docs).alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """The smallest length that at least each share of the documents does not exceed."""
    by = by or []
    return histogram.groupBy(*by).agg(*[
        F.min(F.when(F.col("share_at_most") >= q, F.col("length"))).alias(f"q{round(q * 1000)}") for q in shares])
