"""Resampling towards a target distribution by importance weights of hashed n-grams.

Every run of one to three words is a feature, its bucket the CRC of its bytes. Documents and target texts
are counted by bucket; the logarithm of the ratio of the two distributions is a bucket's gain, and a
document's weight the sum of the gains of its features. Noise that depends on the id alone turns weights
into a draw without replacement.

A task takes texts in batches of about a megabyte and interns their features: an open-addressed table of
NumPy arrays, keyed by xxHash64 of the bytes and checked byte by byte, gives each occurrence its slot. A
slot holds bucket and count once, so CRCs are worked out for different features only; a histogram reads
counts and buckets of the slots, a weight gathers the gains of the slots of a document's occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged

#: Fixed by the contract: longest run, buckets, words from which a document is in the draw, seed.
RUN = 3
BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 42
#: Bytes of text that are interned together; a longer text is cut between words, its runs counted whole.
BATCH = 1 << 20

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of xxHash64
_CRC: list[np.ndarray] = []
_LOW: list[np.ndarray] = []


def _word_bytes() -> np.ndarray:
    """For each byte the byte in lower case when it is part of a word, else 0."""
    if not _LOW:
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        low[:48], low[58:65], low[91:97], low[123:128] = 0, 0, 0, 0
        _LOW.append(low)
    return _LOW[0]


def _crc_table() -> np.ndarray:
    if not _CRC:
        c = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
        _CRC.append(c)
    return _CRC[0]


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, least byte first; data ends in eight spare bytes."""
    out = data[:-7].astype(np.uint64)
    for i in range(1, 8):
        out |= data[i:len(data) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    return _turn(x * _P2, 31) * _P1


def xxhash64(lanes: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxHash64 of the bytes at start, for all of them at once."""
    h = np.full(len(start), seed, np.uint64) + _P5
    at = start.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        zero = np.full(len(long), seed, np.uint64)
        a = [zero + _P1 + _P2, zero + _P2, zero.copy(), zero - _P1]
        stripes = size[long] // 32
        for k in range(int(stripes.max())):
            go = np.flatnonzero(stripes > k)
            for i in range(4):
                a[i][go] = _turn(a[i][go] + lanes[start[long[go]] + 32 * k + 8 * i] * _P2, 31) * _P1
        x = _turn(a[0], 1) + _turn(a[1], 7) + _turn(a[2], 12) + _turn(a[3], 18)
        for v in a:
            x = (x ^ _mixed(v)) * _P1 + _P4
        h[long] = x
        at[long] += 32 * stripes
    h += size.astype(np.uint64)
    left = start + size - at
    for _ in range(3):
        go = np.flatnonzero(left >= 8)
        if not len(go):
            break
        h[go] = _turn(h[go] ^ _mixed(lanes[at[go]]), 27) * _P1 + _P4
        at[go] += 8
        left[go] -= 8
    go = np.flatnonzero(left >= 4)
    h[go] = _turn(h[go] ^ (lanes[at[go]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at[go] += 4
    left[go] -= 4
    for _ in range(3):
        go = np.flatnonzero(left > 0)
        h[go] = _turn(h[go] ^ (lanes[at[go]] & np.uint64(255)) * _P5, 11) * _P1
        at[go] += 1
        left[go] -= 1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes at start, for all of them at once."""
    table, order = _crc_table(), np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    c = np.full(len(start), 0xFFFFFFFF, np.uint32)
    more = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # those longer than k come first
    for k, n in enumerate(more.tolist()):
        c[:n] = table[(c[:n] ^ data[start[:n] + k]) & 255] ^ c[:n] >> 8
    out = np.empty(len(c), np.uint32)
    out[order] = ~c
    return out


def _same(lanes: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes at a and at b are equal."""
    out = np.ones(len(a), bool)
    go = np.arange(len(a))
    for k in range(0, int(size.max(initial=0)), 8):
        left = size[go] - k
        tail = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        differ = (lanes[a[go] + k] ^ lanes[b[go] + k]) << (np.uint64(64) - tail) != 0
        out[go[differ]] = False
        go = go[(left > 8) & ~differ]
        if not len(go):
            break
    return out


def intern(lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table: for each slot the occurrence that owns it or -1, and for each occurrence its slot.

    All occurrences probe at once. An empty slot goes to one of those that meet there; an occurrence stays
    at a slot whose owner has its hash, its size and its bytes, and else goes on to the next slot.
    """
    bits = max(4, int(2 * len(start)).bit_length())
    owner = np.full(1 << bits, -1, np.int32)
    slot = np.empty(len(start), np.int32)
    key = xxhash64(lanes, start, size)
    at = (key >> np.uint64(64 - bits)).astype(np.int32)
    left = np.arange(len(start), dtype=np.int32)
    while len(left):
        free = owner[at] < 0
        owner[at[free]] = left[free]
        own = owner[at]
        here = own == left
        alike = np.flatnonzero(~here & (key[own] == key[left]) & (size[own] == size[left]))
        here[alike] = _same(lanes, start[own[alike]], start[left[alike]], size[left[alike]])
        slot[left[here]] = at[here]
        left, at = left[~here], (at[~here] + 1) & ((1 << bits) - 1)
    return owner, slot


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, words, slot of each occurrence, bucket and count of each slot) for batches of texts.

    The first array has the text that each occurrence is in, the second the number of words that begin in
    the batch for each text. A text over a batch comes in parts; runs over a border are in the part before.
    """
    part: list[tuple[int, bytes]] = []
    room = 0
    for i, t in enumerate(texts):
        t = t or b""
        if room and room + len(t) > BATCH:
            yield _batch(part, len(texts))
            part, room = [], 0
        if len(t) > BATCH:
            yield from _long(i, t, len(texts))
        else:
            part.append((i, t))
            room += len(t) + 1
    if part:
        yield _batch(part, len(texts))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased word bytes, 0 for others, and where words start and end."""
    low = _word_bytes()[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low > 0
    edge = np.diff(inside)
    return low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _long(i: int, text: bytes, n: int) -> Iterator[tuple]:
    """A text over a batch, cut before words; each part sees the RUN - 1 words behind it too."""
    _, start, end = _words(np.frombuffer(text, np.uint8))
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(start, start[first] + BATCH)))
        over = min(len(start), last + RUN - 1)
        yield _batch([(i, text[start[first]:end[over - 1]])], n, last - first)
        first = last


def _batch(part: list[tuple[int, bytes]], n: int, starts: int | None = None) -> tuple:
    """Features of some texts; with starts, only those that begin at one of so many first words."""
    data = np.frombuffer(b" ".join(t for _, t in part) + b" ", np.uint8)
    low, start, end = _words(data)
    edges = np.cumsum([len(t) + 1 for _, t in part])
    of = np.searchsorted(edges, start, "right")
    # Words one blank apart, so that a run of words is a stretch of bytes.
    keep = low > 0
    keep[end] = True
    clean = np.append(np.where(low > 0, low, 32)[keep].astype(np.uint8), np.zeros(8, np.uint8))
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(size) else size
    begins, sizes, texts = [], [], []
    ids = np.array([i for i, _ in part], np.int64)
    for k in range(1, RUN + 1):
        m = max(0, len(start) - k + 1)
        one = np.flatnonzero(of[:m] == of[k - 1:])
        if starts is not None:
            one = one[one < starts]
        begins.append(at[one])
        sizes.append(at[one + k - 1] + size[one + k - 1] - at[one])
        texts.append(ids[of[one]])
    begin, length, text = map(np.concatenate, (begins, sizes, texts))
    lanes = _lanes(clean)
    owner, slot = intern(lanes, begin, length)
    used = np.flatnonzero(owner >= 0)
    bucket = np.zeros(len(owner), np.int64)
    bucket[used] = crc32(clean, begin[owner[used]], length[owner[used]]) % BUCKETS
    words = np.bincount(texts[0], minlength=n)
    return text, words, slot, bucket, np.bincount(slot, minlength=len(owner))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Feature occurrences in each bucket over all rows of column text (binary); tasks add up theirs first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, _, bucket, times in features(b.column("text").to_pylist()):
                np.add.at(total, bucket[times > 0], times[times > 0])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of the smoothed distributions, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row (doc_id, text as binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            n = len(b)
            words, occurrences, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, begun, slot, bucket, _ in features(b.column("text").to_pylist()):
                words += begun
                occurrences += np.bincount(text, minlength=n)
                # Sums of whole numbers far under 2**53 are exact in doubles.
                weight += np.bincount(text, weights=gain[bucket][slot], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in (words, occurrences, weight)]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, parts: int) -> DataFrame:
    """rows with rank 1, 2, ... by score from the highest, then doc_id: sorted ranges, each numbered from the rows before it."""
    ranges = rows.repartitionByRange(parts, F.desc("score"), F.asc("doc_id")).withColumn("range", F.spark_partition_id())
    ranges = staged(ranges, "importance-ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    sizes = sizes.select(F.col("range").alias("at"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("score"), "doc_id"))
    return ranges.withColumn("place", place).join(F.broadcast(sizes), F.col("range") == F.col("at")).withColumn(
        "rank", (F.col("before") + F.col("place")).cast("long")).drop("range", "at", "before", "place")


def resample(docs: DataFrame, target: DataFrame, share: int = 5, rows_per_range: int = 100_000) -> DataFrame:
    """One row for each document: doc_id, n_features, weight, score, rank (null when it is not drawn).

    share is in hundredths of the documents with LEAST_WORDS words or more. Null texts are empty: no
    features, weight 0. Rows without an id get the noise of the empty id and come last among equal scores.
    Repeated rows count and are drawn each. Without target texts all buckets get the smoothed gain. Sizes
    of tables and draws are counted; nothing but bucket counts comes to the driver.
    """
    texts = lambda df, *keep: spread(df.select(*keep, F.col("text").cast("string").cast("binary").alias("text")))
    gain = gains(bucket_counts(texts(docs)), bucket_counts(texts(target)))
    scored = weigh(texts(docs, F.col("doc_id").cast("long").alias("doc_id")), gain)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = staged(scored.withColumn("score", F.col("weight") + noise), "importance-scores")
    long = scored.where(F.col("n_words") >= LEAST_WORDS)
    n = long.count()
    ids = F.coalesce("doc_id", F.lit(2**63 - 1))
    ranked = _ranked(long.withColumn("id", F.col("doc_id")).withColumn("doc_id", ids), max(1, -(-n // rows_per_range)))
    rank = F.when(F.col("rank") <= share * n // 100, F.col("rank")).alias("rank")
    rest = scored.where(F.col("n_words") < LEAST_WORDS).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank).union(rest)
