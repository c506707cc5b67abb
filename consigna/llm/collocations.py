"""Phrase collocations, counted in quotient filters.

Words that occur often enough get numbers. An n-gram is its word numbers packed into one value of 2 h
bits; an invertible permutation of these bits spreads the values evenly, and a permuted value is split
into a quotient (its first bits) and the full remainder, so nothing is lost and nothing collides. A
filter holds the remainders sorted by quotient, one bit for each quotient and each remainder, and a byte
for each count. Tasks count into filters, cut them into blocks of quotients, and the sorted blocks of all
tasks are merged block by block; reading a block back inverts the permutation.

A phrase of n words is only counted where both its parts of n - 1 words are frequent: a phrase is never
more frequent than its parts, so every frequent phrase is counted exactly. The frequent parts go to the
tasks as a bit table that errs on one side only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged

#: Longest phrase, in words.
WORDS = 4
#: Frequent words that one pass over the documents numbers; more words take more passes.
VOCABULARY = 4_000_000
#: n-grams that a task sorts at a time, and different ones that it holds before it hands its filter on.
CHUNK = 1 << 19
HELD = 1 << 20
#: Texts that a task turns into ids at a time.
ROWS = 1000
#: Words of the corpus for each block of quotients; a block is merged in one task.
BLOCK_WORDS = 1 << 20
#: Bits of the table of frequent parts: at least 2**20, at most 2**28 (32 MB).
PART_BITS = (20, 28)
#: Words that a task keeps numbers for.
CACHE = 100_000

_SEPARATE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
_ROUNDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
_CELL = 15  # bits of a cell of the table of parts, as a power of two

RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, a line feed word where a piece ends; empty words where blanks meet."""
    return text.translate(_SEPARATE).replace(b"\n", b" \n ").split(b" ")


# Permutation and filters

def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _round(x: np.ndarray, key: int, half: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & _mask(half)


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of the values of 2 * half bits, given and returned as two halves."""
    for key in _ROUNDS:
        high, low = low, high ^ _round(low, key, half)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of permute."""
    for key in reversed(_ROUNDS):
        high, low = low ^ _round(high, key, half), high
    return high, low


def tally(high: np.ndarray, low: np.ndarray, count: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, with the sum of their counts (1 each without counts)."""
    if half <= 32:
        key = high << np.uint64(half) | low
        if count is None:
            key, total = np.unique(key, return_counts=True)
            return key >> np.uint64(half), key & _mask(half), total.astype(np.int64)
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.ones(len(high), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(first)
    if count is None:
        total = np.diff(np.append(at, len(high)))
    else:
        total = np.add.reduceat(count[order], at) if len(at) else count
    return high[at], low[at], total.astype(np.int64)


def _bytes(values: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _values(raw: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = -(-bits // 8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack(high: np.ndarray, low: np.ndarray, count: np.ndarray, half: int, blocks: int, inner: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Filters (block, runs, remainders, counts, large counts) of sorted different permuted values.

    The first `blocks` bits of a value name its block, the next `inner` bits its quotient in the block. runs
    has a 0 for each quotient and a 1 for each of its remainders behind it. A count over 254 is 255 in
    counts and stands in full in large counts.
    """
    rest = half - blocks - inner
    quotient = (high >> np.uint64(rest)).astype(np.int64)
    block = quotient >> inner
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
        if a == b:
            continue
        runs = np.zeros((1 << inner) + b - a, np.uint8)
        runs[np.arange(b - a) + (quotient[a:b] & ((1 << inner) - 1)) + 1] = 1
        c = count[a:b]
        yield (
            int(block[a]), np.packbits(runs).tobytes(), _bytes(high[a:b] & _mask(rest), rest) + _bytes(low[a:b], half),
            np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype("<i8").tobytes())


def unpack(block: int, runs: bytes, remainders: bytes, counts: bytes, large: bytes, half: int, blocks: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pack was given, for one block."""
    rest = half - blocks - inner
    count = np.frombuffer(counts, np.uint8).astype(np.int64)
    n = len(count)
    count[count == 255] = np.frombuffer(large, "<i8")
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(runs, np.uint8)))
    quotient = (ones - np.arange(n) - 1).astype(np.uint64) | np.uint64(block << inner)
    width = n * -(-rest // 8)
    high = quotient << np.uint64(rest) | _values(remainders[:width], rest, n)
    return high, _values(remainders[width:], half, n), count


class Filter:
    """Counts of permuted values, sorted; what is new is sorted in chunks and merged."""

    def __init__(self, half: int):
        self.half, self.raw, self.n, self.parts = half, [], 0, []

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        self.raw.append((high, low))
        self.n += len(high)
        if self.n >= CHUNK:
            self._sort()

    def _sort(self) -> None:
        if self.n:
            self.parts.append(tally(*map(np.concatenate, zip(*self.raw, strict=True)), None, self.half))
        self.raw, self.n = [], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._sort()
        if len(self.parts) > 1:
            self.parts = [tally(*map(np.concatenate, zip(*self.parts, strict=True)), self.half)]
        return self.parts[0] if self.parts else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))

    def full(self) -> bool:
        return sum(len(p[0]) for p in self.parts) >= HELD and len(self.merged()[0]) >= HELD


# Words and their numbers

def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (binary), f over rows (lang, text as binary); counted in each task, then added."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                words.pop(b"", None)
                words.pop(b"\n", None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "f"])
            seen.clear()

        for b in (x.slice(at, ROWS) for x in batches for at in range(0, len(x), ROWS)):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(split_words(text))
            if sum(map(len, seen.values())) > CACHE * 3:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(count, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _key(lang: Column, word: Column) -> Column:
    """Hash of a word in its language; words hold no blank."""
    return F.xxhash64(F.concat(word, F.lit(b" "), lang.cast("binary")))


def numbered(words: DataFrame, least: int) -> DataFrame:
    """The words with f >= least and ids from 1 on without gaps, in buckets by hash."""
    frequent = words.where(F.col("f") >= least).withColumn("h", _key(F.col("lang"), F.col("word")))
    n = frequent.count()
    buckets = frequent.withColumn("bucket", F.pmod("h", F.lit(max(1, n // 10_000))))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for 10,000 words
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "lang", "word"))
    offsets = sizes.select(F.col("bucket").alias("at"), before.alias("before"))
    return buckets.join(offsets, F.col("bucket") == F.col("at")).select("lang", "word", "f", "h", (F.col("before") + place).alias("id"))


def encode(docs: DataFrame, vocabulary: DataFrame, size: int, clashes: set[int]) -> DataFrame:
    """Each text as word ids (column ids), 0 where a piece ends or a word has no id, at the end too.

    Tasks find ids by the hash of a word in sorted arrays of at most VOCABULARY words; a larger vocabulary
    takes more passes, each of which writes what is known so far. Hashes that two words of the corpus share
    are looked up by the words themselves.
    """
    passes = max(1, -(-size // VOCABULARY))
    rows = docs.select("lang", "text", F.lit(None).cast("array<int>").alias("ids"))
    odd = {h & (1 << 64) - 1 for h in clashes}
    for at in range(passes):
        some = vocabulary.where(F.pmod("id", F.lit(passes)) == at)
        known = some.select("h", F.col("id").cast("int")).toArrow().sort_by("h")
        by_word = {bytes(r["word"]) + b" " + r["lang"].encode(): r["id"] for r in some.where(F.col("h").isin(list(clashes))).collect()} if clashes else {}
        h = known["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        table = docs.sparkSession.sparkContext.broadcast((h[order], known["id"].to_numpy()[order].astype(np.int32), by_word))
        last = at == passes - 1

        def work(batches: Iterator[pa.RecordBatch], table=table, last=last) -> Iterator[pa.RecordBatch]:
            hashes, numbers, by_word = table.value
            caches: dict[str, dict[bytes, int]] = {}

            def look_up(words: list[bytes], end: bytes) -> Iterator[tuple[bytes, int]]:
                h = np.fromiter((xxhash.xxh64_intdigest(w + end, 42) for w in words), np.uint64, len(words))
                if not len(hashes):
                    return zip(words, [0] * len(words), strict=True)
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                ids = np.where(hashes[k] == h, numbers[k], 0).tolist()
                if odd:
                    ids = [by_word.get(w + end, 0) if x in odd else i for w, x, i in zip(words, h.tolist(), ids, strict=True)]
                return zip(words, ids, strict=True)

            for b in (x.slice(at, ROWS) for x in batches for at in range(0, len(x), ROWS)):
                out = []
                for lang, text, before in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("ids"), strict=True):
                    cache = caches.setdefault(lang, {b"": -1, b"\n": 0})
                    if sum(map(len, caches.values())) > CACHE:
                        caches = {lang: (cache := {b"": -1, b"\n": 0})}
                    words, end = split_words(text), b" " + lang.encode()
                    if new := list(set(words).difference(cache)):
                        cache.update(look_up(new, end))
                    ids = np.fromiter(map(cache.__getitem__, words), np.int32, len(words))
                    ids = np.append(ids[ids >= 0], np.int32(0))
                    if before.is_valid:
                        ids = np.maximum(ids, before.values.to_numpy())
                    if last:  # gaps of one are enough
                        ids = ids[(ids > 0) | np.append(True, ids[:-1] > 0)]
                    out.append(ids)
                arrays = pa.array(out, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([arrays], ["ids"]) if last else pa.RecordBatch.from_arrays([b.column("lang"), b.column("text"), arrays], ["lang", "text", "ids"])

        rows = staged(rows.mapInArrow(work, "ids array<int>" if last else "lang string, text binary, ids array<int>"), f"collocation-ids-{at}")
        table.unpersist()
    return rows


# Phrases

def _halves(ids: np.ndarray, starts: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams at starts, packed: the first words in the high half, the others in the low half."""
    w = [ids[starts + i].astype(np.uint64) for i in range(n)]
    if n == 2:
        return w[0], w[1]
    return w[0] << np.uint64(bits) | w[1], w[2] if n == 3 else w[2] << np.uint64(bits) | w[3]


def _slot(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Place of an n-gram in a table of 2**bits bits."""
    x = (high * np.uint64(_ROUNDS[0])) ^ (low + np.uint64(_ROUNDS[1])) * np.uint64(_ROUNDS[2])
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _half(n: int, bits: int) -> int:
    return bits if n == 2 else 2 * bits


def count_phrases(texts: DataFrame, n: int, bits: int, least: int, blocks: int, parts: np.ndarray | None) -> DataFrame:
    """w (array of n ids) and f of the phrases of n words with f >= least.

    texts has ids. blocks is the number of bits that name a block. parts is the table of frequent parts of
    n - 1 words as bytes; without it all parts count as frequent.
    """
    half = _half(n, bits)
    blocks = min(blocks, half)
    inner = min(12, half - blocks)
    table = texts.sparkSession.sparkContext.broadcast(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, parts = Filter(half), table.value

        def rows() -> Iterator[pa.RecordBatch]:
            packed = list(pack(*found.merged(), half, blocks, inner))
            for at in range(0, len(packed), 256):
                cols = list(zip(*packed[at:at + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["block", "runs", "rest", "counts", "large"])

        for b in batches:
            ids = b.column("ids").flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), CHUNK):
                piece = ids[at:at + CHUNK + n - 1]
                ok = np.ones(max(0, len(piece) - n + 1), bool)
                for i in range(n):
                    ok &= piece[i:len(ok) + i] > 0
                starts = np.flatnonzero(ok)
                if parts is not None and len(starts):
                    size = parts.size.bit_length() + 2
                    for shift in (0, 1):
                        slot = _slot(*_halves(piece, starts + shift, n - 1, bits), size)
                        starts = starts[parts[slot >> 3] >> (slot & 7) & 1 > 0]
                if len(starts):
                    found.add(*permute(*_halves(piece, starts, n, bits), half))
                if found.full():
                    yield from rows()
                    found = Filter(half)
        yield from rows()

    def merge(rows: pa.Table) -> pa.Table:
        cols = [rows[c].to_pylist() for c in ("block", "runs", "rest", "counts", "large")]
        filters = [unpack(*r, half, blocks, inner) for r in zip(*cols, strict=True)]
        high, low, total = tally(*map(np.concatenate, zip(*filters, strict=True)), half)
        often = total >= least
        high, low = restore(high[often], low[often], half)
        mask, by = _mask(bits), np.uint64(bits)
        words = [high, low] if n == 2 else [high >> by, high & mask, *([low] if n == 3 else [low >> by, low & mask])]
        values = np.stack(words, 1).astype(np.int32).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n, dtype=np.int32)), pa.array(values))
        return pa.table({"w": lists, "f": pa.array(total[often], pa.int64())})

    filters = texts.mapInArrow(count, "block long, runs binary, rest binary, counts binary, large binary")
    return filters.groupBy("block").applyInArrow(merge, "w array<int>, f long")


def part_table(phrases: DataFrame, n: int, bits: int) -> np.ndarray:
    """The bit table of the phrases of n words, as bytes; cells are filled by tasks, the driver joins them."""
    size = min(PART_BITS[1], max(PART_BITS[0], (phrases.count() * 16).bit_length()))
    slots = "slot long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            starts = np.arange(len(w)) * n
            yield pa.RecordBatch.from_arrays([pa.array(_slot(*_halves(w.reshape(-1), starts, n, bits), size))], ["slot"])

    def fill(rows: pa.Table) -> pa.Table:
        slot = rows["slot"].to_numpy()
        cell = np.zeros(1 << _CELL, bool)
        cell[slot & ((1 << _CELL) - 1)] = True
        return pa.table({"cell": pa.array([int(slot[0]) >> _CELL], pa.int64()), "bits": pa.array([np.packbits(cell, bitorder="little").tobytes()], pa.binary())})

    found = phrases.select("w").mapInArrow(place, slots).distinct().groupBy((F.col("slot") / F.lit(1 << _CELL)).cast("long").alias("at")).applyInArrow(lambda t: fill(t), "cell long, bits binary")
    out = np.zeros(1 << size - 3, np.uint8)
    for r in found.collect():  # at most 2**13 cells of 4 KB
        out[r["cell"] << _CELL - 3:(r["cell"] + 1) << _CELL - 3] = np.frombuffer(r["bits"], np.uint8)
    return out


def score_phrases(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """w, a, l, r, score of each phrase by its lowest-scoring cut, equal scores by the first cut.

    counts has w and f of words and phrases alike; both parts of a phrase are as frequent as it at least.
    """
    size = F.size("w")
    cuts = phrases.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("tail"))
    left, right = counts.select(F.col("w").alias("head"), F.col("f").alias("l")), counts.select(F.col("w").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(left, "head").join(right, "tail").withColumn(
        "score", F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + r)"))  # exact beyond 64 bits
    return scored.groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("w", "a", "x.l", "x.r", "x.score")


def not_inside(phrases: DataFrame, share: int) -> DataFrame:
    """w of the phrases that no longer phrase holds share hundredths or more of."""
    size = F.size("w")
    longer = phrases.where(size > 2)
    lengths = F.explode(F.sequence(F.lit(2), size - 1)).alias("n")
    inner = longer.select("w", "f", lengths).select("f", "n", "w", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("i"))
    most = inner.select(F.slice("w", F.col("i"), F.col("n")).alias("w"), "f").groupBy("w").agg(F.max("f").alias("most"))
    return phrases.join(most, "w", "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * share)).select("w")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null lang is `und`. Repeated rows count each. No phrase, no row. Columns other
    than text and lang are not looked at. Texts of any length are counted whole, piece by piece.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")))
    words = staged(word_counts(texts), "collocation-words")
    per_lang = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    vocabulary = staged(numbered(words, least), "collocation-vocabulary")
    size = vocabulary.count()
    if not size:
        return spark.createDataFrame([], RESULT)
    # Two words with one hash are expected once in 2**64 pairs; the few there are go by their bytes.
    hashes = words.groupBy(_key(F.col("lang"), F.col("word")).alias("h")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ids = encode(texts, vocabulary, size, {r["h"] for r in hashes.collect()})
    bits, blocks = size.bit_length(), max(5, (total // BLOCK_WORDS).bit_length())
    tables, parts = [], None
    for n in range(2, WORDS + 1):
        tables.append(staged(count_phrases(ids, n, bits, least, blocks, parts), f"collocation-{n}"))
        if n < WORDS:
            parts = part_table(tables[-1], n, bits)
    phrases = tables[0].union(tables[1]).union(tables[2])
    counts = phrases.union(vocabulary.select(F.array(F.col("id").cast("int")).alias("w"), "f"))
    scored = staged(score_phrases(phrases, counts).join(not_inside(phrases, share), "w", "left_semi"), "collocation-scores")
    names = vocabulary.select(F.col("id").cast("int").alias("id"), "lang", F.col("word").cast("string").alias("word"))
    spelled = (
        scored.select("w", F.posexplode("w").alias("i", "id")).join(names, "id").groupBy("w")
        .agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.join(spelled, "w").withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
