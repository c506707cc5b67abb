"""Collocations, the hash ring and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from consigna.llm import collocations, importance, ring
from consigna.llm.common import ship, table

sys.path.insert(0, str(Path(__file__).parent))
FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Collocations

def plain_collocations(rows, least=30, top=2000, share=80):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        n = sum(v for w, v in c.items() if len(w) == 1)
        cand = {w: v for w, v in c.items() if len(w) > 1 and v >= least}
        inside = defaultdict(int)
        for w, v in cand.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inside[w[i:i + k]] = max(inside[w[i:i + k]], v)
        best = []
        for w, a in cand.items():
            if 100 * inside[w] >= share * a:
                continue
            s, k = min((2000000 * a // (c[w[:k]] + c[w[k:]]), k) for k in range(1, len(w)))
            best.append((-s, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top])}
    return out


def collocated(spark, rows, **how):
    ship(spark)
    df = spark.createDataFrame([(lang, text, "x") for lang, text in rows], "lang string, text string, w string")
    return {tuple(r) for r in collocations.collocations(df, **how).collect()}


def phrases(rnd, n):
    words = ["a", "B", "cc", "dé", "É", "x y", "\x01", "new", "york", "city", "the", "of"]
    return "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " ; "]) + rnd.choice(["", "New York city "]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["en", "en", "fr", "und", None, ""]), phrases(rnd, rnd.randrange(60))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("fr", " \t .,"), ("en", phrases(rnd, 3000)), *[("de", "one two three four five six")] * 40]
    want = plain_collocations(rows, 5, 50)
    assert want and collocated(spark, rows, least=5, top=50) == want
    if seed == 2:  # words in several passes, small steps, filters that are handed on early
        for name, value in (("VOCABULARY", 3), ("CHUNK", 64), ("HELD", 16), ("BLOCK_WORDS", 32), ("CACHE", 4), ("PART_BITS", (5, 5))):
            monkeypatch.setattr(collocations, name, value) if name != "PART_BITS" else None
        assert collocated(spark, rows, least=5, top=50) == want


def test_collocations_of_nothing(spark):
    assert collocated(spark, []) == set()
    assert collocated(spark, [("en", None), (None, "a b c"), ("en", "a b. a b")]) == set()
    once = "left over\tright " * 30
    assert collocated(spark, [("en", once)]) == plain_collocations([("en", once)])


def test_collocations_with_clashing_hashes(spark, monkeypatch):
    """All words share a hash with others: ids then go by the words themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(collocations, "_key", lambda lang, word: F.pmod(F.xxhash64(F.concat(word, F.lit(b" "), lang.cast("binary"))), F.lit(3)))
    real = xxhash.xxh64_intdigest

    class Few:
        @staticmethod
        def xxh64_intdigest(x, seed):
            h = real(x, seed)
            return (h - (1 << 64) if h >> 63 else h) % 3

    rows = [("en", "alpha beta gamma " * 20), ("fr", "alpha beta . beta gamma " * 20)]
    words = spark.createDataFrame(rows, "lang string, text string").select("lang", F.col("text").cast("binary").alias("text"))
    counts = collocations.word_counts(words)
    vocabulary = collocations.numbered(counts, 5)
    assert sorted(r.id for r in vocabulary.collect()) == list(range(1, 7))
    clashes = {r.h for r in counts.groupBy(collocations._key(F.col("lang"), F.col("word")).alias("h")).count().where("count > 1").collect()}
    assert clashes


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 64), st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1, max_size=50), st.integers(0, 6))
def test_filters_lose_nothing(half, pairs, blocks):
    mask = (1 << half) - 1
    high, low = (np.array([p[i] & mask for p in pairs], np.uint64) for i in (0, 1))
    a, b = collocations.permute(high, low, half)
    assert int(a.max()) <= mask and int(b.max()) <= mask
    back = collocations.restore(a, b, half)
    assert (back[0] == high).all() and (back[1] == low).all()
    want = Counter((int(x) & mask, int(y) & mask) for x, y in pairs)
    assert len({(int(x), int(y)) for x, y in zip(a, b)}) == len(want)
    blocks = min(blocks, half)
    inner = min(3, half - blocks)
    counts = np.array([300 if i % 2 else 1 for i in range(len(a))], np.int64)
    one, two = collocations.tally(a, b, None, half), collocations.tally(a, b, counts, half)
    merged = []
    for rows in (collocations.pack(*one, half, blocks, inner), collocations.pack(*two, half, blocks, inner)):
        merged += [collocations.unpack(*r, half, blocks, inner) for r in rows]
    x, y, n = collocations.tally(*map(np.concatenate, zip(*merged)), half)
    x, y = collocations.restore(x, y, half)
    extra = Counter()
    for (p, q), c in zip(pairs, counts.tolist()):
        extra[(p & mask, q & mask)] += c + 1
    assert {(int(p), int(q)): int(c) for p, q, c in zip(x, y, n)} == dict(extra)


# Ring

def plain_ring(rows, shards, capacity, key, draw, large):
    """Documents turn by turn: {row number: shard}."""
    walks = ring.ring(shards)
    places = [p for p, _ in walks]
    out, loads = {}, [0] * shards
    import bisect

    left = {i: walks[bisect.bisect_left(places, key[r[0]]) % len(places)][1] for i, r in enumerate(rows)}
    while left:
        full = [n >= capacity for n in loads]
        at = defaultdict(list)
        for i, walk in left.items():
            at[next(s for s in walk if not full[s])].append(i)
        for s, own in at.items():
            own.sort(key=lambda i: (0, -rows[i][1], draw[rows[i][0]][1]) if rows[i][1] >= large else (1, 0, draw[rows[i][0]]))
            for i in own:
                if loads[s] < capacity:
                    loads[s] += rows[i][1]
                    out[i] = s
                    del left[i]
    return out, loads


def sharded(spark, rows, **how):
    ship(spark)
    return ring.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string, uid int"), **how)


def test_ring(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(i, "é" * int(rnd.paretovariate(0.9) * 5 % 4000) if i % 50 else None, "s", i) for i in range(1500)]
    got = {r.doc_id: r for r in sharded(spark, rows, bucket_rows=1).collect()}
    assert len(got) == len(rows)
    sizes = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    for i, t, *_ in rows:
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (sizes[i], zlib.crc32((t or "").encode()), "bytes", None)
    hashes = {r.id: r for r in spark.range(1500).select("id", F.shiftrightunsigned(F.xxhash64("id", F.lit("ring")), 2).alias("k"), F.xxhash64("id", F.lit("order")).alias("d")).collect()}
    capacity = -(-sum(sizes.values()) // 16)
    buckets = (1500 // 16 + 1) * 4
    order = {i: (h.d % buckets, h.d) for i, h in hashes.items()}
    want, loads = plain_ring([(i, sizes[i]) for i in range(1500)], 16, capacity, {i: h.k for i, h in hashes.items()}, order, capacity * ring.LARGE)
    assert {i: r.shard for i, r in got.items()} == want
    assert max(loads) < capacity + max(capacity * ring.LARGE, max(sizes.values())) and sum(loads) == sum(sizes.values())
    slots = defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    assert sum(r.home != r.shard for r in got.values()) < 0.5 * len(rows)
    again = {r.doc_id: r.shard for r in sharded(spark, rows[::-1], bucket_rows=1).collect()}
    assert again == want


def test_ring_balances_and_moves_little(spark):
    rows = [(i, "x" * (20 + i % 90), None, 0) for i in range(8000)]
    before, after = ({r.doc_id: r.shard for r in sharded(spark, rows, shards=n).collect()} for n in (16, 17))
    loads = Counter()
    for i, t, *_ in rows:
        loads[before[i]] += len(t) + 1
    assert max(loads.values()) < 1.03 * min(loads.values())
    moved = sum(before[i] != after[i] for i in before)
    assert moved < 0.35 * len(rows)  # a new numbering would move 16 of 17


def test_ring_edges(spark):
    assert sharded(spark, []).count() == 0
    rows = [(None, None, None, None), (None, "a", None, None), (7, "same", "x", 1), (7, "same", "x", 1), (7, "same", "x", 1), (8, "y" * 500_000, None, 2)]
    got = sharded(spark, rows, shards=2).collect()
    assert len(got) == 6 and {r.shard for r in got} <= {0, 1}
    for s in (0, 1):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_walks_meet_every_shard():
    for n in (1, 2, 16):
        walks = ring.ring(n, 8)
        assert len(walks) == 8 * n and all(sorted(w) == list(range(n)) for _, w in walks)


def test_ring_is_native(spark):
    plan = sharded(spark, [(1, "a", None, 1)])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, share=5):
    own = {i: plain_features(t) for i, t in docs}
    s, t = Counter(b for _, f in own.values() for b in f), Counter(b for x in target for b in plain_features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in s}
    out = {}
    for i, (_, f) in own.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    long = sorted((-out[i][3], i) for i, (n, _) in own.items() if n >= 20)
    for rank, (_, i) in enumerate(long[:share * len(long) // 100]):
        out[i][4] = rank + 1
    return {tuple(r) for r in out.values()}


@pytest.mark.parametrize("batch", [importance.BATCH, 300])
def test_importance(spark, batch, monkeypatch):
    monkeypatch.setattr(importance, "BATCH", batch)
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    docs += [(-1, None), (-2, ""), (-3, "Ünïcode É " * 40 + "x" * 400), (-4, "A1 b2-c3.d4 " * 9), (-5, "word " * 19), (-6, "word " * 20), (-7, "word " * 20)]
    target = [r.text for r in table(spark, FOLDER, "benchmark").collect()] + [None]
    ship(spark)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for ranges in (100_000, 20):
        got = {tuple(r) for r in importance.resample(df, bench, share=30, rows_per_range=ranges).collect()}
        assert got == plain_resample(docs, target, 30)
    if batch == importance.BATCH:
        assert importance.resample(df.limit(0), bench).count() == 0
        odd = importance.resample(spark.createDataFrame([(None, "a b " * 20), (3, "c"), (3, "c")], "doc_id long, text string"), bench.limit(0)).collect()
        assert sorted((r.doc_id or 0, r.n_features) for r in odd) == [(0, 117), (3, 1), (3, 1)]


def test_parts_of_a_long_text(monkeypatch):
    """A text cut into batches has the features of the whole, those over a border too."""
    monkeypatch.setattr(importance, "BATCH", 50)
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("abé9", k=rnd.randrange(1, 30))) for _ in range(200))
    found = Counter()
    words = 0
    for _, begun, _, bucket, times in importance.features([None, text.encode()]):
        words += begun[1]
        for b, n in zip(bucket[times > 0], times[times > 0]):
            found[int(b)] += int(n)
    assert words == 200 and found == Counter(plain_features(text)[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=100), min_size=1, max_size=30))
def test_hashes_and_table(parts):
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(size) - size
    lanes = importance._lanes(data)
    assert importance.xxhash64(lanes, start, size, 7).tolist() == [xxhash.xxh64_intdigest(p, 7) for p in parts]
    assert importance.crc32(data, start, size).tolist() == [zlib.crc32(p) for p in parts]
    owner, slot = importance.intern(lanes, start, size)
    assert len(set(slot.tolist())) == len(set(parts))
    for i, p in enumerate(parts):
        assert parts[owner[slot[i]]] == p


def test_equal_hashes_are_told_apart(monkeypatch):
    """Bytes decide: with one hash for all, the table still parts what differs."""
    monkeypatch.setattr(importance, "xxhash64", lambda lanes, start, size: np.zeros(len(start), np.uint64))
    parts = [b"one", b"two", b"one", b"three", b"onf", b"two"]
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    owner, slot = importance.intern(importance._lanes(data), np.cumsum(size) - size, size)
    assert slot[0] == slot[2] and slot[1] == slot[5] and len(set(slot.tolist())) == 4
