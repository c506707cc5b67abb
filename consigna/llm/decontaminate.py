"""Benchmark decontamination by the q-gram lemma.

A text region within k edits of a pattern of n characters shares at least n - q + 1 - k q of its q-grams
with it, all on diagonals at most k apart; of its floor(n / q) disjoint pieces all but k stand there
unchanged. So: look up the pieces, take the diagonal bands with enough of them, count shared q-grams in
these overlapping bands, and verify the bands that reach the bound by aligning pattern and region.

Texts are compared in a normal form: lower case, every run of other characters than letters and digits
one space. Patterns are windows of the benchmark items, half overlapping, so a part of an item counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consigna.llm.common import spread

LEAKS = "array<struct<item_id:long,start:int,end:int>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
BITS = 20
PAIR_BITS = 24
#: Least number of diagonals from one band to the next.
STEP = 16
#: Rows that one step of the search holds at a time.
ROWS = 1_000_000
#: Characters in normal form that an item must have to be evidence.
LEAST = 20
#: Characters that are normalised and hashed together; longer texts make a chunk of their own.
CHUNK = 2**20

_FORM: list[np.ndarray] = []


def _form() -> np.ndarray:
    """Normal form of each character of the basic plane; 0 stays 0 and parts texts."""
    if not _FORM:
        table = np.full(65536, 32, np.uint32)
        for c in range(1, 65536):
            if 0xD800 <= c < 0xE000:
                continue
            low = chr(c).lower()
            if low[0].isalnum():
                table[c] = ord(low[0])
        table[0] = 0
        _FORM.append(table)
    return _FORM[0]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the normal form and the place of each in text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    form = np.where(c < 65536, _form()[np.minimum(c, 65535)], c)
    blank = form == 32
    keep = np.ones(len(form), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(keep)
    return form[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place; hashes of halves are joined, so few passes are needed."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    out, width, done = None, 1, 0
    power = codes.astype(np.uint64) * mix
    while True:
        if q & width:
            n = len(codes) - q + 1
            part = power[done:done + n]
            out = part.copy() if out is None else out * np.uint64(0xD1342543DE82EF95) + part
            done += width
        width *= 2
        if width > q:
            break
        half = width // 2
        power = power[:-half] * np.uint64(0xA0761D6478BD642F) + power[half:]
        power ^= power >> np.uint64(29)
    return (out ^ (out >> np.uint64(32))) * mix


@dataclass
class Patterns:
    """The windows of some benchmark items and an index of their q-grams."""

    q: int
    codes: list[np.ndarray]
    items: np.ndarray
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    seed_first: np.ndarray
    seed_pattern: np.ndarray
    seed_place: np.ndarray
    needs: np.ndarray
    pairs: np.ndarray
    pair_place: np.ndarray
    repeats: np.ndarray
    starts: np.ndarray
    pair_bits: np.ndarray | None = None  # made where it is used
    first_bits: np.ndarray | None = None  # made where it is used

    def has_first(self, first: np.ndarray) -> np.ndarray:
        """Whether a hash has these first bits; one small table tells it for most grams."""
        if self.first_bits is None:
            self.first_bits = self.starts[:-1] < self.starts[1:]
        return self.first_bits[first]

    def has_pair(self, pair: np.ndarray) -> np.ndarray:
        """Whether each pair may be in pairs; a wrong yes is rare."""
        if self.pair_bits is None:
            self.pair_bits = np.zeros(1 << PAIR_BITS, bool)
            self.pair_bits[_spread(self.pairs)] = True
        return self.pair_bits[_spread(pair)]


def _spread(pair: np.ndarray) -> np.ndarray:
    return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def windows(codes: np.ndarray, size: int) -> list[np.ndarray]:
    if len(codes) <= size:
        return [codes]
    starts = [*range(0, len(codes) - size, size // 2), len(codes) - size]
    return [codes[s:s + size] for s in dict.fromkeys(starts)]


def patterns(items: list[tuple[int, str]], q: int, size: int, rate: float) -> Patterns:
    """Windows with their edit budgets; a budget is cut until the lemma asks for a shared q-gram.

    Items with less than 2 q or LEAST characters in normal form have no pattern.
    """
    codes, ids, seen = [], [], set()
    for item, text in items:
        form = normal((text or "").replace("\0", " ").strip())[0]
        for w in windows(form, size):
            if len(w) >= max(2 * q, LEAST) and (item, w.tobytes()) not in seen:
                seen.add((item, w.tobytes()))
                codes.append(w)
                ids.append(item)
    sizes = np.array([len(c) for c in codes], np.int64)
    budgets = np.minimum((sizes * rate).astype(np.int64), (sizes - q) // q) if len(codes) else sizes
    per = [grams(c, q) for c in codes]
    every = np.concatenate(per) if per else np.empty(0, np.uint64)
    pattern = np.repeat(np.arange(len(codes)), [len(p) for p in per])
    place = np.concatenate([np.arange(len(p)) for p in per]) if per else np.empty(0, np.int64)
    hashes, gram = np.unique(every, return_inverse=True)
    starts = np.searchsorted(hashes >> np.uint64(64 - BITS), np.arange((1 << BITS) + 1, dtype=np.uint64)).astype(np.int32)
    # Postings of the disjoint pieces alone, gram by gram.
    piece = place % q == 0
    order = np.flatnonzero(piece)[np.argsort(gram[piece], kind="stable")]
    seed_first = np.searchsorted(gram[order], np.arange(len(hashes) + 1))
    # Each pattern's grams; the place of one that it has several times is -1.
    pairs, one, times = np.unique(pattern * len(hashes) + gram, return_index=True, return_counts=True)
    repeats = np.maximum(sizes - q + 1, 0) - np.bincount(pattern[one], minlength=len(codes))  # places beyond the first of their gram
    return Patterns(q, codes, np.array(ids, np.int64), sizes, budgets, sizes - q + 1 - budgets * q, hashes, seed_first, pattern[order],
                    place[order], sizes // q - budgets, pairs, np.where(times == 1, place[one], -1), repeats, starts)


def _aligned(p: Patterns, codes: np.ndarray, pattern: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each pattern and a text stretch inside its band of diagonals, and its end.

    Row by row over the pattern, all candidates of one pattern length at once. The region may start on
    any diagonal of the band.
    """
    best, end = np.full(len(pattern), 1 << 30), np.zeros(len(pattern), np.int64)
    for size in np.unique(p.sizes[pattern]):
        pick = np.flatnonzero(p.sizes[pattern] == size)
        for part in np.array_split(pick, max(1, len(pick) // 4096 + 1)):
            if not len(part):
                continue
            want = np.stack([p.codes[i] for i in pattern[part]])
            d = np.arange(width)
            cost = np.zeros((len(part), width), np.int32)
            for i in range(size):
                at = low[part][:, None] + i + d
                inside = (at >= 0) & (at < len(codes))
                same = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], 0) == want[:, i:i + 1]
                now = cost + ~same
                now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(now - d, axis=1) + d
            best[part] = cost.min(axis=1)
            end[part] = low[part] + size + cost.argmin(axis=1)
    return best, end


def _expand(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the postings of grams `at`, and for each slot which of them it belongs to."""
    many = first[at + 1] - first[at]
    ends = np.cumsum(many)
    return np.repeat(first[at] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0), np.repeat(np.arange(len(at)), many)


def _slices(p: Patterns, hits: np.ndarray, at: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """Runs of hits with at most ROWS seed postings, each with the hits within reach behind it.

    A run is at least one hit long; what lies within reach of it has few postings, as a gram has one for
    each pattern of a block at most.
    """
    total = np.concatenate([[0], np.cumsum(p.seed_first[at + 1] - p.seed_first[at])])
    start = 0
    while start < len(hits):
        end = max(start + 1, int(np.searchsorted(total, total[start] + ROWS, "right")) - 1)
        yield start, int(np.searchsorted(hits, hits[end - 1] + reach, "right"))
        start = end


def _candidates(p: Patterns, hits: np.ndarray, at: np.ndarray, step: int, overlap: int, shift: int) -> np.ndarray:
    """Bands (pattern and band in one number) in which enough of a pattern's pieces occur unchanged.

    k edits leave all but k of the disjoint pieces unchanged, on diagonals at most k apart.
    """
    bands = int((hits[-1] + shift) // step) + 1 if len(hits) else 1
    found = [np.empty(0, np.int64)]
    reach = int((p.sizes + p.budgets).max())
    for a, b in _slices(p, hits, at, reach):
        slot, of = _expand(p.seed_first, at[a:b])
        pattern = p.seed_pattern[slot]
        diagonal = hits[a:b][of] - p.seed_place[slot] + shift
        band = diagonal // step
        back = (diagonal - band * step < overlap) & (band > 0)
        key = pattern * bands + band
        key, count = np.unique(np.concatenate([key, key[back] - 1]), return_counts=True)
        found.append(key[count >= p.needs[key // bands]])
    every = np.unique(np.concatenate(found))
    return np.stack([every // bands, every % bands])


def _dense(p: Patterns, gram: np.ndarray, pattern: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Which bands share as many q-grams with their pattern as the lemma asks for.

    gram is the number of the gram at each place of the text, -1 where no pattern has it. A gram counts
    where it stands on a diagonal of the band; one that its pattern has several times counts on any. Places
    of the text are counted, and grams of the pattern that stand at one place or more.
    """
    out = np.zeros(len(pattern), bool)
    reach = int(p.sizes.max()) - p.q + width
    edge = int(p.sizes.max()) + width + reach
    padded = np.full(len(gram) + 2 * edge, -1, np.int32)
    padded[edge:edge + len(gram)] = gram
    first, stretches = low + edge, np.lib.stride_tricks.sliding_window_view(padded, reach)
    for part in np.array_split(np.arange(len(pattern)), max(1, -(-len(pattern) * reach // ROWS))):
        if not len(part):
            continue
        g = stretches[first[part]]
        cell = np.flatnonzero(g >= 0)
        row = cell // reach
        col = cell - row * reach
        want = pattern[part][row] * len(p.hashes) + g.reshape(-1)[cell]
        maybe = p.has_pair(want)
        row, col, want = row[maybe], col[maybe], want[maybe]
        k = np.searchsorted(p.pairs, want)
        k[k == len(p.pairs)] = 0
        place = p.pair_place[k]
        off = col - place
        ok = (p.pairs[k] == want) & ((place < 0) | ((off >= 0) & (off < width)))
        row, k = row[ok], k[ok]
        # Few bands have the places, and only theirs are told apart by their grams.
        enough = np.bincount(row, minlength=len(part)) >= p.bounds[pattern[part]]
        row, k = row[enough[row]], k[enough[row]]
        alike = np.bincount(np.unique(row * len(p.pairs) + k) // len(p.pairs), minlength=len(part))
        out[part] = enough & (alike + p.repeats[pattern[part]] >= p.bounds[pattern[part]])
    return out


def regions(p: Patterns, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(pattern, start, end) of the regions of codes within a pattern's edit budget."""
    if not len(p.codes):
        return []
    h = grams(codes, p.q)
    # Hashes with the same first bits stand together; a gram looks at those with its own.
    first = (h >> np.uint64(64 - BITS)).astype(np.int32)
    left = np.flatnonzero(p.has_first(first))
    at, end, mine = p.starts[first[left]], p.starts[first[left] + 1], h[left]
    gram = np.full(len(h), -1, np.int32)
    while len(left):
        same = p.hashes[at] == mine
        gram[left[same]] = at[same]
        go = ~same & (at + 1 < end)
        left, at, end, mine = left[go], at[go] + 1, end[go], mine[go]
    hits = np.flatnonzero(gram >= 0)
    at = gram[hits]
    seed = p.seed_first[at + 1] > p.seed_first[at]
    hits, at = hits[seed], at[seed]
    if not len(hits):
        return []
    # Bands of step + overlap diagonals; the overlap is the largest budget, so some band holds all of a region.
    overlap = int(p.budgets.max())
    step = max(STEP, overlap)
    shift = int(p.sizes.max())
    pattern, band = _candidates(p, hits, at, step, overlap, shift)
    low = band * step - shift
    good = _dense(p, gram, pattern, low, step + overlap)
    pattern, low = pattern[good], low[good] - overlap
    width = step + 3 * overlap + 1
    if not len(pattern):
        return []
    edits, end = _aligned(p, codes, pattern, low, width)
    fits = edits <= p.budgets[pattern]
    return list(zip(pattern[fits].tolist(), (end - p.sizes[pattern])[fits].tolist(), end[fits].tolist(), strict=True))


def leaks(p: Patterns, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(item, start, end) in code points for each text; touching regions of an item are one."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chunk: list[int] = []
    length = 0

    def settle() -> None:
        joined = "\0".join(texts[i].replace("\0", " ") for i in chunk)
        codes, at = normal(joined)
        starts = np.cumsum([0, *[len(texts[i]) + 1 for i in chunk]])
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for pattern, s, e in regions(p, codes):
            s, e = max(s, 0), min(e, len(codes))
            doc = int(np.searchsorted(starts, at[(s + e) // 2], "right")) - 1
            a, b = max(int(at[s] - starts[doc]), 0), min(int(at[e - 1] - starts[doc]) + 1, len(texts[chunk[doc]]))
            found.setdefault((chunk[doc], int(p.items[pattern])), []).append((a, b))
        for (i, item), spans in sorted(found.items()):
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out[i] += [(item, a, b) for a, b in merged]

    for i, t in enumerate(texts):
        if t:
            chunk.append(i)
            length += len(t) + 1
        if length >= CHUNK:
            settle()
            chunk, length = [], 0
    if chunk:
        settle()
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 6, size: int = 50, rate: float = 1 / 8, block_chars: int = 1_000_000) -> DataFrame:
    """All columns of docs in __row, with __leaks: the regions that hold a passage of the benchmark.

    size and rate: a passage is a window of that many characters of an item (a shorter item as a whole)
    with at most that share of edits; windows start every size // 2, so any excerpt of 75 characters
    (about 13 words) holds a whole one. Null and empty texts, null items and items under LEAST
    characters leak nothing. Repeated items are reported each. Documents are not shuffled. The benchmark
    is a stated query set: blocks of about block_chars characters go over all documents one after the
    other, so what a task holds is bounded however large it is.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(whole, F.col("text").cast("string").alias("__text"), F.array().cast(LEAKS).alias("__leaks"))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    schema = f"__row {rows.schema['__row'].dataType.simpleString()}, __text string, __leaks {LEAKS}"
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(patterns([(r["item_id"], r["text"]) for r in some], q, size, rate))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                before = b.column("__leaks").to_pylist()
                now = leaks(index.value, [t or "" for t in b.column("__text").to_pylist()])
                both = [x + [dict(zip(("item_id", "start", "end"), y, strict=True)) for y in z] for x, z in zip(before, now, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("__text"), pa.array(both, _LEAKS)], ["__row", "__text", "__leaks"])

        rows = rows.mapInArrow(scan, schema)
    return rows.select("__row", F.array_sort("__leaks").alias("__leaks"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without a leak, with all their columns."""
    return find_leaks(docs, benchmark, **how).where(F.size("__leaks") == 0).select("__row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, contaminated, item_ids, spans (item:start:end)."""
    found = find_leaks(spread(docs.select("doc_id", "text")), benchmark, **how)
    spans = F.transform("__leaks", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        F.col("__row.doc_id").alias("doc_id"), (F.size("__leaks") > 0).alias("contaminated"),
        F.array_distinct(F.col("__leaks.item_id")).alias("item_ids"), F.array_join(spans, ",").alias("spans"))
