"""Personal data: base patterns, and terms that give protected entities away.

Every value that a base pattern finds is a protected entity. A term in a document with an entity reveals
it as far as knowing the term tells that the entity is there: pointwise mutual information, from counts
over the whole corpus, against the entity's own information content. A term reaching the disclosure
threshold is replaced by something more general in each document with the entity, or removed.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.llm.common import lower_ascii, spread, staged, words

#: Fixed kinds, in the order in which they are listed.
KINDS = ["email", "ip", "card", "phone"]
TERM = len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-")
_DIGIT = re.compile(r"[0-9]")
# After a run of digits ends, no other start inside the run can match, so starts are runs' first digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

PLACE = "array<struct<kind:int,start:int,end:int>>"
TERMS = "array<struct<term:string,start:int,end:int>>"
#: Least hashes of a text's word triples, by as many orders; near copies have most of them in common.
SKETCH = 8
_ORDERS = np.array([0x9E3779B97F4A7C15 * k + 0xD1342543DE82EF95 & (1 << 64) - 1 | 1 for k in range(SKETCH)], np.uint64)


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from the @ signs outwards, so long runs of letters are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, in code points."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(not p[:-3].strip("0") and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _value(kind: int, found: str) -> str:
    return found.translate(_LOWER) if kind < 2 else re.sub(r"[^0-9]", "", found)


def sketch(text: str) -> list[int]:
    w = [m[0].translate(_LOWER) for m in _WORD.finditer(text)]
    h = np.array([_hash(*w[i:i + 3]) for i in range(max(1, len(w) - 2))], np.int64).view(np.uint64)
    return [int((h * m).min().view(np.int64)) for m in _ORDERS]


def terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words of text that are no part of a span."""
    taken = sorted((s, e) for _, s, e in spans)
    lows = [s for s, _ in taken]
    highs: list[int] = []
    for _, e in taken:
        highs.append(max(e, highs[-1]) if highs else e)
    out = []
    for m in _WORD.finditer(text):
        term = m[0].strip(string.punctuation)
        if not term:
            continue
        a = m.start() + len(m[0]) - len(m[0].lstrip(string.punctuation))
        b = a + len(term)
        k = bisect.bisect_left(lows, b) - 1
        if k >= 0 and highs[k] > a:  # part of a base span itself
            continue
        out.append((term.translate(_LOWER), a, b))
    return out


def find(docs: DataFrame) -> DataFrame:
    """All columns of docs in __row, with __spans (base), __entities, __words (terms and places) and __sketch of column text.

    A null text counts as empty: no spans. Texts without an entity have no words here. Linear in the text.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(whole, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    spans_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    words_type = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, entities, places, sketches = [], [], [], []
            for t in b.column("__text").to_pylist():
                found = base_spans(t)
                spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in found])
                entities.append(sorted({_hash(k, _value(k, t[s:e])) for k, s, e in found}))
                places.append([dict(zip(("term", "start", "end"), x, strict=True)) for x in terms(t, found)] if found else [])
                sketches.append(sketch(t) if found else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("__row"), pa.array(spans, spans_type), pa.array(entities, longs), pa.array(places, words_type), pa.array(sketches, longs)],
                ["__row", "__spans", "__entities", "__words", "__sketch"])

    return rows.mapInArrow(scan, f"__row {rows.schema['__row'].dataType.simpleString()}, __spans {PLACE}, __entities array<long>, __words {TERMS}, __sketch array<long>")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """term, n_term: documents with the term, over all documents; counted before the shuffle."""
    marks = F.lit(string.punctuation)
    terms = F.array_distinct(F.transform(words(lower_ascii(F.col("text").cast("string"))), lambda w: F.btrim(w, marks)))
    return docs.select(F.explode(terms).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def several_texts(rows: DataFrame, keys: list[str], contexts: int) -> DataFrame:
    """keys of the rows whose sketches differ like those of at least so many texts, by most of the orders."""
    each = rows.select(*keys, F.posexplode("__sketch").alias("k", "v")).distinct().groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(*keys).agg(F.sum((F.col("c") >= contexts).cast("int")).alias("c")).where(F.col("c") > SKETCH // 2).drop("c")


def disclosures(found: DataFrame, docs: DataFrame, threshold: float = 0.9, contexts: int = 2) -> DataFrame:
    """entity, term, remove: the pairs in which the term gives the entity away.

    found has __uid, __entities, __words and __sketch. Counts are documents: n with both, n_entity, n_term,
    and N. The pair discloses when ln(N n / (n_entity n_term)) >= threshold * ln(N / n_entity), which is
    1 when the term never occurs without the entity. It must occur in at least contexts different
    texts: one text and its copies do not make a pattern, two texts do. Terms that always come with the entity
    are removed, others generalised.

    As n is at most n_entity, words too frequent to disclose go before they are paired, and so do entities
    that are in too few texts; no pair is lost by that.
    """
    of = found.select("__uid", "__sketch", F.explode("__entities").alias("entity"))
    n_entity = of.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    kept = staged(several_texts(of, ["entity"], contexts).join(n_entity, "entity").join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("all"))), F.lit(True)), "pii-entities")
    own = F.log(F.col("all") / F.col("n_entity"))
    most = F.col("n_entity") * F.exp(own * (1 - threshold))  # documents that a term may be in
    of = of.join(kept, "entity").select("__uid", "__sketch", "entity", "n_entity", "all", most.alias("most"))
    held = found.join(of.select("__uid").distinct(), "__uid", "left_semi")
    inside = held.select("__uid", F.explode(F.array_distinct("__words.term")).alias("term"))
    top = F.broadcast(kept.agg(F.max(most).alias("top")))  # one row
    rare = term_frequencies(docs).where(F.col("n_term") >= contexts).join(top, F.col("n_term") <= F.col("top") + 1).drop("top")
    both = inside.join(rare, "term").join(of, "__uid").where(F.col("n_term") <= F.col("most") + 1)
    pairs = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"), F.first("all").alias("all"))
    known = F.log(F.col("all") * F.col("n") / (F.col("n_entity") * F.col("n_term")))
    pairs = pairs.where((own > 0) & (known >= own * threshold)).select("entity", "term", (F.col("n") >= F.col("n_term")).alias("remove"))
    pairs = staged(pairs, "pii-pairs")
    met = inside.join(pairs.select("term").distinct(), "term", "left_semi").join(of.select("__uid", "__sketch", "entity"), "__uid").join(pairs, ["entity", "term"])
    return pairs.join(several_texts(met, ["entity", "term"], contexts), ["entity", "term"])


def _places(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """__uid2 and __terms (start, end, remove) of the documents with disclosing terms."""
    pairs = staged(pairs, "pii-disclosures")
    of = found.select("__uid", F.explode("__entities").alias("entity")).join(pairs.select("entity").distinct(), "entity", "left_semi")
    held = found.join(of.select("__uid").distinct(), "__uid", "left_semi")
    words_of = held.select("__uid", F.explode("__words").alias("x")).select("__uid", "x.term", "x.start", "x.end")
    words_of = words_of.join(pairs.select("term").distinct(), "term", "left_semi")
    hit = words_of.join(of, "__uid").join(pairs, ["entity", "term"]).groupBy("__uid", "start", "end").agg(F.max("remove").alias("remove"))
    return hit.groupBy(F.col("__uid").alias("__uid2")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "remove"))).alias("__terms"))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def annotate(docs: DataFrame, threshold: float = 0.9, contexts: int = 2) -> DataFrame:
    """One row for each document: doc_id, counts, hash of the base spans, and all spans.

    Equal rows give equal rows. Only ids, spans and the words of documents with an entity leave the first scan.
    """
    docs = spread(docs.select("doc_id", "text"))
    found = find(docs).select(F.monotonically_increasing_id().alias("__uid"), F.col("__row.doc_id").alias("doc_id"), "__spans", "__entities", "__words", "__sketch")
    found = staged(found, "pii-found")
    places = _places(found, disclosures(found, docs, threshold, contexts))
    out = found.join(places, F.col("__uid") == F.col("__uid2"), "left")
    term = F.transform(F.coalesce("__terms", F.array().cast("array<struct<start:int,end:int,remove:boolean>>")), lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_text(F.col("__spans")), 256).alias("base_sha256"), _text(F.concat("__spans", term)).alias("spans"), F.size(term).cast("long").alias("n_terms"))


def general(term: str) -> str:
    """The shape of a term: its digits as #, its letters as the word for any term."""
    return re.sub(r"[0-9]", "#", term) if any(c in "0123456789" for c in term) else "[TERM]"


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with (start, end, replacement) put in; of overlapping spans the first, then the longest."""
    out, at = [], 0
    for s, e, new in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], new]
            at = e
        elif e > at:  # the rest of a span that sticks out goes too
            at = e
    return "".join([*out, text[at:]])


#: Rows up to which the documents with disclosing terms are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def sanitise(docs: DataFrame, threshold: float = 0.9, contexts: int = 2) -> DataFrame:
    """docs with personal data replaced in column text; all rows and columns stay.

    Base spans become their kind in brackets; disclosing terms are generalised or removed. Null texts
    stay null. Other columns, whatever their names, stay as they are.
    """
    found = staged(find(docs).withColumn("__uid", F.monotonically_increasing_id()), "pii-rows")
    places = staged(_places(found, disclosures(found, docs, threshold, contexts)), "pii-places")
    side = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    rows = found.drop("__entities", "__words", "__sketch").join(side, F.col("__uid") == F.col("__uid2"), "left")
    some = (F.size("__spans") > 0) | F.col("__terms").isNotNull()
    rows = rows.select("__row", F.col("__row.text").alias("__text"), F.when(some, F.col("__spans")).alias("__spans"), "__terms")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans, terms in zip(*[b.column(c).to_pylist() for c in ("__text", "__spans", "__terms")], strict=True):
                if t is not None and (spans or terms):
                    t = redact(t, [
                        *[(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in spans or []],
                        *[(s["start"], s["end"], "" if s["remove"] else general(t[s["start"]:s["end"]])) for s in terms or []]])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(texts, pa.string())], ["__row", "__text"])

    clean = rows.mapInArrow(put, f"__row {rows.schema['__row'].dataType.simpleString()}, __text string")
    return clean.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
