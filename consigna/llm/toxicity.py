"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

A lexicon is induced from labelled documents: word forms (and beginnings of words) that occur far more
in documents with label 1. Features are densities and weights of lexicon hits, how near they stand to
second-person words, and rates of capitals, punctuation and obfuscated words. A labelled document's
features use a lexicon made without its own fold, so trees do not learn from leaked hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged, words

FOLDS = 5
HELD_OUT = 0
#: Fold that fits the calibration; the trees use the others.
CALIBRATION = 4
LEXICON_MAX = 3000
#: A form must be so much likelier (natural log) in documents with label 1.
WEIGHT_MIN = 2.0
#: Second-person words of the four languages.
SECOND_PERSON = frozenset("""
    you your yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos
    tú ti tus usted ustedes vosotros""".split())
#: Fixed substitutions that obfuscated words use.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = [
    "hits", "hit_density", "weight_max", "weight_top3", "beginnings", "beginning_density", "beginning_weight_max",
    "second_rate", "second_nearness", "second_share", "upper_rate", "exclaim_rate", "question_rate", "mark_rate",
    "obfuscation_rate", "obfuscated_hits", "log_words",
]
_EDGE = ".,;:!?\"'()[]{}<>*#&%$_-–—…«»“”„¡¿"
_REPEAT = re.compile(r"(.)\1{2,}")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)).cast("int")


def form(word: str) -> tuple[str, bool]:
    """Plain form of a word and whether it was obfuscated."""
    low = word.strip(_EDGE).lower()
    if low.isalpha():
        if len(low) > 3 and _REPEAT.search(low):
            return _REPEAT.sub(r"\1", low), True
        return low, False
    if not any(c.isalpha() for c in low):
        return "", False
    plain = "".join(c for c in low.translate(PLAIN) if c.isalpha())
    return plain, len(plain) >= 3


def keys(plain: str) -> list[str]:
    """Lexicon keys of a plain form: itself and its beginnings of four and five letters."""
    return ["w:" + plain, *["b:" + plain[:n] for n in (4, 5) if len(plain) >= n]] if plain else []


Lexicon = dict[str, float]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The features of one whole text; all zero for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    hits, starts, odd, odd_hits = {}, {}, 0, 0
    second, second_words = 0, set()
    for w, c in counts.items():
        plain, obfuscated = form(w)
        if not plain:
            continue
        odd += c * obfuscated
        if plain in SECOND_PERSON:
            second += c
            second_words.add(w)
        weight = lexicon.get("w:" + plain)
        if weight is not None:
            hits[w] = weight
            odd_hits += c * obfuscated
        start = max(lexicon.get("b:" + plain[:4], 0.0), lexicon.get("b:" + plain[:5], 0.0))
        if start:
            starts[w] = start
    toxic = hits.keys() | starts.keys()
    nearness, near = 0.0, 0
    if toxic and second:
        places = [i for i, w in enumerate(words) if w in second_words]
        at, gaps = 0, []
        for i, w in enumerate(words):
            if w in toxic:
                while at + 1 < len(places) and abs(places[at + 1] - i) <= abs(places[at] - i):
                    at += 1
                gaps.append(abs(places[at] - i))
        nearness, near = 1.0 / (1 + min(gaps)), sum(g <= 5 for g in gaps) / len(gaps)
    letters = max(1, sum(map(len, words)))
    top = sorted(hits.values(), reverse=True)[:3]
    marks = sum(text.count(c) for c in ".,;:!?")
    return [
        float(len(hits)), 100.0 * sum(counts[w] for w in hits) / n, top[0] if top else 0.0, sum(top),
        float(len(starts)), 100.0 * sum(counts[w] for w in starts) / n, max(starts.values(), default=0.0),
        100.0 * second / n, nearness, float(near), sum(map(str.isupper, text)) / letters, 100.0 * text.count("!") / n, 100.0 * text.count("?") / n,
        100.0 * marks / n, 100.0 * odd / n, float(odd_hits), math.log1p(n),
    ]


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text, label, fold of at most max_rows labelled documents of each label.

    Only rows outside the held-out fold, picked by a hash of the id. Null labels and ids whose labels
    disagree are not used; of texts with the same least hash of four words (copies and most near copies)
    one counts, else their rare words would look telling. max_rows bounds the broadcast ids and all that
    is learned from.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("toxic").alias("label"), F.max("toxic").alias("__l2")).where("label = __l2 AND label IN (0, 1)")
        .withColumn("fold", fold_of(F.col("__id"))).where(F.col("fold") != HELD_OUT)
    )
    some = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select("__id", "label", "fold")
        some = part if some is None else some.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    rows = spread(rows).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), "fold")
    w = words(F.lower("text"))
    rows = rows.withColumn("__w", w).withColumn("sketch", F.expr(
        "CASE WHEN size(__w) < 4 THEN xxhash64(text) ELSE array_min(transform(sequence(0, size(__w) - 4), i -> xxhash64(__w[i], __w[i+1], __w[i+2], __w[i+3]))) END"))
    rows = staged(rows.drop("__w"), "toxicity-labelled")
    first = rows.groupBy("sketch").agg(F.min("doc_id").alias("first"))
    return staged(rows.join(first.select(F.col("sketch").alias("s"), "first"), (F.col("sketch") == F.col("s")) & (F.col("doc_id") == F.col("first"))).select(
        "doc_id", "text", "label", "fold"), "toxicity-rows").dropDuplicates(["doc_id"])


def induce(rows: DataFrame) -> dict[int, Lexicon]:
    """Lexicons by fold, each from the other folds' documents; 0 has that of all.

    A key's weight is the log ratio of its document shares under the two labels. It must be surely above
    chance (three standard errors). The LEXICON_MAX surest keys are kept: that bounds what tasks hold.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text, label, fold in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("fold").to_pylist(), strict=True):
                found = {k for w in set(text.split()) for k in keys(form(w)[0])}
                seen.update((k, label, fold) for k in found)
            if seen:
                k, label, fold = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(label, pa.int32()), pa.array(fold, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["key", "label", "fold", "n"])

    counted = rows.mapInArrow(count, "key string, label int, fold int, n long")
    totals = Counter({(r["label"], r["fold"]): r["count"] for r in rows.groupBy("label", "fold").count().collect()})
    part = lambda label, fold: F.sum(F.when((F.col("label") == label) & (F.col("fold") == fold), F.col("n")).otherwise(0))
    by = counted.groupBy("key").agg(*[part(y, f).alias(f"n{y}_{f}") for y in (0, 1) for f in range(FOLDS)])
    by = staged(by, "toxicity-keys")
    out = {}
    for without in range(FOLDS):
        folds = [f for f in range(FOLDS) if f != without]
        n0, n1 = (sum(totals[y, f] for f in folds) for y in (0, 1))
        a, b = (sum((F.col(f"n{y}_{f}") for f in folds), F.lit(0)) + 0.5 for y in (1, 0))
        weight = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1))
        sure = weight / F.sqrt(1 / a + 1 / b)
        best = by.select("key", weight.alias("weight"), sure.alias("sure")).where(f"sure >= 3 AND weight >= {WEIGHT_MIN}").orderBy(F.col("sure").desc(), "key").limit(LEXICON_MAX)
        out[without] = {r["key"]: r["weight"] for r in best.collect()}
    return out


def with_features(rows: DataFrame, lexicons: dict[int, Lexicon]) -> DataFrame:
    """rows (doc_id, text, fold, ...) with the text replaced by column features."""
    rest = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "", shared.value[f]) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(x, pa.list_(pa.float64()))], [*rest, "features"])

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest]
    return rows.mapInArrow(work, ", ".join([*fields, "features array<double>"]))


@dataclass
class Model:
    lexicons: dict[int, Lexicon]
    trees: Any
    calibration: Any
    base: float


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, rounds: int = 30) -> Model:
    """Learn from at most max_rows documents of each label, none of them held out.

    Without both labels there are no trees and every score is the share of label 1 (0.5 without rows).
    The calibration is fitted on at most 1001 score steps.
    """
    rows = labelled(docs, labels, max_rows)
    known = {r["label"]: r["count"] for r in rows.where(F.col("fold") != CALIBRATION).groupBy("label").count().collect()}
    if len(known) < 2:
        n = sum(known.values())
        return Model({f: {} for f in range(FOLDS)}, None, None, known.get(1, 0) / n if n else 0.5)
    lexicons = induce(rows)
    x = with_features(rows, lexicons)
    x = staged(x.select(F.col("label").cast("double").alias("label"), "fold", "features"), "toxicity-features")
    x = x.withColumn("features", array_to_vector("features")).coalesce(8)
    trees = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.2, seed=7).fit(x.where(F.col("fold") != CALIBRATION))
    p = F.round(vector_to_array("probability")[1], 3)
    steps = trees.transform(x.where(F.col("fold") == CALIBRATION)).groupBy(p.alias("p")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    curve = None
    if steps.agg(F.min("label") < F.max("label")).first()[0]:
        curve = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="even").fit(steps)
    return Model(lexicons, trees, curve, 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Null texts count as empty; empty texts have a score too. The score is the calibrated chance; a
    thousandth of it is the trees' own, so that steps of the calibration keep their order inside.
    """
    docs = spread(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    held = (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out")
    if model.trees is None:
        out = docs.select("doc_id", held, F.lit(float(model.base)).alias("score"))
    else:
        x = with_features(docs.withColumn("fold", F.lit(0)), model.lexicons).withColumn("features", array_to_vector("features"))
        x = model.trees.transform(x).select("doc_id", vector_to_array("probability")[1].alias("p"))
        if model.calibration is not None:
            x = model.calibration.transform(x)
        even = F.col("even") if model.calibration is not None else F.col("p")
        out = x.select("doc_id", held, F.least(F.greatest(even * 0.999 + F.col("p") * 0.001, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
