"""Quality rules: statistics of a text as Spark columns and a decision list learned from labels.

The list is a sequence of threshold conjunctions. Sequential covering adds one conjunction at a
time: it grows on one part of the labelled rows, is pruned on the other, and the rows it covers are
taken out before the next. What comes out is one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.llm.common import spread

SYMBOLS = "#*$%&|<>"
#: Statistics that conditions may use.
FEATURES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate"]

# Words, lines and window hashes are bound to lambda variables, so each is worked out once for a text;
# inline() keeps filters on the statistics above them. Words under repeated windows: equal windows have
# equal hashes, so a text whose hashes all differ has none; only the others sort their windows.
_STATS = r"""
inline(transform(array(filter(split(__t, '[\\x20\\x09-\\x0D]+'), x -> x != '')), w ->
  transform(array(filter(split(__t, '\\n', -1), x -> length(translate(x, {white}, '')) > 0)), l ->
  transform(array(CASE WHEN size(w) < 5 THEN array() ELSE
      transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i+1], w[i+2], w[i+3], w[i+4])) END), h ->
  named_struct(
    'n_words', CAST(size(w) AS BIGINT),
    'word_chars', CAST(length(translate(__t, {white}, '')) AS BIGINT),
    'n_symbols', CAST(length(__t) - length(translate(__t, {symbols}, '')) AS BIGINT),
    'n_lines', CAST(size(l) AS BIGINT),
    'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT),
    'n_repeat_words', CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
      transform(array(array_sort(transform(sequence(0, size(w) - 5), i -> struct(array_join(slice(w, i + 1, 5), ' ') AS g, i AS i)))), s ->
        aggregate(
          array_sort(filter(transform(s, (x, k) -> IF(coalesce(get(s, k - 1).g = x.g, false) OR coalesce(get(s, k + 1).g = x.g, false), x.i, -1)), p -> p >= 0)),
          named_struct('n', 0L, 'e', 0L),
          (a, p) -> named_struct('n', a.n + p + 5 - greatest(a.e, p), 'e', p + 5L),
          a -> a.n))[0] END,
    'n_distinct', CAST(size(array_distinct(w)) AS BIGINT),
    'n_upper', CAST(length(__t) - length(translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT),
    'n_digits', CAST(length(__t) - length(translate(__t, '0123456789', '')) AS BIGINT),
    'n_marks', CAST(length(__t) - length(translate(__t, '!?', '')) AS BIGINT)))[0])[0]))""".format(
    white=r"' \t\n\u000b\u000c\r'", symbols=f"'{SYMBOLS}'")


def text_stats(docs: DataFrame, keep: list[str | Column]) -> DataFrame:
    """The columns in keep and the statistics of column text.

    A null text counts as empty. An empty text has no words and zero in every statistic. Equal rows
    give equal rows. Other columns of docs are not looked at.
    """
    kept = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keep]
    base = docs.select(F.struct(*kept).alias("__k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    base = base.select("__k", F.expr(_STATS))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rates = {
        "word_length": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
        "upper_rate": per("n_upper", "word_chars"), "digit_rate": per("n_digits", "word_chars"),
        "mark_rate": per("n_marks", "n_words"), "distinct_rate": per("n_distinct", "n_words"),
    }
    return base.withColumns(rates).select("__k.*", *[c for c in base.columns if c != "__k"], *rates)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


@dataclass(frozen=True)
class Rule:
    """All of (feature, '<=' or '>', threshold) hold."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        c = F.lit(True)
        for feature, op, value in self.tests:
            c = c & (F.col(feature) <= value if op == "<=" else F.col(feature) > value)
        return c


def labelled_stats(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most max_rows labelled documents, picked by a hash of the id.

    Labels that are null, and ids whose labels disagree, are not used. Base failures are left out:
    they are rejected whatever the list says.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"), F.max("quality").alias("__q2"))
        .where("__q = __q2").orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select("__id", "__q")
    )  # max_rows bounds the broadcast side
    some = spread(docs.select("doc_id", "text")).join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    some = some.select("__id", "__q", "text").dropDuplicates(["__id"])
    stats = text_stats(some, ["__id", "__q"]).select(F.xxhash64("__id").alias("__h"), "__id", "__q", base_failed().alias("__f"), *FEATURES)
    rows = sorted((r for r in stats.collect() if not r["__f"]), key=lambda r: (r["__h"], r["__id"]))
    return np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["__q"] for r in rows], int)


def _candidates(x: np.ndarray, cuts: int) -> list[tuple[int, str, float]]:
    out = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)))
        out += [(j, op, float(v)) for v in (values[:-1] + values[1:]) / 2 for op in ("<=", ">")]
    return out


def _holds(x: np.ndarray, tests: list[tuple[int, str, float]]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for j, op, v in tests:
        m &= x[:, j] <= v if op == "<=" else x[:, j] > v
    return m


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.97, max_tests: int = 3, max_rules: int = 12, cuts: int = 64) -> list[Rule]:
    """Decision list that rejects rows with label 0.

    A rule stays when it covers at least five rejected rows of the pruning part (two when there are
    few rows) and at least the given share of what it covers there is rejected. No rows, or one class
    only, give an empty list: everything is kept. Ties between tests go to the first one.
    """
    rules: list[Rule] = []
    if len(x) == 0 or y.min() == y.max():
        return rules
    prune = np.arange(len(x)) % 3 == 0  # the rows come in hash order
    least = 5 if (y == 0).sum() >= 100 else 2
    left = np.ones(len(x), bool)
    every = _candidates(x, cuts)
    masks = [(_holds(x, [c]), c) for c in every]
    while len(rules) < max_rules:
        grow, bad = left & ~prune, y == 0
        tests, now = [], grow.copy()
        while len(tests) < max_tests and (now & ~bad).any():
            p0, n0 = (now & bad).sum(), (now & ~bad).sum()
            if not p0:
                break
            best, gain = None, 0.0
            for m, c in masks:
                p, n = (now & bad & m).sum(), (now & ~bad & m).sum()
                g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                if g > gain + 1e-9:
                    best, gain = (m, c), g
            if best is None:
                break
            tests.append(best[1])
            now &= best[0]
        if not tests:
            break

        def worth(ts, over=left & prune, bad=bad):
            m = over & _holds(x, ts)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return ((p - n) / (p + n) if p + n else -1.0, p, n)

        while len(tests) > 1 and worth(tests[:-1])[0] >= worth(tests)[0]:
            tests = tests[:-1]
        _, p, n = worth(tests)
        if p < least or p < precision * (p + n):
            break
        rules.append(Rule(tuple((FEATURES[j], op, v) for j, op, v in tests)))
        left &= ~_holds(x, tests)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false for rejected rows."""
    out = F.when(base_failed(), F.lit(False))
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[Rule]:
    """Learn on a sample of at most max_rows labelled documents."""
    return learn(*labelled_stats(docs, labels, max_rows))


def score_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each document: doc_id, statistics, base_failed, kept."""
    stats = text_stats(spread(docs.select("doc_id", "text")), ["doc_id"])
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents the list keeps, with all their columns, whatever these are called."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return text_stats(docs, [whole]).where(verdict(rules)).select("__row.*")
