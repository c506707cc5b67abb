"""Quality rules, personal data, token lengths, mixing and toxicity against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from consigna.llm import lengths, mixing, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words int, score string, p string, token string, bucket string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 7, "x", "y", "z", "b") for i, t, s in rows], DOCS)


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "no id here", "b"), (5, "same row", "b"), (5, "same row", "b"), (6, "long " * 30_000, None)]


# --- quality -------------------------------------------------------------------------------------

def stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(["a", "b", "ü", "f", " ", " ", "\n", "\t", "\x0b", "\x0c", "#", "*", "<"], k=rnd.randrange(120))) for _ in range(150)]
    texts += ["x y z v w " * 6, "a a a a a a", "one two three four five\none two three four five"]
    rows = [*EDGES, *[(10 + i, t, "c") for i, t in enumerate(texts)]]
    got = quality.score_quality(docs(spark, rows), []).collect()
    want = Counter((i, *stats(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or r.n_repeat_words * 100 > r.n_words * 20) and r.kept == (not r.base_failed)


def test_decision_list():
    rnd = np.random.default_rng(2)
    x = rnd.random((4000, len(quality.FEATURES)))
    x = x[(abs(x[:, [1, 4, 6]] - [0.7, 0.5, 0.9]) > 0.02).all(axis=1)]  # thresholds lie in gaps
    y = np.where((x[:, 1] > 0.7) & (x[:, 4] <= 0.5) | (x[:, 6] > 0.9), 0, 1)
    rules = quality.learn(x, y)
    reject = np.zeros(len(x), bool)
    for r in rules:
        hit = np.ones(len(x), bool)
        for f, op, v in r.tests:
            c = x[:, quality.FEATURES.index(f)]
            hit &= c <= v if op == "<=" else c > v
        reject |= hit
    assert len(rules) >= 2 and (reject & (y == 1)).sum() <= 0.03 * reject.sum() and (reject & (y == 0)).sum() >= 0.9 * (y == 0).sum()
    assert quality.learn(x[:0], y[:0]) == [] == quality.learn(x, np.ones(len(x), int))


def test_quality_filter_keeps_rows_and_columns(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "a") for i in range(40, 100)]
    bad = [(i, " ".join(f"w{i}x{k}###" for k in range(30)), "a") for i in range(100, 160)]
    df = docs(spark, [*EDGES, *good, *bad])
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(40, 160)] + [(40, None, 1), (None, 1, 1), (41, 0, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit_rules(df, labels)
    out = quality.keep_good(df, rules)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(40, 100))
    none = spark.createDataFrame([], labels.schema)
    assert quality.fit_rules(df, none) == [] and quality.score_quality(df.limit(0), []).count() == 0


# --- personal data -------------------------------------------------------------------------------

def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="01259.@+- ()ab%_é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_by_hand():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112; a.b+c@x.y.co.uk. 1.2.3.4.5 300.1.1.1 +1 (555) 010-9999 @@a@b.c"
    assert pii.base_spans(text) == plain_spans(text)
    assert [pii.KINDS[k] for k, *_ in pii.base_spans(text)] == ["email", "email", "ip", "card", "phone"]
    assert pii.base_spans("1" * 50_000 + "@" + "." * 50_000) == []


def test_annotate_and_disclosure(spark):
    rnd = random.Random(3)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = rnd.choices(filler, k=20)
        if i % 5 == 0:
            at = rnd.randrange(3, 15)
            w[at:at] = ["Zorblatt,", "jo@mail.example.com"]
        rows.append((100 + i, " ".join(w), "s"))
    rows += EDGES
    out = {(r.doc_id, r.spans): r for r in pii.annotate(docs(spark, rows)).collect()}
    assert len(pii.annotate(docs(spark, rows)).collect()) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for (i, _), r in out.items():
        base = plain_spans(text[i])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, *_ in base) for n in range(4))
        terms = [x.split(":") for x in r.spans.split(",") if x.startswith("term")]
        assert {text[i][int(a):int(b)] for _, a, b in terms} == ({"Zorblatt"} if base else set())
    clean = pii.sanitise(docs(spark, rows))
    assert clean.columns == docs(spark, rows).columns and clean.count() == len(rows)
    for r in clean.collect():
        if r.doc_id in range(100, 160, 5):
            assert "[EMAIL]" in r.text and "Zorblatt" not in r.text and "@" not in r.text
        else:
            assert (r.text or "") == text[r.doc_id]
    assert [r.text for r in clean.where("doc_id = 1").collect()] == [None]
    assert pii.annotate(docs(spark, [])).count() == pii.sanitise(docs(spark, [])).count() == 0


def test_copies_are_no_pattern(spark):
    rows = [(i, "alpha beta gamma me@x.org delta epsilon", "s") for i in range(40)] + [(100 + i, f"other text {i}", "s") for i in range(60)]
    assert {r.n_terms for r in pii.annotate(docs(spark, rows)).collect()} == {0}


def test_names_in_fixed_phrases(spark):
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choices([f"word{i}" for i in range(40)], k=n))
    rows = [(i, f"{say(20)} Contact Jane Doe jane@x.org {say(20)}", "s") for i in range(2)] + [(10 + i, f"{say(20)} contact {say(20)}", "s") for i in range(60)]
    near = f"{say(60)} Ann Near ann@x.org {say(60)}"
    rows += [(90 + i, f"{near} end{i}", "s") for i in range(9)]  # near copies of one text
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    for i in range(2):
        assert "Contact" in clean[i] and "[EMAIL]" in clean[i] and not re.search("Jane|Doe", clean[i])
    assert all("Ann Near [EMAIL]" in clean[90 + i] for i in range(9))


def test_names_far_from_the_entity(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choices([f"word{i}" for i in range(40)], k=n))
    rows = [(i, f"Zorblatt {say(30)} zorblatt, {say(30)} jo@x.org {say(30)} (Zorblatt)", "s") for i in range(3)] + [(10 + i, say(80), "s") for i in range(60)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert not any("zorblatt" in clean[i].lower() for i in range(3))
    assert all(clean[i] == t for i, t, _ in rows[3:])
    assert {r.doc_id: r.n_terms for r in pii.annotate(docs(spark, rows)).collect()} == {i: 3 * (i < 3) for i, *_ in rows}


def test_redact():
    assert pii.redact("abcdefgh", [(1, 3, "X"), (2, 5, "Y"), (6, 7, "")]) == "aXfh"
    assert pii.general("AB12") == "AB##" and pii.general("Name") == "[TERM]"


# --- lengths -------------------------------------------------------------------------------------

def test_length_histogram(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["one", "zwei", "trois", "ñ", "\U0001f600", "<|endoftext|>"], k=rnd.randrange(40))) for _ in range(200)]
    rows = [*EDGES, *[(i, t, rnd.choice(["a", "b", None])) for i, t in enumerate(texts)]]
    ranks = lengths.vocabulary()
    enc = lengths.encoder(ranks)
    n = [(s, len(enc.encode_ordinary(t or ""))) for _, t, s in rows]
    assert all(enc.decode_bytes(enc.encode_ordinary(t)).decode() == t for t in texts)
    counted = lengths.token_lengths(docs(spark, rows), ["source"], ranks).cache()
    assert Counter((r.source, r.length) for r in counted.collect()) == Counter(n)
    for by in ([], ["source"]):
        got = lengths.length_histogram(counted, by).collect()
        for r in got:
            own = [k for s, k in n if not by or s == r.source]
            assert (r.n_docs, r.docs_at_least, r.docs_at_most) == (own.count(r.length), sum(k >= r.length for k in own), sum(k <= r.length for k in own))
            assert r.tokens_at_least == sum(k for k in own if k >= r.length) and r.truncated_total == sum(min(k, r.length) for k in own)
            assert r.share_at_most == pytest.approx(r.docs_at_most / len(own))
        assert sum(r.n_docs for r in got) == len(rows)
    whole = lengths.length_histogram(counted)
    asked = spark.createDataFrame([(0,), (7,), (7,), (10**7,), (None,), (-3,)], "limit int")
    for r in lengths.answer_limits(whole, asked).collect():
        assert (r.docs_longer, r.tokens_longer, r.truncated_total) == (
            sum(k > r.limit for _, k in n), sum(k for _, k in n if k > r.limit), sum(min(k, r.limit) for _, k in n))
    q = lengths.quantiles(whole, [0.5, 1.0]).first()
    assert q.q500 == sorted(k for _, k in n)[-(-len(n) // 2) - 1] and q.q1000 == max(k for _, k in n)
    assert lengths.length_histogram(counted.limit(0)).count() == 0


def test_blocks_of_lengths(spark):
    n = [1, 5, 5, 8191, 8192, 8193, 40_000, 40_000]
    got = lengths.length_histogram(spark.createDataFrame([(k,) for k in n], "length long")).collect()
    assert {r.length: (r.docs_at_least, r.truncated_total) for r in got} == {k: (sum(x >= k for x in n), sum(min(x, k) for x in n)) for k in n}


def test_limits_between_blocks(spark):
    """Limits in every place around the lengths, in groups and without, against plain sums."""
    n = [("a", k) for k in (0, 1, 5, 5, 8191, 8192, 8193, 40_000, 40_000)] + [(None, k) for k in (3, 90_000)]
    asked = [0, 1, 4, 5, 6, 8190, 8191, 8192, 8193, 8194, 30_000, 40_000, 40_001, 89_999, 90_000, 10**9]
    limits = spark.createDataFrame([(k,) for k in asked], "limit long")
    lengths_ = spark.createDataFrame(n, "source string, length long")
    for by in ([], ["source"]):
        got = lengths.answer_limits(lengths.length_histogram(lengths_, by), limits, by).collect()
        assert len(got) == len(asked) * (2 if by else 1)
        for r in got:
            own = [k for s, k in n if not by or s == r.source]
            assert (r.docs_longer, r.tokens_longer, r.truncated_total) == (
                sum(k > r.limit for k in own), sum(k for k in own if k > r.limit), sum(min(k, r.limit) for k in own))
        assert lengths.answer_limits(lengths.length_histogram(lengths_.limit(0), by), limits, by).collect() == []
        assert lengths.answer_limits(lengths.length_histogram(lengths_, by), limits.limit(0), by).collect() == []


# --- mixing --------------------------------------------------------------------------------------

def plain_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total, free = {}, sum(sizes.values()), set(names)
    while free:
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            free.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", "B", "é", "z", None, "huge", "tiny"]), rnd.randrange(50)) for _ in range(300)] + [("tiny", 1)] + [("huge", 5000)] * 20 + [("zero", 0)]
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    for s, t in plain_targets(dict(sizes)).items():
        assert got[s] == (sizes[s], pytest.approx(t, rel=1e-9, abs=1e-9))


def test_pivot_keeps_mass_and_chances():
    rnd = random.Random(5)
    rows = [(i, "s", 0.3, rnd.randrange(1, 100)) for i in range(60)]
    total, times = sum(p * w for *_, p, w in rows), 400
    seen = np.zeros(len(rows))
    for seed in range(times):
        p = mixing._pivot(rows, seed, 0, False)
        assert sum(x * r[3] for x, r in zip(p, rows, strict=True)) == pytest.approx(total)
        assert sum(0 < x < 1 for x in p) <= 1
        seen += p
    assert abs(seen / times - 0.3).max() < 0.12


@pytest.mark.parametrize("bucket", [7, 10**6])
def test_mix(spark, bucket):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(0, 60), rnd.choices(["a", "b", "c", None], [6, 1, 2, 1])[0]) for i in range(900)] + EDGES
    df = docs(spark, rows)
    got = mixing.mix(df, bucket_rows=bucket).collect()
    again = mixing.mix(df.repartition(5), bucket_rows=bucket).collect()
    as_rows = lambda x: Counter((r.doc_id, r.source, r.size, r.taken) for r in x)
    assert as_rows(got) == as_rows(again) and len(got) == len(rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) + 1e-6
        assert own[0].source_size == sum(r.size for r in own)
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert not r.size or int(rate) <= r.copies <= int(rate) + 1
    assert mixing.mix(df.limit(0)).count() == 0


# --- toxicity ------------------------------------------------------------------------------------

def toxic_corpus(n=600):
    rnd = random.Random(7)
    bad, plain = ["vilewort", "gronk", "blarghead", "snivel"], [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rnd.choices(plain, k=rnd.randrange(15, 60))
        y = int(rnd.random() < 0.25)
        for _ in range(3 * y):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        if y:
            w.insert(rnd.randrange(len(w)), "you")
        rows.append((1000 + i, " ".join(w), "s"))
        labels.append((1000 + i, 1, y))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    df = docs(spark, [*rows, *EDGES])
    known = spark.createDataFrame([*labels, (None, 1, 1), (6, 1, None), (1000, 1, 1 - labels[0][2])], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, known, rounds=10)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) + len(EDGES)
    truth = {i: y for i, _, y in labels}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 3))


def test_held_out_labels_are_not_used(spark):
    rows, labels = toxic_corpus(300)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    scores = []
    for known in (labels, flipped):
        df = docs(spark, rows)
        model = toxicity.fit(df, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), rounds=3)
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(df, model).collect()))
    assert scores[0] == scores[1]


def test_toxicity_without_labels(spark):
    df, none = docs(spark, EDGES), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.5}
    assert toxicity.score(df.limit(0), toxicity.fit(df, none)).count() == 0


def test_forms():
    assert toxicity.form("GrOnK!!") == ("gronk", False)
    assert toxicity.form("gr0nk") == ("gronk", True) == toxicity.form("g-r.o-n-k")
    assert toxicity.form("grooonk") == ("gronk", True)
    assert toxicity.form("1234") == ("", False) and toxicity.form("") == ("", False)
    assert toxicity.features("", {}) == [0.0] * len(toxicity.FEATURES)
