"""Chat formatting, decontamination, site trees, the Jaccard join and archives against plain Python."""

import hashlib
import inspect
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from consigna.llm.common import ship
from consigna.llm import arc, chat, decontaminate, jaccard, lengths, site_tree

EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (5, "same row"), (5, "same row"), (6, "long " * 30_000)]


# --- chat ----------------------------------------------------------------------------------------

@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<|\\im_end>start \né\U0001f600", max_size=40))
def test_escape(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_chat(spark):
    rnd = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "hi ", "\n", "\U0001f600", "é", "<", "|", "<|im_sep|>"]
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([None, 0, 1, 2, 300, 700]), rnd.choice(["user", "assistant", None, "<|im_sep|>"]),
             rnd.choice([None, "", "".join(rnd.choices(bits, k=rnd.randrange(9)))])) for _ in range(150)]
    rows += [(9, i, "assistant", f"turn {i}") for i in range(600)] + [rows[0]] * 3
    turns = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, ids string, start int")
    ranks = lengths.vocabulary()
    pieces = chat.format_conversations(turns, ranks)
    convs = {}
    key = lambda r: hashlib.sha256(f"{r[2] or ''}\n{r[3] or ''}".encode()).digest()[:16]
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, key(r))):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    by = {}
    for p in pieces.collect():
        by.setdefault(p.conv_id, []).append(p)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += len(p.ids)
    got = {r.conv_id: r for r in chat.digests(chat.read_back(pieces, ranks)).collect()}
    assert got.keys() == convs.keys()
    for c, own in convs.items():
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.escape(a)) + len(chat.escape(b)) + sum(map(len, chat.CONTROL)) for a, b in own)
    assert chat.digests(chat.read_back(chat.format_conversations(turns.limit(0), ranks), ranks)).count() == 0


# --- decontamination -----------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(a, b):
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_regions_against_all_alignments(seed):
    rnd = random.Random(seed)
    words = ["th", "on", "er", "the", "and", "ing", "re", "st"]
    say = lambda n: "".join(rnd.choice(words) + (" " if rnd.random() < 0.4 else "") for _ in range(n))
    items = [(k, say(rnd.choice([25, 50, 90]))) for k in range(6)]
    p = decontaminate.patterns(items, 6, 60, 0.1)
    for _ in range(30):
        text = say(60)
        if rnd.random() < 0.8:
            c = list(rnd.choice(items)[1][rnd.randrange(10):])
            for _ in range(rnd.randrange(9)):
                at = rnd.randrange(len(c))
                c[at:at + 1] = rnd.choice([[], ["x"], [c[at], "q"]])
            at = rnd.randrange(len(text))
            text = text[:at] + "".join(c) + text[at:]
        codes = decontaminate.normal(text)[0]
        got = {i for i, *_ in decontaminate.regions(p, codes)}
        want = {i for i, c in enumerate(p.codes) if nearest(c.tolist(), codes.tolist()) <= p.budgets[i]}
        assert got == want


def test_regions_in_slices(monkeypatch):
    """Steps of few rows find what one step finds, also where the benchmark repeats a passage many times."""
    rnd = random.Random(8)
    say = lambda n: " ".join("".join(rnd.choices("abcde", k=rnd.randrange(2, 6))) for _ in range(n))
    common = say(20)
    items = [(k, f"{common} {say(12)}") for k in range(40)]
    p = decontaminate.patterns(items, 6, 50, 1 / 8)
    text = " ".join(f"{say(30)} {rnd.choice(items)[1][:80 + rnd.randrange(40)]}" for _ in range(20))
    codes = decontaminate.normal(text)[0]
    whole = sorted(decontaminate.regions(p, codes))
    for rows in (1, 7, 100, 5000):
        monkeypatch.setattr(decontaminate, "ROWS", rows)
        assert sorted(decontaminate.regions(p, codes)) == whole and len(whole) > 100


def test_gram_hashes():
    codes = np.array([ord(c) for c in "abcabcabdabc"], np.uint32)
    for q in (1, 2, 3, 5, 8, 10, 12):
        h = decontaminate.grams(codes, q)
        same = {}
        for i in range(len(codes) - q + 1):
            assert same.setdefault(bytes(codes[i:i + q]), h[i]) == h[i]
        assert len(set(h.tolist())) == len(same) and len(h) == len(codes) - q + 1


def test_excerpts_and_changed_words_at_every_offset():
    rnd = random.Random(4)
    say = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 8))) for _ in range(n))
    item = say(60)
    how = {k: v.default for k, v in inspect.signature(decontaminate.find_leaks).parameters.items()}
    p = decontaminate.patterns([(1, item)], how["q"], how["size"], how["rate"])
    parts = [f"{say(9)} {item[i:i + 75]} {say(9)}" for i in range(len(item) - 75)]
    w = item.split()
    parts += [" ".join(say(1) if k % 10 == i else x for k, x in enumerate(w)) for i in range(10)]
    assert all(decontaminate.leaks(p, parts))
    assert not any(decontaminate.leaks(p, [say(200) for _ in range(50)]))


def test_find_leaks(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(n))
    items = [(k, say(30)) for k in range(8)] + [(8, None), (None, "null item text that is long enough to count"), (9, "short"), (3, "")]
    rows = [*EDGES]
    for i in range(40):
        text = say(80)
        if i % 4 == 0:
            leak = items[i % 8][1]
            leak = leak.upper().replace(" ", ",\n ") if i % 8 == 4 else leak
            text = f"{text} {leak} {say(5)}"
        rows.append((100 + i, text))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, __leaks_ string, item_id int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    for block in (10**6, 300):
        got = {r.doc_id: r for r in decontaminate.contamination(df, bench, block_chars=block).collect() if r.doc_id}
        for i in range(40):
            assert got[100 + i].item_ids == ([i % 8] if i % 4 == 0 else [])
        span = got[104].spans.split(":")
        text = dict(rows)[104][int(span[1]):int(span[2])]
        assert edits(text.lower(), items[4][1].replace(" ", ",\n ")) <= 4
    kept = decontaminate.drop_leaked(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - 10
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


# --- site trees ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t &lt;b&gt;</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
<nav><ul><li><a href="/">Home</a><li>About</ul></nav><!-- c --><div class="ad">Buy</div><article><header><h1>Head &amp; more</h1><p>by me</p></header>
<p><b>One</b> two<br><p>Three &eacute;&nbsp;four &#x41;<ul><li>a<li>b</ul><div class="comments">nice!</div><form>name</form><table><tr><td>x<td>y</table></article>
<aside>side</aside><footer>foot"""


def test_main_text_of_one_page():
    assert site_tree.main_text(PAGE, set()) == "Head & more One two Three é four A a b x y"
    assert site_tree.main_text("", set()) == site_tree.main_text("<", set())[1:] == ""
    assert site_tree.main_text("just text &amp", set()) == "just text &"
    assert site_tree.main_text("<p>a <span title='x > y'>b</span> <a title=\"q>c</p>", set()).startswith("a b")
    assert site_tree.main_text("<div>" * 3000 + "x" + "<" * 3000, set()).startswith("x")


def node_id(path):
    out = site_tree.ROOT
    for name in path.split(">")[1:]:
        out = site_tree.child_id(out, name)
    return out


def plain_tree(pages):
    """(host, path): (m, own, composite, best) by the formulas, from whole paths; pages: (host, html)."""
    m, styles, texts, kids = Counter(), {}, {}, {}
    for host, html in set(pages):
        blocks, nodes = site_tree.parse(html)
        path = {nodes[0]: ""}
        for x in nodes[1:]:
            path[x] = f"{path[x.parent]}>{x.name}"
            kids.setdefault((host, path[x.parent]), set()).add(path[x])
        seen_styles, seen_texts = set(), set()
        for x in nodes:
            names = [c.name for c in x.children]
            if names:
                seen_styles.add((path[x], tuple(n for i, n in enumerate(names) if not i or names[i - 1] != n)))
        for x, t in blocks:
            seen_texts.add((path[x], t))
        for p in set(path.values()):
            m[host, p] += 1
        for p, a in seen_styles:
            styles.setdefault((host, p), Counter())[a] += 1
        for p, t in seen_texts:
            texts.setdefault((host, p), Counter())[t] += 1
    content = {k: 1.0 if m[k] == 1 else 1 - sum(np.log(c) / np.log(m[k]) for c in t.values()) / len(t) for k, t in texts.items()}
    out = {}
    for host, p in m:
        below = [c for (h, q), c in content.items() if h == host and f"{q}>".startswith(f"{p}>")]
        if below:
            k = (host, p)
            look = 1.0 if m[k] == 1 else 1 - (sum(c * np.log(c) for c in styles[k].values()) / m[k] / np.log(m[k]) if k in styles else 1)
            w = site_tree.DECAY ** len(kids.get(k, ()))
            out[host, node_id(p)] = (m[k], content.get(k, look), (1 - w) * look + w * sum(below) / len(below), max(below))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_importance_against_plain_python(spark, seed):
    rnd = random.Random(seed)

    def branch(depth):
        tag = rnd.choice(["div", "section", "div class=a", "div id=b", "article", "x-y"])
        inner = "".join(branch(depth - 1) for _ in range(rnd.randrange(3))) if depth else ""
        return f"<{tag}>{rnd.choice(['', 'one', 'two', f'word {rnd.randrange(9)}'])}{inner}</{tag.split()[0]}>"

    pages = [(rnd.choice(["a.example", "b.example"]), "".join(branch(rnd.choice([1, 4, 9])) for _ in range(rnd.randrange(4)))) for _ in range(80)]
    pages += [("deep.example", "<div>" * n + f"end {n}") for n in (1, 2, 30, 33, 64, 200)] + pages[:5]
    df = spark.createDataFrame([(i, f"https://{h}/{i}", html) for i, (h, html) in enumerate(pages)], "page_id long, url string, html string")
    got = {(r.host, r.node): r for r in site_tree.importance(site_tree.tree_facts(site_tree.distinct_pages(df))).collect()}
    want = plain_tree(pages)
    assert got.keys() == want.keys() and len(want) > 200
    for k, w in want.items():
        assert (got[k].m, got[k].own, got[k].composite, got[k].best) == pytest.approx(w, abs=1e-9), k


def test_deep_and_long_pages(spark):
    """100,000 elements in one another, in linear time and memory; a text of a million characters."""
    deep = "".join(f"<div class=ad{i % 3}>" if i % 2 else "<div>" for i in range(100_000)) + "core"
    long = "<p>" + "many words " * 100_000 + "</p>"
    rows = [(i, f"http://deep.example/{i}", html) for i, html in enumerate([deep, "<div>" * 20_000 + "a" + "</div>" * 20_000 + "b", long, "<x>" * 20_000 + "y" + "</z>" * 20_000])]
    blocks, nodes = site_tree.parse(deep)
    assert len(nodes) == 100_001 and blocks[0][0].depth == 100_000
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "core", 1: "a b", 2: ("many words " * 100_000).strip(), 3: "y"}


def test_importance(spark):
    pages = [(i, f"http://Site.example/p{i}", f"<body><div class=top>Welcome to the site</div><div class=body><p>Story {i} is unlike any other {i * 7}</p></div>"
              f"<div class=low>Box {i % 2}</div></body>") for i in range(40)]
    pages += [(100, None, None), (101, "not a url", "<p>alone</p>"), (102, "http://other.example/", "<div class=top>Welcome to the site</div>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    tree = {(r.host, r.node): r for r in site_tree.importance(site_tree.tree_facts(df)).collect()}
    assert tree["site.example", node_id(">body>div.top")].own == pytest.approx(0.0)
    assert tree["site.example", node_id(">body>div.body>p")].own > 0.95
    m, box = 41, [21, 20]
    assert tree["site.example", node_id(">body>div.low")].own == pytest.approx(1 - sum(np.log(b) / np.log(m) for b in box) / 2)
    got = Counter((r.page_id, r.text, r.n_chars) for r in site_tree.extract(df).collect())
    want = Counter((i, t, len(t)) for i, t in [
        *[(i, f"Story {i} is unlike any other {i * 7}") for i in range(40)], (100, ""), (101, "alone"), (102, "Welcome to the site"), (0, "Story 0 is unlike any other 0")])
    assert got == want
    assert site_tree.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    '<div style="overflow:hidden"><p>{}</p></div>', '<div aria-hidden="false"><p>{}</p></div>', '<body class="post no-sidebar"><article><p>{}</p></article>',
    '<div class="with-sidebar"><article class="post social"><p>{}</p></article><div class="sidebar">links</div></div>', '<body><div class="search-results"><p>{}</p></div>',
    '<form id="all"><div><p>{}</p><input name=x></div></form>', '<aside><article>teaser</article></aside><div class="text"><p>{}</p></div>',
    '<div class="text"><p>{}</p></div><article class="comment"><p>nice!</p></article>', '<article><p></p></article><div class="text">{}</div>'])
def test_names_and_articles_lose_no_text(page):
    story = "A long story about something that has happened, " * 4 + "the end"
    assert site_tree.main_text(page.format(story), set()) == story
    assert site_tree.main_text(f'<div title="x" hidden class="a"><p>gone</p></div>{page.format(story)}', set()) == story


def test_tree_judges_text_outside_the_article(spark):
    rows = [(i, f"http://out.example/{i}", f"<body><div class=top>Welcome {i % 2}</div><article><p>Story {i}</p></article><div class=more>Report {i * 7}</div></body>") for i in range(40)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} Report {i * 7}" for i in range(40)}


def test_copies_are_no_boilerplate(spark):
    page = lambda i: f"<body><div class=top>Welcome to the site</div><article><h2>Summary</h2><p>Story {i} is unlike any other</p></article></body>"
    rows = [(1, "http://two.example/a", page(1)), (2, "http://two.example/b", page(1)), (3, "http://pair.example/a", page(2)), (4, "http://pair.example/b", page(3))]
    rows += [(10 + i, f"http://mirror.example/?ref={i}", page(4)) for i in range(30)]
    rows += [(50 + i, f"http://many.example/{i}", page(100 + i)) for i in range(20)]
    rows += [(80 + i, f"http://many.example/copy{i}", page(100)) for i in range(20)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        story = re.search("Story [0-9]+ is unlike any other", html)[0]
        assert got[i].endswith(f"Summary {story}"), i


# --- Jaccard join --------------------------------------------------------------------------------

def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def plain_components(rows):
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_about_the_limit(spark, seed, monkeypatch):
    """One large group whose members are just close enough or just not, a passage in most texts, longer prefixes."""
    rnd = random.Random(seed)
    say = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    base, passage, rows = say(80), say(30), []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(30)}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(say(rnd.randrange(20, 60)) + passage + say(5))) for i in range(200)]
    rows += [(600 + i, rows[200 + i * 5][1] + " tail") for i in range(40)]
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "CLUSTER", 2 if seed == 1 else 32)
    every = jaccard.nodes_of(df, {})
    hot = jaccard.hot_tokens(every)
    longer = [r for r in jaccard.plans_of(df).collect() if r.shared > jaccard.least_shared(r.n)]
    assert hot and longer
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    want = plain_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) > 30 and max(Counter(c for _, c in want.values()).values()) > 100


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbBéÉ \t\n\x0b ", max_size=60))
def test_shingles(text):
    assert len(jaccard.shingles(text)) == len(plain_set(text))


def test_prefixes_share_enough():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        n = int(rnd.integers(1, 300))
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:n - int(n * rnd.random() * 0.16)], rnd.integers(0, 2**63, int(rnd.integers(0, 1 + n // 10))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not jaccard.similar(a, b):
            continue
        hot = {int(t): int(rnd.integers(2, 1000)) for t in np.concatenate([a, b]) if rnd.random() < 0.3}
        (sa, da, ta, xa), (sb, db, tb, xb) = jaccard.plan(a, hot), jaccard.plan(b, hot)
        assert len(set([*ta, *xa]) & set([*tb, *xb])) >= min(sa, sb)
        # whatever the exact counts of the other tokens are, a shared one stays after dropping
        df = {t: int(rnd.integers(2, 9)) for t in {*ta.tolist(), *tb.tolist()}}
        keep = [set(sorted(t.tolist(), key=lambda x: (-hot.get(x, 0), -df[x], x))[d:]) for t, d in ((ta, da), (tb, db))]
        assert keep[0] & keep[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rnd.choices(vocabulary, k=20))
    rows = [*EDGES]
    for i in range(60):
        rows.append((100 + i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 4, 9, 40, 90, 200])))))
    for i in range(140):  # chains and groups of near copies, some with a passage that many share
        w = rnd.choice(rows[7:])[1].split()
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        text = " ".join(w) if rnd.random() < 0.7 else " ".join(w).upper() + "\n" + line
        rows.append((1000 - i, text))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, token int")
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows)
    want = plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i, _ in rows if i is not None and want[i][1] == i)


def test_jaccard_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0 == jaccard.keep_one(none).count()
    alone = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(alone).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in jaccard.components(edges, "chain").collect()}
    assert got == {**dict.fromkeys(range(1, 201), 1), 500: 500, 501: 500}


# --- archives ------------------------------------------------------------------------------------

def test_arc_versions():
    date = "20010203040506"
    for version in (1, 2):
        block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\n<p>\nhttp://a 1.1.1.1 2 text/html 3\n</p>"
        data = arc.version_block(version, "f.arc", date) + arc.arc_record(version, "http://x/a b", date, block, "f") + b"\n" + arc.arc_record(version, "dns:x", date, b"1.2.3.4", "f")
        for content in (data, arc.member(data), b"".join(arc.member(data[i:i + 50]) + arc._EMPTY + b"\0" * 8 for i in range(0, len(data), 50))):
            got = list(arc.arc_records(content))
            assert [(f["url"], b) for _, f, b in got[1:]] == [("http://x/a%20b", block), ("dns:x", b"1.2.3.4")]
            assert all(f["date"] == date for _, f, _ in got) and got[0][1]["url"].startswith("filedesc:")
        with pytest.raises(ValueError):
            list(arc.arc_records(data[:-5]))
        with pytest.raises(ValueError):
            list(arc.arc_records(data + b"no header\n"))
    assert arc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and arc.warc_date("1999") == "1999-01-01T00:00:00Z"


def test_archive_round_trip(spark):
    big, other = "ü" * 600, "WARC/1.0\r\n\r\n" * 100
    rows = [(1, "http://a", big), (2, "http://b", big), (7, "http://c", big), (3, "http://a", other), (4, None, other), (5, "u v\n", None), (6, "", ""),
            (8, "http://s", "small"), (9, "http://s", "small"), (10, "x", "a" * 1000), (11, "x", "a" * 1000), (12, "x", "b" * 999), (13, "x", "b" * 999),
            (None, "n", big), (7, "again", big)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = arc.archive_round_trip(df.repartition(3)).collect()
    bytes_ = lambda h: (h or "").encode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len(bytes_(h)), hashlib.sha1(bytes_(h)).hexdigest()) for i, _, h in rows)
    groups = {}
    for r in got:
        groups.setdefault(r.payload_digest, []).append(r)
    for own in groups.values():
        first = [r for r in own if r.record_type == "response"]
        if own[0].payload_bytes < 1000:
            assert len(first) == len(own) and all(r.refers_to is None for r in own)
        else:
            top = max(r.page_id for r in own if r.page_id is not None)
            assert [r.page_id for r in first] == [top] and all(r.refers_to == top for r in own if r.record_type == "revisit")
    assert arc.archive_round_trip(df.limit(0)).count() == 0


def test_large_list_of_revisits_is_joined(spark, monkeypatch):
    monkeypatch.setattr(arc, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, "u", str(i % 3) * 2000) for i in range(30)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in arc.archive_round_trip(df).collect()}
    assert got == {i: ("response", None) if i >= 27 else ("revisit", 27 + i % 3) for i in range(30)}


def test_only_bands_with_enough_places_are_told_apart(monkeypatch):
    """Bands that lack the places are out before their grams are sorted."""
    rnd = np.random.default_rng(8)
    item = "".join(rnd.choice(list("abcdefgh "), 400))
    p = decontaminate.patterns([(1, item)], 6, 50, 1 / 8)
    noise = ["".join(rnd.choice(list("abcdefgh "), 5000)) + item[a:a + 9] for a in range(0, 380, 7)]
    codes = decontaminate.normal("\0".join([*noise, item, item[:60] * 3]))[0]
    gram = np.array([np.searchsorted(p.hashes, h) if h in set(p.hashes.tolist()) else -1 for h in decontaminate.grams(codes, p.q)], np.int32)
    pattern = np.repeat(np.arange(len(p.codes)), len(codes) // 16)
    low = np.tile(np.arange(len(codes) // 16) * 16, len(p.codes))
    sizes, unique = [], np.unique
    monkeypatch.setattr(decontaminate.np, "unique", lambda x, *a, **k: (sizes.append(len(x)), unique(x, *a, **k))[1])
    good = decontaminate._dense(p, gram, pattern, low, 32)
    monkeypatch.undo()
    assert good.any() and sum(sizes) <= p.sizes.max() * good.sum()
