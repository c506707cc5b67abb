"""Main text of web pages by a site style tree.

The block elements of all pages of a host are merged into one tree, by tag and class from the root down.
A node is known by a 64-bit hash of its parent's and its own name, so a page may be of any depth.
A node's presentation importance is the entropy of the child sequences that pages show there; a node that
holds text has a content importance: one less the mean entropy of its texts over the pages. What says the
same on many pages of a host is of low importance. Branches of low importance are cut from each page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged

#: Weight of a node's own presentation falls with its number of children.
DECAY = 0.9
#: Branches under this importance go.
THRESHOLD = 0.3
#: Distinct pages that must have a node before its entropy tells anything.
SUPPORT = 5
#: Weight of the importance of text outside the article, on a page that marks one.
OUTSIDE = 0.5
#: Share of a page's text from which a branch is not taken for what its class or id says.
MOST = 0.5
#: Bytes of the host table up to which it is broadcast; beyond, pages are shuffled by host.
BROADCAST_BYTES = 32 << 20

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""
    a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span
    strike strong sub sup time tt u var wbr img""".split())
BREAKS = frozenset("br hr".split())
NOISE_TAGS = frozenset("""
    nav header footer aside script style noscript template svg button select textarea iframe dialog menu title
    head object canvas audio video fieldset option datalist""".split())
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|sidebar|side|footer|header|masthead|ads?|advert(?:s|isement|ising)?|banner|cookies?|"
    r"consent|notices?|promo(?:tion)?|sponsor(?:ed|s)?|comments?|discussion|replies|breadcrumbs?|share|sharing|social|related|newsletter|"
    r"subscribe|popup|modal|overlay|widget|pagination|pager|login|search|toolbar|disclaimer)(?:$|[\s_-])", re.I)
#: The page's own frame and its text, whatever the class.
FRAME = frozenset("html body main article".split())
#: An article of this class is a reader's or an advertiser's; only whole class names count.
_REMARK = re.compile(r"(?:^|\s)(?:comments?|reply|replies|ads?|advert|sponsored|promo)(?:[_-](?:body|content|item))?(?:$|\s)", re.I)
#: An opening tag ends these when they are open.
CLOSES = {
    **dict.fromkeys("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup
        hr main menu nav ol p pre section table ul""".split(), ("p",)),
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
    "option": ("option",), "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "body": ("head",),
}
#: Implied ends do not reach beyond these.
SCOPES = frozenset("html body article main section div table ul ol dl td th blockquote aside nav header footer form".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_CLOSE = {t: re.compile(f"</{t}(?=[\\s/>]|$)", re.I) for t in RAW}


class Node:
    """A block element. own: its class or id (or form tag) says that it is no content."""

    __slots__ = ("article", "children", "depth", "head", "id", "name", "noise", "own", "parent", "tag")

    def __init__(self, parent: Node | None, tag: str, name: str, noise: bool = False, article: bool = False, own: bool = False):
        self.parent, self.tag, self.name, self.noise, self.article, self.own, self.children = parent, tag, name, noise, article, own, []
        self.id = child_id(parent.id, name) if parent else ROOT
        self.depth = parent.depth + 1 if parent else 0
        self.head = tag == "header" or bool(parent and parent.head)


#: Id of the page itself.
ROOT = 0


def child_id(parent: int, name: str) -> int:
    """Id of the nodes of this name below the nodes of an id: signed, 64 bits."""
    x = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def _tag_end(page: str, at: int, none: set[str]) -> int:
    """Place of the '>' that ends the tag at at; quotes hide one. -1 without. none: quotes that do not come again."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        quotes = [(page.find(q, at, end), q) for q in "\"'"]
        quotes = [(i, q) for i, q in quotes if i >= 0 and q not in none]
        if not quotes:
            return end
        i, q = min(quotes)
        if page[at:i].rstrip()[-1:] != "=":  # a stray quote
            at = i + 1
            continue
        close = page.find(q, i + 1)
        if close < 0:
            none.add(q)
            return end
        at = close + 1


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(node, text) blocks in page order, and all nodes.

    Any text is parsed: unknown and unclosed tags, stray signs and cut-off pages included. Character
    references are decoded, white space inside a block is one space. Nodes come before those in them.
    """
    root = Node(None, "", "")
    stack, nodes, blocks, words = [root], [root], [], []
    still = Counter()  # open elements by tag
    at, n, none = 0, len(page), set()

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                blocks.append((stack[-1], text))
            words.clear()

    def say(a: int, b: int) -> None:
        if b > a:
            words.append(entities.unescape(page[a:b]) if page.find("&", a, b) >= 0 else page[a:b])

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(at, n)
            break
        say(at, lt)
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:  # a bogus end tag is a comment
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                words.append("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        end = _tag_end(page, m.end(), none)
        if end < 0:
            break  # a cut-off tag
        at = end + 1
        if closing:
            if still[tag] > 0:
                flush()
                last = ""
                while last != tag:
                    last = stack.pop().tag
                    still[last] -= 1
            continue
        if tag in RAW:
            if page[end - 1] != "/" or tag in ("script", "style", "title", "textarea"):
                m = _CLOSE[tag].search(page, at)
                at = n if not m else page.find(">", m.end()) + 1 or n
            continue
        if tag in BREAKS:
            flush()
            continue
        if tag in VOID or tag in INLINE:
            continue
        flush()
        ends = CLOSES.get(tag, ())
        k = len(stack) - 1
        while k > 0 and any(still[t] > 0 for t in ends):
            if stack[k].tag in ends:
                still.subtract(x.tag for x in stack[k:])
                del stack[k:]
            elif stack[k].tag in SCOPES:
                break
            k -= 1
        top = stack[-1]
        names, hidden = "", False
        if m.end() < end:
            for a in _ATTRIBUTE.finditer(page, m.end(), end):
                key = a[1].lower()
                if key == "hidden":
                    hidden = True
                elif key in ("class", "id", "role"):
                    names += " " + (a[2] or a[3] or a[4] or "")
        names = " ".join(names.split())
        remark = tag == "article" and bool(_REMARK.search(names))
        article = top.article or (tag in ("article", "main") and not remark)
        noise = top.noise or hidden or tag in NOISE_TAGS
        named = remark or tag == "form" or (tag not in FRAME and bool(names and NOISE_NAMES.search(names)))
        if tag == "header" and top.article and not top.noise:
            noise = named = False  # the article's own head: its headings count, see importance
        name = f"{tag}.{re.sub(r'[0-9]+', '0', names.lower()).replace('>', '')}" if names else tag
        node = Node(top, tag, name, noise, article, named)
        top.children.append(node)
        stack.append(node)
        still[tag] += 1
        nodes.append(node)
    flush()
    return blocks, nodes


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty when there is none or the URL is broken."""
    return F.coalesce(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), F.lit(""))


def _h(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


PRESENT, STYLE, CONTENT = range(3)
FACT = ["host", "node", "parent", "depth", "kind", "feature"]


def distinct_pages(pages: DataFrame) -> DataFrame:
    """url, html: one page for each host and html; copies are no evidence of what recurs."""
    rows = pages.select("url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("__h", host_of(F.col("url"))).withColumn("__d", F.md5("html"))
    return rows.dropDuplicates(["__h", "__d"]).select("url", "html")


def tree_facts(pages: DataFrame) -> DataFrame:
    """host, node, parent, depth, kind, feature: once for each page and node of its tree; counted before the shuffle.

    PRESENT: the page has the node. STYLE: its children's names in order, runs as one. CONTENT: a text.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple, int] = {}
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                blocks, nodes = parse(page or "")
                at = {x.id: (x.id, x.parent.id if x.parent else None, x.depth) for x in nodes}
                seen = {(n, PRESENT, 0) for n in at}
                for x in nodes:
                    if x.children:
                        names = [c.name for c in x.children]
                        seen.add((x.id, STYLE, _h(" ".join(a for a, b in zip(names, ["", *names], strict=False) if a != b))))
                seen |= {(x.id, CONTENT, _h(text)) for x, text in blocks}
                for node, kind, feature in seen:
                    key = (host, *at[node], kind, feature)
                    out[key] = out.get(key, 0) + 1
            if out:
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(list(out.values()), pa.int64())], [*FACT, "n"])

    facts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(work, "host string, node long, parent long, depth int, kind int, feature long, n long")
    return facts.groupBy(*FACT).agg(F.sum("n").alias("n"))


def _below(nodes: DataFrame) -> DataFrame:
    """host, node, s, c, best: sum, number and greatest of the contents in each branch, the node's own among them.

    Each round hands what a node has gathered to the node as far above as the round reaches, and doubles
    that reach: as many rounds as the greatest depth has binary digits, each with one row for a node.
    """
    deep = nodes.agg(F.max("depth")).first()[0] or 0
    now = nodes.select("host", "node", F.col("parent").alias("up"), F.coalesce("content", F.lit(0.0)).alias("s"),
                       F.when(F.col("content").isNull(), 0).otherwise(1).cast("long").alias("c"), F.col("content").alias("best"))
    for k in range(deep.bit_length()):
        given = now.where("up IS NOT NULL AND c > 0").groupBy("host", F.col("up").alias("node")).agg(
            F.sum("s").alias("s2"), F.sum("c").alias("c2"), F.max("best").alias("best2"))
        above = now.select("host", F.col("node").alias("up"), F.col("up").alias("next"))
        now = now.join(given, ["host", "node"], "left").join(above, ["host", "up"], "left").select(
            "host", "node", F.col("next").alias("up"), (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s"),
            (F.col("c") + F.coalesce("c2", F.lit(0))).alias("c"), F.greatest("best", "best2").alias("best"))
        now = staged(now, f"site-below-{k}")
    return now


def importance(facts: DataFrame) -> DataFrame:
    """host, node, m, own (content or presentation importance), composite: one row for each node with text below.

    With m pages at a node: presentation importance is the entropy of its styles to the base m, content
    importance one less the mean over its texts of log_m of the pages with the text; a node of one page has
    1. The composite of a node with l children is (1 - DECAY^l) times its presentation importance plus
    DECAY^l times the mean content importance below it. The facts are read once.
    """
    kind = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    n = F.col("n")
    nodes = facts.groupBy("host", "node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"),
        kind(PRESENT, n).alias("m"), kind(STYLE, n * F.log(n)).alias("style"), kind(CONTENT, F.log(n)).alias("text"),
        F.sum(F.when(F.col("kind") == CONTENT, 1)).alias("texts"))
    alone = F.col("m") <= 1
    style = F.when(alone, F.lit(1.0)).otherwise(1 - F.coalesce(F.col("style") / F.col("m"), F.log("m")) / F.log("m"))
    content = F.when(F.col("texts").isNull(), F.lit(None)).when(alone, F.lit(1.0)).otherwise(1 - F.col("text") / F.col("texts") / F.log("m"))
    nodes = staged(nodes.select("host", "node", "parent", "depth", "m", style.alias("presentation"), content.alias("content")), "site-nodes")
    below = _below(nodes).where("c > 0").select("host", "node", (F.col("s") / F.col("c")).alias("mean"), "best")
    children = nodes.where("parent IS NOT NULL").groupBy("host", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("l"))
    all_ = nodes.join(below, ["host", "node"]).join(children, ["host", "node"], "left")
    weight = F.pow(F.lit(DECAY), F.coalesce("l", F.lit(0)))
    composite = (1 - weight) * F.col("presentation") + weight * F.col("mean")
    return all_.select("host", "node", "m", F.coalesce("content", "presentation").alias("own"), composite.alias("composite"), "best")


def cut_branches(tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, cut, weak: the branches in which neither the node nor any text below is important; one row a host.

    weak: those that are not important enough with the weight of text outside the article, or of a branch
    whose name speaks against it. A node on fewer than SUPPORT pages is not judged.
    """
    under = lambda x: (F.col("composite") < x) & (F.col("best") < x)
    low = tree.where((F.col("m") >= SUPPORT) & (F.col("node") != ROOT) & under(threshold / OUTSIDE))
    return low.groupBy(F.col("host").alias("__host")).agg(
        F.collect_set(F.when(under(threshold), F.col("node"))).alias("__cut"), F.collect_set("node").alias("__weak"))


def _head_matter(node: Node) -> bool:
    """In the article's own header, but no heading."""
    return node.head and not re.fullmatch("h[1-6]|hgroup", node.tag)


def _no_content(blocks: list[tuple[Node, str]], nodes: list[Node], weak: set[int]) -> set[Node]:
    """The nodes in branches that are what their names say.

    A name is a weight. A branch with most of the page's text is content whatever its name, unless an
    article stands outside all such branches and none in it, or the tree finds it unimportant.
    """
    named = {}  # below a branch with such a name
    for x in nodes:
        named[x] = x.own or (x.parent is not None and named[x.parent])
    size, story, total, apart = Counter(), set(), 0, False
    for node, text in blocks:
        if not node.noise:
            total += len(text)
            apart |= node.article and not named[node]
            size[node] += len(text)
            if node.article:
                story.add(node)
    for x in reversed(nodes[1:]):
        size[x.parent] += size[x]
        if x in story:
            story.add(x.parent)
    none = set()
    for x in nodes:
        holds = x in story and not x.article
        if x.parent in none or (x.own and (size[x] < MOST * total or (apart and not holds) or x.id in weak)):
            none.add(x)
    return none


def main_text(page: str, cut: set[int], weak: set[int] = frozenset()) -> str:
    """The blocks that stay, in page order, joined by one space.

    Blocks in cut branches go, but for an article's headings over text that stays. Elements whose tag says
    that they are no content go, and those whose class says so unless they hold most of the text. On a page
    with text in an article, blocks outside it go when they are in weak branches.
    """
    blocks, nodes = parse(page)
    none = _no_content(blocks, nodes, weak)
    blocks = [(x, t) for x, t in blocks if not (x.noise or x in none or _head_matter(x))]
    marked = any(x.article for x, _ in blocks)
    in_cut, in_weak = {nodes[0]: ROOT}, {nodes[0]: ROOT}  # the nearest branch to cut; ROOT: none
    for x in nodes[1:]:
        in_cut[x] = x.id if x.id in cut else in_cut[x.parent]
        in_weak[x] = x.id if x.id in weak else in_weak[x.parent]
    out, heads = [], []
    for node, text in blocks:
        at = (in_weak if marked and not node.article else in_cut)[node]
        if at != ROOT and node.article and at == node.id and re.fullmatch("h[1-6]", node.tag):
            heads.append((node.parent, text))
        elif at == ROOT:
            if heads:  # a heading with the same wording everywhere stays with what it heads
                y, least, around = node, min(h.depth for h, _ in heads), set()
                while y is not None and y.depth >= least:
                    around.add(y.id)
                    y = y.parent
                out += [t for above, t in heads if above.id in around]
            out.append(text)
            heads = []
        else:
            heads = []
    return " ".join(out)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; pages without a host form one tree. Whole pages of any depth
    are read, nothing is capped. Equal pages give equal texts and count once in the tree. Each page is parsed
    twice, for the tree and for its text; distinct ones are shuffled once for the tree, all of them once more
    when the table of hosts is large.
    """
    pages = spread(pages.select("page_id", "url", "html"))
    facts = staged(tree_facts(distinct_pages(pages)), "site-facts")
    cuts = staged(cut_branches(importance(facts), threshold), "site-branches")
    size = cuts.agg(F.sum(64 + F.octet_length("__host") + 8 * (F.size("__cut") + F.size("__weak")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    rows = pages.withColumn("__h", host_of(F.col("url"))).join(cuts, F.col("__h") == F.col("__host"), "left").select("page_id", "url", "html", "__cut", "__weak")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(p or "", set(c or ()), set(w or ())) for p, c, w in zip(*[b.column(x).to_pylist() for x in ("html", "__cut", "__weak")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

