"""Documents whose word 4-grams overlap by a Jaccard similarity of 85/100 or more, and their components.

Two sets that similar share at least l tokens among their prefixes of n - ceil(0.85 n) + l tokens, in any
one order of all tokens; here that of their hashes. Each document has a least l from its size, and takes a
longer prefix, with more shared tokens required before verification, when the estimated candidates of the
longer one cost less. As every pair must share l tokens, a document may leave its l - 1 most frequent prefix
tokens out of the search: of the tokens a pair shares, the rarest is left out by neither.

Equal sets are one node. Nodes that share search tokens are first held against what they share with all
others: one with too many tokens of its own can be similar to none. A first round then compares each node
only with its best neighbours, which joins large groups of near copies by a few comparisons each; the exact
round looks at all candidates between different components. Inside a cluster of nodes that have most tokens
in common, nodes are compared by what sets them apart from its core, so near copies that are just too
different to link do not all meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged

#: Fixed by the contract: words of a shingle, and similarity in hundredths.
WORDS = 4
NEED = 85
#: Largest least number of shared prefix tokens.
LEAST_MAX = 32
#: Verifying a candidate costs as much as reading so many postings.
VERIFY = 10.0
#: Share of documents from which a token counts as hot; that bounds how many hot tokens there are.
HOT = 0.002
#: Nodes from which a cluster gets a core; the pairs of a smaller one are few.
CLUSTER = 32
#: Ids up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
_BYTE: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        for p in (_P, _INVERSE):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, the same for both cases of A-Z, and which bytes are white space."""
    if not _BYTE:
        low = np.arange(256, dtype=np.uint64)
        low[65:91] += np.uint64(32)
        white = np.zeros(256, bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        _BYTE.extend([_mix(low * np.uint64(_P) + np.uint64(0x1234567)) | np.uint64(1), white])
    return _BYTE[0], _BYTE[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct word 4-grams; of all words when there are fewer; none without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    number, white = _bytes()
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~white[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(number[raw] * power[:len(raw)], out=sums[1:])
    word = _mix((sums[end] - sums[start]) * inverse[start])
    k = min(WORDS, len(word))
    n = len(word) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0xD1342543DE82EF95) + word[i:i + n])
    return np.unique(out)


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_shared(n: int) -> int:
    """Prefix tokens any similar partner must share at least; never falls as n grows."""
    return min(LEAST_MAX, -(-NEED * n // 100))


def plan(tokens: np.ndarray, hot: dict[int, int]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Required shared tokens, places left to drop, tokens to search by, hot tokens dropped already.

    tokens are sorted. The cost of a prefix is what its tokens' postings hold, and the candidates among
    them that reach the required count, each to be verified.
    """
    n = len(tokens)
    need = -(-NEED * n // 100)
    least = least_shared(n)
    rate = np.array([hot.get(int(t), 1) for t in tokens[:n - need + min(need, 4 * least)]], np.float64)
    total = np.cumsum(rate)
    choices = sorted({least, min(need, 2 * least), min(need, 4 * least)})
    cost = [total[n - need + c - 1] * (1 + VERIFY / c) for c in choices] if rate.max(initial=1) > 1 else [0.0]
    shared = choices[int(np.argmin(cost))]
    prefix, rate = tokens[:n - need + shared], rate[:n - need + shared]
    drop = least_shared(-(-NEED * n // 100)) - 1
    order = np.argsort(-rate, kind="stable")[:drop]
    gone = order[rate[order] > 1]
    stay = np.ones(len(prefix), bool)
    stay[gone] = False
    return shared, drop - len(gone), prefix[stay], prefix[gone]


def hot_tokens(every: DataFrame) -> dict[int, int]:
    """Documents whose least prefix holds it, for each token that at least a share HOT of all documents have there.

    All documents count. There are at most (mean least prefix) / HOT such tokens.
    """
    tokens = every.select(F.explode(F.concat("tokens", "dropped")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"] & _M: r["n"] for r in tokens.where(F.col("n") >= max(4, int(every.count() * HOT))).collect()}


def plans_of(docs: DataFrame) -> DataFrame:
    """nodes_of the documents; those with a hot token among the least prefix are planned by the counts of these."""
    every = staged(nodes_of(docs, {}), "jaccard-least")
    hot = hot_tokens(every)
    if not hot:
        return every
    some = [x - (1 << 64) if x >> 63 else x for x in hot]
    table = F.broadcast(docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, some))).alias("token")))  # hot tokens only
    again = staged(every.select("doc_id", F.explode(F.concat("tokens", "dropped")).alias("token")).join(table, "token").select(F.col("doc_id").alias("k")).distinct(), "jaccard-again")
    side = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    same = F.col("doc_id") == F.col("k")
    return every.join(side, same, "left_anti").union(staged(nodes_of(docs.join(side, same, "left_semi"), hot), "jaccard-nodes"))


def nodes_of(docs: DataFrame, hot: dict[int, int]) -> DataFrame:
    """doc_id, n, digest of the set, and the prefix plan of each document with an id."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["doc_id", "n", "digest", "shared", "budget", "tokens", "dropped"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                ask, budget, tokens, dropped = plan(s, shared.value)
                rows.append((len(s), digest_of(s), ask, budget, tokens.view(np.int64), dropped.view(np.int64)))
            n, digest, ask, budget, tokens, dropped = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(ask, pa.int32()), pa.array(budget, pa.int32()),
                pa.array(tokens, pa.list_(pa.int64())), pa.array(dropped, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(work, "doc_id long, n long, digest binary, shared int, budget int, tokens array<long>, dropped array<long>")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= NEED * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    x, y = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").where(both * (100 + NEED) >= (F.size("x") + F.size("y")) * NEED).select("a", "b")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, tokens (the whole set) of the nodes and digests in ids, which are broadcast when they are few."""
    ids = staged(ids, "jaccard-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = docs.join(ids, F.col("doc_id") == F.col("node")).select("node", "digest", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                right = pa.array([digest_of(x) == d for x, d in zip(sets, b.column("digest").to_pylist(), strict=True)], pa.bool_())
                tokens = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("node").filter(right), tokens.filter(right)], ["node", "tokens"])

    return some.mapInArrow(work, "node long, tokens array<long>").dropDuplicates(["node"])


def may_link(sets: DataFrame) -> DataFrame:
    """The sets that can be similar to another one here, with `most`, the largest size a partner can have.

    A token that no other set has is in no overlap. With e tokens that others have, the overlap is e at
    most, which bounds a partner's size from above; it must not be under the least size for a partner.
    Tokens are counted before the shuffle, and what a token that occurs once adds goes to its only node.
    They go by 32 bits of their hash: two that meet there count as shared, which only weakens the bound.
    """
    tokens = sets.select("node", F.explode("tokens").alias("token")).select("node", F.hash("token").alias("token"))
    alone = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("k")).where("c = 1").groupBy("k").agg(F.count(F.lit(1)).alias("alone"))
    n = F.size("tokens").cast("long")
    most = F.floor((n - F.coalesce("alone", F.lit(0))) * (100 + NEED) / NEED) - n
    out = sets.select("node", "tokens").join(alone, F.col("node") == F.col("k"), "left").select("node", "tokens", n.alias("n"), most.alias("most"))
    return out.where(F.col("most") * 100 >= F.col("n") * NEED)


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (least node reachable) for all nodes of edges (a, b): large and small stars in turn.

    Each turn is written to the shared folder; the number of turns grows with the logarithm of the nodes.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"))
        large = both.join(low, F.col("a") == F.col("x")).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = staged(large.where("a <> b").distinct(), name)
        low = large.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"))
        # Union of (neighbour, least) and (node, least), as edges from the larger to the smaller end.
        small = large.join(low, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("x").alias("a"), F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), name)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _search_rows(nodes: DataFrame) -> DataFrame:
    """token, node, n of the prefix tokens that other nodes have and that are not left out."""
    postings = nodes.select("node", "n", "budget", F.explode("tokens").alias("token"))
    df = F.count(F.lit(1)).over(Window.partitionBy("token"))
    common = postings.withColumn("df", df).where("df > 1")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("df").desc(), "token"))
    return common.withColumn("place", place).where("place > budget").select("token", "node", "n")


def _clusters(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """node, ref, n, core (size), delta, lost, score, need of the nodes close to the core of their cluster.

    A node's cluster is named by the node that comes first for most of its search tokens. Its core is the
    set of tokens that more than half of its nodes have; delta is what a node lacks of it (lost of them) or
    has beside it. Two nodes of a cluster have core - lost - lost' + (deltas in common) tokens in common, so
    what they need beyond core - lost - lost' must be deltas that both have: none when their scores add up
    to 0 or more. need is how many a node has in common with any similar one at least, that of the highest
    score; without any, the node is similar to that one.
    """
    ref = firsts.groupBy("node", "first").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max(F.struct("c", (-F.col("first")).alias("k"))).alias("x"))
    ref = staged(ref.select(F.col("node").alias("k"), (-F.col("x.k")).alias("ref")), "jaccard-refs")
    size = staged(ref.groupBy("ref").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= CLUSTER), "jaccard-sizes")
    of = sets.join(_few(ref.join(size, "ref", "left_semi")), F.col("node") == F.col("k")).select("ref", "node", "n", "tokens")
    # Tokens are counted before the shuffle; a core holds twice as many tokens as the mean node at most.
    tokens = of.select("ref", F.explode("tokens").alias("token")).groupBy("ref", "token").agg(F.count(F.lit(1)).alias("c"))
    core = tokens.join(size, "ref").where("c * 2 > m").groupBy("ref").agg(F.collect_list("token").alias("core"))
    near = of.join(staged(core, "jaccard-cores"), "ref")
    near = near.withColumns({"lacks": F.array_except("core", "tokens"), "more": F.array_except("tokens", "core")})
    near = near.where((F.size("lacks") + F.size("more")) * 2 <= F.col("n")).select(
        "ref", "node", "n", F.size("core").cast("long").alias("core"), F.concat("lacks", "more").alias("delta"), F.size("lacks").cast("long").alias("lost"))
    # Twice what is over: similar when (100 + NEED) * common >= NEED * (n + n').
    score = (100 + NEED) * (F.col("core") - 2 * F.col("lost")) - 2 * NEED * F.col("n")
    near = staged(near.withColumn("score", score), "jaccard-deltas")
    top = near.groupBy("ref").agg(F.max(F.struct("score", (-F.col("node")).alias("k"))).alias("x")).select(F.col("ref").alias("r"), F.col("x.score").alias("best"), (-F.col("x.k")).alias("top"))
    need = F.greatest(F.lit(0), F.ceil(-(F.col("score") + F.col("best")) / (2.0 * (100 + NEED)))).cast("int")
    return staged(near.join(top, F.col("ref") == F.col("r")).withColumn("need", need).drop("r", "best"), "jaccard-clusters")


def _in_clusters(near: DataFrame, component: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of one cluster and different components.

    Of two such nodes one at least has a need (else both are similar to the top); it is looked up by its
    deltas, of which it may leave out the need - 1 that most others have.
    """
    near = near.join(component, F.col("node") == F.col("k"), "left").withColumn("component", F.coalesce("component", "node")).drop("k")
    open_ = near.groupBy("ref").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("ref")
    near = staged(near.join(open_, "ref"), "jaccard-close")
    deltas = near.select("ref", "node", F.explode("delta").alias("token"))
    common = deltas.groupBy("ref", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = near.where("need > 0").select("ref", "node", "need", F.explode("delta").alias("token")).join(common, ["ref", "token"])
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "token"))).where("place >= need")
    search = own.groupBy("node").agg(F.collect_list("token").alias("search"))
    x = near.join(search, "node").select(
        "ref", F.explode("search").alias("token"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("lost").alias("la"), F.col("component").alias("ca"), F.col("delta").alias("da"), "search", "core")
    y = near.select(
        "ref", F.explode("delta").alias("token"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("lost").alias("lb"), F.col("component").alias("cb"), F.col("delta").alias("db"))
    alike = F.expr(f"ca <> cb AND (core - la - lb + size(array_intersect(da, db))) * {100 + NEED} >= (na + nb) * {NEED}")
    found = x.join(y, (x["ref"] == y["ref"]) & (x["token"] == y["token"]) & alike & (F.array_min(F.array_intersect("search", "db")) == x["token"]))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, node) and components (node, component) of the nodes with links."""
    docs = spread(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    every = plans_of(docs)
    # Equal sets are one node, named by its least id; empty ones stay alone.
    node = every.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"))
    members = staged(every.select("doc_id", "n", "digest").join(node.select("digest", "node"), "digest", "left").select("doc_id", "n", "node", "digest"), "jaccard-members")
    # Of rows with one id and different texts, that of the least digest is the node.
    heads = members.where("doc_id = node").groupBy("node").agg(F.min("digest").alias("digest"))
    nodes = staged(
        every.where("n > 0").join(heads, (every.doc_id == heads.node) & (every.digest == heads.digest))
        .select("node", "n", "shared", "budget", "tokens", "dropped").dropDuplicates(["node"]), "jaccard-plans")
    rows = staged(_search_rows(nodes), "jaccard-rows")
    # Of the documents that share search tokens, those that can reach the similarity with any other.
    sets = staged(sets_of(docs, rows.select("node").distinct().join(heads, "node")), "jaccard-sets")
    for _ in range(2):  # what the first turn takes out leaves more tokens alone
        sets = staged(may_link(sets), "jaccard-sets")
    alive = _few(sets.select(F.col("node").alias("k"), "most"))
    rows = staged(rows.join(alive, F.col("node") == F.col("k")).drop("k"), "jaccard-rows")
    plans = staged(nodes.join(alive, F.col("node") == F.col("k")).select("node", "n", "shared", F.concat("tokens", "dropped").alias("prefix")), "jaccard-plans")

    # Round one: the neighbour and the first of each token's nodes, those with the fewest tokens of their
    # own first. In a group of near copies that is the text nearest to all others, so most link to it.
    order = Window.partitionBy("token").orderBy((F.col("most") / F.col("n")).desc(), "node")
    near = rows.withColumns({"before": F.lag("node").over(order), "first": F.first("node").over(order)}).where("before IS NOT NULL")
    tries = near.select("node", F.explode(F.array_distinct(F.array("before", "first"))).alias("to")).groupBy("node", "to").agg(F.count(F.lit(1)).alias("c"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.col("c").desc(), "to"))
    pairs = staged(tries.where("node <> to").withColumn("r", best).where("r <= 2").select(F.col("to").alias("a"), F.col("node").alias("b")), "jaccard-tries")
    pairs = staged(_required(pairs, plans), "jaccard-first")
    near = _clusters(sets, rows.select("node", F.first("node").over(order).alias("first")))
    first = verify(pairs, sets).union(near.where("need = 0 AND node <> top").select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")))
    first = staged(first, "jaccard-links")
    joined = staged(components(first, "jaccard-stars"), "jaccard-components")

    # Exact round: all candidates between different components, those inside a cluster by their deltas.
    inside = staged(_in_clusters(near, joined.select(F.col("node").alias("k"), "component")), "jaccard-inside")
    rows = rows.join(near.select(F.col("node").alias("near"), "ref"), F.col("node") == F.col("near"), "left").drop("near")
    rows = rows.join(_few(joined.select(F.col("node").alias("k"), "component")), F.col("node") == F.col("k"), "left")
    rows = rows.withColumn("component", F.coalesce("component", "node")).drop("k")
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rows = staged(rows.join(mixed, "token"), "jaccard-open")
    # A pair meets at each token that both have; it comes out at the least of them only.
    own = rows.groupBy("node").agg(F.collect_list("token").alias("all"))
    rows = rows.join(own, "node")
    x = rows.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("component").alias("ca"), F.col("all").alias("ta"), F.col("ref").alias("ra"))
    y = rows.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("component").alias("cb"), F.col("all").alias("tb"), F.col("ref").alias("rb"))
    fits = f"a < b AND ca <> cb AND coalesce(ra <> rb, true) AND nb <= ma AND na <= mb AND least(na, nb) * 100 >= greatest(na, nb) * {NEED}"
    later = x.join(y, (x["token"] == y["token"]) & F.expr(fits) & (F.array_min(F.array_intersect("ta", "tb")) == x["token"]))
    later = staged(later.select("a", "b"), "jaccard-candidates")
    pairs = staged(_required(later, plans), "jaccard-second")
    if pairs.head(1) or inside.head(1):
        joined = components(first.union(inside).union(verify(pairs, sets)), "jaccard-stars")
    return members.drop("digest"), staged(joined, "jaccard-components")


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast when it is known to be small."""
    df = staged(df, "jaccard-side")
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _required(pairs: DataFrame, plans: DataFrame) -> DataFrame:
    """The pairs (a, b) that may reach the similarity by size and share enough prefix tokens."""
    x = plans.toDF("a", "na", "sa", "pa")
    y = plans.toDF("b", "nb", "sb", "pb")
    near = pairs.select("a", "b").join(y, "b").join(x, "a").where(f"least(na, nb) * 100 >= greatest(na, nb) * {NEED}")
    return near.where("size(array_intersect(pa, pb)) >= least(sa, sb)").select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Null and empty texts have no shingles and link with nothing. Rows with the same id are one document.
    Rows without an id are kept, not linked, with a null component. Sets are compared by 64-bit hashes
    of their shingles.
    """
    members, joined = link(docs)
    out = members.join(joined.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    lost = docs.where("doc_id IS NULL").select("text")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(shingles(t)) for t in b.column("text").to_pylist()]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], ["doc_id", "n_shingles", "component_id"])

    return out.union(lost.mapInArrow(sizes, "doc_id long, n_shingles long, component_id long"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that have a linked document with a smaller id; all columns stay.

    Of rows with the same id and an equal row, and of rows without an id, all stay.
    """
    parts = jaccard_components(docs).where("doc_id IS NOT NULL AND component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = staged(parts, "jaccard-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
