"""N-gram Jaccard join by token-combination prefixes.

A text's tokens are its distinct shingles of ``k`` words, as 64-bit hashes.  A text of n tokens can miss at most
tau = n - ceil(t n) of them in a partner of similarity t.  If all texts order tokens alike, rarest first, two partners thus
share one of the first tau + 1 tokens of either (the prefix).  Rare tokens of a prefix are indexed singly; where it reaches
into the frequent ones, it is extended so far that two partners must share two neighbours of it, and neighbours are indexed
as combinations: as many as there are tokens, whatever the text's length.

In steps:

1. ``sketch``: one pass cuts each text to its token count, a 128-bit key of the set and its window, the tokens of lowest
   hash (tau and ``SPARE`` percent of n; all up to ``WHOLE``).  Texts with equal keys are one node from here on.
2. Tokens that several nodes have name a few of these as hubs; nodes that share enough of their window with a hub are
   verified with it.  This joins large groups of near copies at a cost linear in their size.
3. Of the rest, only tokens count that lie in more than one component; all others come first in the order.  A node that has
   fewer of them than any partner in another component must share is done.  The few that remain are dense in shared tokens.
4. Dense nodes are looked at with all their tokens.  Once more each token names a hub, the node with the largest share of
   tokens in common with others, which is what near copies are copies of.  Then the counts are made anew, prefixes indexed
   as above, and nodes of different components that meet in the index are verified.  Their links and the hubs' links give components.

Links lost: none.  A pair that is not verified either cannot link or lies in one component already.  For step 3, let A and B
link, a >= b be their sizes, s(n) = floor(``SPARE`` n / 100) and the short window of n tokens be its lowest tau(n) + s(n).

* A text with 100 n <= percent ``WHOLE`` has partners of at most ``WHOLE`` tokens, kept whole: n - tau(n) tokens are shared.
* Any other may have a partner that keeps just its short window, so that only its own short window counts, be it kept
  whole or not.  The shared tokens of either short window are the lowest shared ones.  At most tau(a) of A are not in B, and
  tau(b) of B not in A, so B's window has at least s(b) shared ones, A's s(a) >= s(b): B counts s(b) or more.
  Of A's s(a), B's window must reach as many: with d of B not in A, b - d >= t (a + d), it has tau(b) + s(b) - d shared
  ones.  That less s(a) is linear in b; it is over (1 - t)(t - ``SPARE`` / 100) a at b = t a, where d = 0, and more at
  b = a, rounding (under 2) apart, which texts of over ``WHOLE`` tokens exceed up to t = 0.99.  A partner that is kept whole
  holds all of A's s(a).

For step 4, let v of a node's n tokens lie in its component alone, r of the others be rare, m frequent.  If the first token
that A and B share is rare, it is among the first tau + 1 of either and indexed singly.  Else all I shared tokens are frequent,
I <= m, and of the (1 - t) / t I or fewer tokens that only one of the two has v + r of A's are none of its frequent ones:
at most d = (1 - t) / t m - v - r unshared ones are left among the frequent ones of both (none: no link).  Between the first
d + 2 shared tokens there are d + 1 gaps, so one gap holds no unshared token of either: two tokens that are neighbours in
both.  A has these within d + 2 + min(d, tau - v - r) frequent tokens.  d + 2 tokens are shared, as I >= t / (1 - t) >= 3
times the unshared ones, of which there is one at least; under t = 0.75 all tokens are indexed singly.

Edge cases: null and empty texts have no token and link with nothing; a text shorter than ``k`` words has one token;
rows with a null id get a null component; repeated rows are one node; an id is taken to be of one text (of several, the sets of
one node are looked at together); an empty table gives an empty one; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm.components import components
from recloom.llm.store import Scratch

#: Nodes that have it, from which on a token is a frequent one.
FREQUENT = 32
WHOLE = 256
#: Nodes of one combination that a task pairs with all the others.
BLOCK = 4096
#: Combinations looked back at, so that a pair is not made anew by each of a run of shared ones.
REPEATS = 4
#: Percent of a longer text's tokens that its window holds beyond tau.
SPARE = 7
#: Ids that are broadcast at most (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(29)


def tokens(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes.  ``bytes.lower`` and ``bytes.split`` know just A-Z and ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), 1)], np.uint64).view(np.int64)
    m = len(w) - k + 1
    h = w[:m].copy()
    for i in range(1, k):
        h ^= h >> _S
        h *= _M
        h += w[i : i + m]
    h ^= h >> _S
    h *= _M
    h ^= h >> np.uint64(32)
    h = h.view(np.int64)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def window_size(n: int, percent: int) -> int:
    return n if n <= WHOLE else n + (percent * -n // 100) + SPARE * n // 100


def sketch(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id``, ``n``, ``key`` (null for an empty set) and ``tokens``, the window in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [tokens(t, k) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([s[: window_size(len(s), percent)] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "key", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, tokens array<long>")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([tokens(t, k) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))], names=["node", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, tokens array<long>")


def only_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in ``ids`` (``id``): by broadcast if they are few, else by a shuffled semi join."""
    ids = ids.withColumnRenamed("id", column)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def verify(scratch: Scratch, sets: DataFrame, pairs: DataFrame, label: str, percent: int) -> DataFrame:
    """Of ``pairs`` (``a``, ``b``) those whose token sets (``node``, ``tokens``) link."""
    rows = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")

    def lists(column: pa.Array) -> tuple[np.ndarray, list[int]]:
        return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, oa), (vb, ob), keep = lists(batch.column("ta")), lists(batch.column("tb")), []
            for i in range(batch.num_rows):
                both = np.concatenate((va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same > 0 and 100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return scratch.save(rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), f"{label}-links")


def mixed(tokens: DataFrame) -> DataFrame:
    """``h`` and ``df`` (nodes that have it) of the tokens that lie in more than one component."""
    return tokens.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df")).filter("lo != hi").select("h", "df")


def combinations(nodes: DataFrame, percent: int, frequent: int) -> DataFrame:
    """``node``, ``n``, ``comp``, ``u`` (shared tokens) and ``t`` (these as ``df``, ``h``, rarest first) to an index row per
    combination: ``h`` and ``before``, the ``REPEATS`` combinations in front of it.  See the module's proof for the lengths."""
    at_most = lambda x: F.greatest(F.lit(0), x).cast("int")
    n, u, r, p = (F.col(c) for c in "nurp")
    tau = n + F.floor(F.lit(-percent) * n / 100)
    x = nodes.withColumn("p", tau + 1 - (n - u)).filter("p >= 1").withColumn("r", F.size(F.filter("t", lambda t: t["df"] <= frequent)))
    own = F.transform("t", lambda t: t["h"])
    single = F.slice(own, F.lit(1), at_most(F.least(p, r)))
    spare = F.floor(F.lit(100 - percent) * (u - r) / percent) - (n - u) - r
    run = F.slice(own, r + 1, F.when((r < p) & (spare >= 0), at_most(spare + 2 + F.least(spare, p - 1 - r))).otherwise(0))
    pairs = F.zip_with(F.slice(run, F.lit(1), at_most(F.size(run) - 1)), F.slice(run, F.lit(2), at_most(F.size(run) - 1)), lambda a, b: F.xxhash64(a, b))
    x = x.select("node", "n", "u", "comp", F.concat(single, pairs).alias("all"))
    back = lambda i: F.greatest(i - REPEATS, F.lit(0))
    rows = F.transform("all", lambda h, i: F.struct(h.alias("h"), F.slice("all", back(i) + 1, i - back(i)).alias("before")))
    return x.select("node", "n", "u", "comp", F.explode(rows).alias("x")).select("node", "n", "u", "comp", "x.h", "x.before")


def crossing(index: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of nodes in different components that share a combination and could be similar enough if all their
    tokens that lie in several components (``u`` of ``n``) were the same.  A combination of more than ``BLOCK`` nodes is cut:
    each part of its nodes meets all of them in a task of its own.  Both sides are shuffled and sorted, which spills."""
    sizes = index.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo != hi")
    index = index.join(sizes.select("h", F.ceil(F.col("c") / BLOCK).alias("parts")).hint("merge"), "h")
    x = index.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("x")
    y = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("y")
    most = F.least("x.u", "y.u")
    near = 100 * most >= F.lit(percent) * (F.col("x.n") + F.col("y.n") - most)
    # of combinations that two nodes share one after the other, only the first makes the pair
    again = F.arrays_overlap("x.before", "y.before")
    on = (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & near & ~again
    return x.join(y.hint("merge"), on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def join_components(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 85, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``: the smallest id that links of similarity ``percent`` / 100 or more
    over ``k``-word shingles reach."""
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    raw = scratch.save(sketch(docs, k, percent), "sketch")
    sig = scratch.save(raw.select("doc_id", "n", "key"), "keys")
    nodes = scratch.save(sig.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node")), "nodes")
    own = raw.join(nodes, (raw["key"] == nodes["key"]) & (raw["doc_id"] == nodes["node"])).select("node", "n", "tokens")
    n = F.col("n")
    tau = n + F.floor(F.lit(-percent) * n / 100)
    # a text that may have a partner over WHOLE counts with the window that it would have there, however much of it is kept
    width = F.when(100 * n <= percent * WHOLE, n).otherwise(tau + F.floor(n * SPARE / 100))
    own = scratch.save(own, "windows")
    scratch.drop("sketch")
    sizes = scratch.save(own.select("node", "n"), "sizes")
    tok = own.select("node", width.alias("width"), F.posexplode("tokens").alias("at", "h")).select("node", "h", (F.col("at") < F.col("width")).alias("low"))

    spread = F.xxhash64("node")
    hubs = tok.groupBy("h").agg(F.min("node").alias("p"), F.max("node").alias("q"), F.min_by("node", spread).alias("u"), F.max_by("node", spread).alias("v")).filter("p != q")
    shared = scratch.save(tok.join(hubs, "h"), "shared")
    scratch.drop("windows")
    to_hub = shared.filter("low").select("node", F.explode(F.array_distinct(F.array("p", "q", "u", "v"))).alias("hub")).filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("c"))
    to_hub = to_hub.join(sizes.select("node", "n"), "node").filter(F.col("c") >= 0.3 * width)
    pairs = scratch.save(to_hub.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "hub-pairs")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    links = verify(scratch, scratch.save(whole_sets(only_ids(docs, "doc_id", ends), k), "hub-sets"), pairs, "hub", percent)
    scratch.drop("hub-sets", "hub-pairs")
    comp = scratch.save(components(scratch, links, "first"), "first")

    known = comp.withColumnRenamed("component", "comp")
    own_comp = F.coalesce("comp", "node").alias("comp")
    live = scratch.save(shared.select("h", "node", "low").join(known, "node", "left").select("h", "node", "low", own_comp), "live")
    scratch.drop("shared")
    dense = live.filter("low").join(mixed(live), "h").groupBy("node").agg(F.count("*").alias("m"), F.first("comp").alias("comp")).join(sizes.select("node", "n"), "node")
    dense = scratch.save(dense.filter(F.col("m") >= width - tau).select("node", "n", "comp"), "dense")
    sets = scratch.save(whole_sets(only_ids(docs, "doc_id", dense.select(F.col("node").alias("id"))), k), "dense-sets")
    scratch.drop("live")

    def shared_by(facts: DataFrame) -> DataFrame:
        every = sets.select("node", F.explode("tokens").alias("h")).join(facts, "node").select("h", "node", "n", "comp")
        return every.join(mixed(every), "h")

    # once more with the node as hub that has most of its tokens in common with others: what near copies are copies of
    every = scratch.save(shared_by(dense), "dense-tokens")
    share = every.groupBy("node").agg((F.count("*") / F.first("n") + F.pmod(F.xxhash64("node"), F.lit(1_000_003)) * 1e-12).alias("share"))
    hubs = every.join(share, "node").groupBy("h").agg(F.max_by("node", "share").alias("hub"))
    to_hub = every.join(hubs, "h").filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("c"), F.first("n").alias("n")).filter("c >= 0.3 * n")
    pairs = scratch.save(to_hub.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "best-pairs")
    links = links.unionByName(verify(scratch, sets, pairs, "best", percent))
    comp = scratch.save(components(scratch, links, "second"), "second")
    dense = scratch.save(dense.drop("comp").join(comp.withColumnRenamed("component", "comp"), "node", "left").select("node", "n", own_comp), "dense-again")
    scratch.drop("dense-tokens", "best-pairs", "first")

    every = shared_by(dense)
    per = every.groupBy("node", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t")).withColumn("u", F.size("t"))
    index = scratch.save(combinations(per, percent, frequent if percent >= 75 else 1 << 62), "index")
    found = scratch.save(crossing(index, percent), "rest-pairs")
    more = verify(scratch, sets, found, "rest", percent)
    comp = scratch.save(components(scratch, links.unionByName(more), "last"), "last")
    scratch.drop("sizes", "dense", "dense-again", "dense-sets", "index", "rest-pairs", "second")
    label = nodes.join(comp, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    out = sig.select("doc_id", "n", "key").join(label, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
