"""Ranked search, filter audit and fingerprints: brute force in plain Python, and awkward tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recloom.llm import audit, fingerprint, lexical
from recloom.llm.queries import QUERIES
from tests.llm.test_operators import SMALL, awkward, none

# 11

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return PATTERN.findall((text or "").translate(LOWER))


def ranked_by_hand(docs, items, top=10):
    words = [(d, words_of(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in words:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words_of(text) if tf[t])
            if s > 0:
                scores.append((-s, -math.inf if d is None else d))
        out += [(item, i, None if d == -math.inf else d, -s) for i, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def test_terms_are_the_pattern_s():
    for t in ("A b\tC-d_e9 ÄÖ\x7fé x\x85y z 終わり\n", "", None, "\x00", "a" * 5000):
        assert [w.decode() for w in lexical.terms_of(t)] == words_of(t)


@pytest.mark.parametrize("seed", [0, 1])
def test_search_by_hand(spark, seed):
    """Many ties, copies, repeated rows and ids, very frequent words, small blocks and slices."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É"]
    text = lambda: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.choice((1, 3, 20, 300))))
    base = [text() for _ in range(80)]
    docs = [(i, rng.choice(base)) for i in range(400)] + [(7, base[0]), (7, base[0]), (None, base[1]), (None, None), (500, ""), (501, "w0 " * 5000)]
    items = [(i, text()) for i in range(30)] + [(None, base[2]), (3, base[3]), (99, "unheard of"), (98, None)]
    got = lexical.search(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), slice_bytes=20_000 * (1 + seed))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items)


def test_bounds_hold_and_exclude(spark, monkeypatch):
    """No bound is under a score, and most documents are excluded, though all words are equally rare."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(3000)], k=rng.randint(5, 400)))) for i in range(600)]
    frame = spark.createDataFrame(docs, "key long, text string").withColumnRenamed("key", "doc_id").coalesce(1)
    stored = lexical.index(frame).filter("bits is not null").toArrow().to_batches()
    corpus = lexical.Corpus(len(docs), sum(len(t.split()) for _, t in docs))
    query = {0: [(f"w{j}".encode(), 1 + corpus.weight(50)) for j in range(40)]}
    (pack,), over, seen = lexical.packs_of(query), 0, 0
    texts = dict(docs)
    for bits, keys, sizes in lexical.read_blocks(iter(stored)):
        for _, bound in lexical.bounds(bits, sizes, pack, corpus):
            for k, v, n in zip(keys.tolist(), bound.tolist(), sizes.tolist(), strict=True):
                tf = Counter(texts[k].encode().split())
                exact = sum(w * lexical.part_score(tf[t], corpus.length(n)) for t, w in query[0] if tf[t])
                assert n == len(texts[k].split()) and v >= exact
                over, seen = over + (v > exact), seen + 1
    assert seen == len(docs) and 0 < over < len(docs)
    scored, counted = lexical.scored, []
    monkeypatch.setattr(lexical, "scored", lambda d, p, q, c: counted.append(p.count()) or scored(d, p, q, c))
    items = spark.createDataFrame([(i, docs[i][1]) for i in range(20)], "item_id long, text string")
    assert lexical.search(spark, frame, items).count() == 200
    assert counted[0] == 200 and 200 <= counted[1] < 20 * len(docs) / 3


def test_search_awkward(spark):
    items = spark.createDataFrame([(1, "the words", 0, "x"), (2, None, 0, "x"), (3, "one w1x0 w1x0", 0, None)], "item_id long, text string, q long, terms string")
    docs = awkward(spark)
    got = lexical.search(spark, docs, items)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert lexical.search(spark, none(spark), items).count() == lexical.search(spark, docs, items.limit(0)).count() == 0


# 12

def audited_by_hand(docs, labels):
    """``docs``: (doc_id, text, source); filters are run one after the other on the rows themselves."""
    first, fails = {}, {f: set() for f in "ABCDE"}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    name = lambda d, t: ("t", t or "") if d is None else d
    for d, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if len(w) < 200:
            fails["A"].add(name(d, t))
        if 100 * len(set(w)) < 50 * len(w):
            fails["B"].add(name(d, t))
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails["C"].add(name(d, t))
        if re.search(r"[#$%&*|]", t):
            fails["D"].add(name(d, t))
        if t in first and d != first[t]:
            fails["E"].add(name(d, t))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {s or "" for *_, s in docs}:
        own = [name(d, t) for d, t, s in docs if (s or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for i, f in enumerate(order, 1):
                gone = [d for d in left if d in fails[f]]
                left = [d for d in left if d not in fails[f]]
                shapley[f] += len(gone)
                others = set().union(*(fails[g] for g in "ABCDE" if g != f))
                out[part, "".join(order), i] = (len(left), len(gone), sum(d in fails[f] for d in own) - len(gone), sum(d in fails[f] and d not in others for d in own), sum(d in good for d in gone), sum(d in toxic for d in gone), f)
        out = {k: (*v[:6], shapley[v[6]]) if k[0] == part else v for k, v in out.items()}
    return out


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_by_hand(spark):
    rng = random.Random(3)
    texts = [None, "", "a b", "A " * 300, "x # y", *(" ".join(rng.choices([f"v{i}" for i in range(400)] + ["#"] * (k % 3) + ["ABC"] * (k % 4 * 20), k=rng.choice((150, 250, 600)))) for k in range(40))]
    docs = [(i, rng.choice(texts), rng.choice(("s", "t", None, ""))) for i in range(300)] + [(None, "a b", "s"), (None, "only here", "t"), (None, "only here", "t")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = as_dict(audit.audit_documents(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == audited_by_hand(docs, labels)


def test_audit_awkward(spark):
    labels = spark.createDataFrame([(3, 1, None, "x")], "doc_id long, quality int, toxic int, part string")
    docs = awkward(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert as_dict(audit.audit_documents(spark, docs, labels)) == audited_by_hand(rows, [(3, 1, None)])
    assert as_dict(audit.audit_documents(spark, docs, labels.limit(0))) == audited_by_hand(rows, [])
    assert audit.audit_documents(spark, none(spark), labels).count() == 0


def test_audit_of_other_filters(spark):
    """The operator itself takes any id tables: two filters, two orders, other losses."""
    rows = spark.createDataFrame([("a", "p", True), ("b", "p", False), ("c", "p", True), ("d", "p", True)], "key string, part string, loss boolean")
    fails = {f: spark.createDataFrame([(k,) for k in ks], "key string") for f, ks in {"X": "ab", "Y": "bc"}.items()}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.loss_lost, r.shapley) for r in audit.audit(audit.Scratch(spark, "t"), rows, fails, ["loss"]).collect()}
    assert got == {("XY", 1): (2, 2, 0, 1, 1, 3), ("XY", 2): (1, 1, 1, 1, 1, 3), ("YX", 1): (2, 2, 0, 1, 1, 3), ("YX", 2): (1, 1, 1, 1, 1, 3)}


# 13

def sketch_by_hand(text, k, tuple_size, sketches):
    """The same orders, items and tuples, one k-mer at a time."""
    if not text:
        return [0] * sketches
    one = lambda x: int(fingerprint.mixed(np.array([x % (1 << 64)], np.uint64))[0])
    power, seen, rows = int(fingerprint._POWER), Counter(), []
    for i in range(max(1, len(text) - k + 1)):
        h = 0
        for c in text[i : i + k]:
            h = h * power + ord(c) + 1
        h = one(h)
        rows.append((i, h, one(h + seen[h] * power) >> 32))
        seen[h] += 1
    out = []
    for j, a in enumerate(fingerprint.multipliers(sketches).tolist()):
        low = sorted(sorted(rows, key=lambda r: (r[2] * a % (1 << 32), r[0]))[:tuple_size])
        x = j
        for _, h, _ in low:
            x = one(x * power + h)
        out.append(x >> 32 | 1)
    return out


def test_sketch_by_hand(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(fingerprint, "STRIP", 50)
    for n in (0, 1, 2, 4, 5, 6, 7, 60, 51, 54, 55, 333):
        for letters in ("ab", "abcdefghé😀 "):
            t = "".join(rng.choices(letters, k=n))
            for size in (1, 2, 3):
                assert fingerprint.sketch(t, 5, size, 16).tolist() == sketch_by_hand(t, 5, size, 16)


def test_sketch_tells_order_and_edits():
    rng = random.Random(2)
    words = [f"{rng.randrange(10**6)}" for _ in range(600)]
    text, s = " ".join(words), lambda t, size=2: fingerprint.sketch(t, tuple_size=size, sketches=400)
    near = lambda t, size=2: fingerprint.likeness(s(text, size), s(t, size))
    few = words[:]
    for i in range(0, 600, 100):
        few[i] = "changed"
    turned = " ".join(words[300:] + words[:300])
    assert near(text) == 1 and near(" ".join(few)) > 0.8 and near("something else " * 100) == 0
    assert near(turned, 1) > 0.95 and 0.4 < near(turned) < 0.65  # half of all pairs change their order
    assert near(" ".join(words[:300])) < 0.35
    assert not np.array_equal(s("ab" * 50), s("ab" * 60))  # occurrences are numbered


def fingerprints_by_hand(docs):
    rows = sorted(docs, key=lambda r: r[0], reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (fingerprint.sketch(x) for x in (t, new, following))
        out[d] = (d, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.as_text(a), fingerprint.as_text(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    return out


@pytest.mark.parametrize("range_bytes", [1 << 30, 2000])
def test_fingerprints_by_hand(spark, range_bytes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = fingerprint.fingerprints(spark, docs.repartition(3), range_bytes=range_bytes)
    assert {r.doc_id: tuple(r) for r in got.collect()} == fingerprints_by_hand([(r.doc_id, r.text or "") for r in docs.collect()])


def test_fingerprints_awkward(spark):
    docs = awkward(spark)
    got = fingerprint.fingerprints(spark, docs).collect()
    assert len(got) == docs.count() and sorted(r.n_chars for r in got) == sorted(len(r.text or "") for r in docs.collect())
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    assert of[5][0].fingerprint == of[6][0].fingerprint and set(of[0][0].fingerprint) == {"0"} and len(of[5]) == len(of[0]) == 2
    assert of[None][0].edited_sha256 == hashlib.sha256(("no id here at all"[:9] + "Ünïcode "[:8]).encode()).hexdigest()  # after the last comes the first
    assert fingerprint.fingerprints(spark, none(spark)).count() == 0
    (one,) = fingerprint.fingerprints(spark, docs.filter("doc_id = 4")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"two wtwo ").hexdigest() and one.near_next == 1
    same = spark.createDataFrame([(1, "all rows alike, as often as may be")] * 50, "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in fingerprint.fingerprints(spark, same).collect()] == [(1, 1.0)] * 50


def test_queries_have_their_columns(spark):
    want = {"op11_lexical": {"item_id", "rank", "doc_id", "score"}, "op12_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"}, "op13_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}}
    for name, columns in want.items():
        assert columns <= set(QUERIES[name](spark, SMALL).columns)
