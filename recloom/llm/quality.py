"""Quality classifier: a generalised additive model with pairwise interactions.

Each of a text's measures is cut into bins by quantiles of the training rows.  Boosting goes round the measures in turn
and fits, at a small rate, a tree of at most four leaves on one measure's bins at a time, so that the sum of all trees of
a measure is a lookup table; the strongest pairs of measures, ranked by what four quadrants explain of the residual, then
get tables of two bins.  A score is the logistic function of table entries added up for a whole batch of rows.

Training takes the ``max_rows`` labelled rows that come first by a hash of their id (all, if fewer): a bounded sample, so
that it fits one process.  Measures, and scores, are computed for every row over its whole text.

Edge cases: null and empty texts have measures of 0 and get a score; without rows of both classes, every score is the
share of class 1 (0.5 without any row); ids that repeat are scored each; extra columns are left out of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recloom.llm.draws import lowest

MEASURES = ("log_bytes", "pipe", "symbol", "upper", "digit", "non_ascii", "repeat_next", "distinct_words", "distinct_lines", "word_length", "stop", "line_words")
MAX_ROWS = 20_000

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 pipe, 2 symbol, 3 upper, 4 digit, 5 beyond ASCII, 6 full stop
_CLASS[ord("|")] = 1
_CLASS[[ord(c) for c in "*%$#&@^~<>{}[]\\=+_"]] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
_CLASS[ord(".")] = 6


def measures(texts: list[str | None]) -> np.ndarray:
    """rows x measures; shares are per byte, per word or per line."""
    out = np.zeros((len(texts), len(MEASURES)))
    for i, t in enumerate(texts):
        if not t:
            continue
        raw = np.frombuffer(t.encode(), np.uint8)
        count = np.bincount(_CLASS[raw], minlength=7) if raw.size < 64 else np.add.reduceat(np.bincount(raw, minlength=256)[_ORDER], _STARTS)
        words, lines = t.split(), t.split("\n")
        n, m = max(1, len(words)), max(1, len(lines))
        share = count / raw.size
        out[i] = (np.log1p(raw.size), count[1] / n, count[2] / n, share[3], share[4], share[5], sum(map(eq, words, words[1:])) / n, len(set(words)) / n**0.9, len(set(lines)) / m, raw.size / n, count[6] / n, n / m)
    return out


_ORDER = np.argsort(_CLASS, kind="stable")
_STARTS = np.searchsorted(_CLASS[_ORDER], np.arange(7))


@dataclass
class Gam:
    """``cuts[f]``: ascending bin borders; ``tables[f]``: a value per bin; ``pairs``: (f, g, table) over coarse bins."""

    prior: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        if self.pairs:
            low = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.coarse)]
            for f, g, table in self.pairs:
                z += table[low[f], low[g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    u = np.unique(v)
    if len(u) <= 1:
        return np.zeros(0)
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    at = np.searchsorted(u, q)
    at = at[at > 0]
    return np.unique((u[at - 1] + u[at]) / 2) if len(at) else (u[:1] + u[1:2]) / 2


def _leaf(g: float, h: float, l2: float) -> float:
    return g / (h + l2)


def _shallow(g: np.ndarray, h: np.ndarray, l2: float, depth: int = 2) -> np.ndarray:
    """Values per bin of a tree on binned sums of gradient and hessian, each split the best one in its node."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), l2))
    if depth == 0 or len(g) < 2:
        return out
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + l2) + (g.sum() - a) ** 2 / (h.sum() - b + l2)
    k = int(np.argmax(gain)) + 1
    out[:k] = _shallow(g[:k], h[:k], l2, depth - 1)
    out[k:] = _shallow(g[k:], h[k:], l2, depth - 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four, its gain and its values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a, b, d, s = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, b - a, d - a, s - b - d + a]

    gs, hs = parts(cg), parts(ch)
    gain = sum(x**2 / (y + l2) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (y[i, j] + l2) for x, y in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, l2: float = 2.0) -> Gam:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Gam(prior=float(np.log((share * max(len(y), 1) + 0.5) / ((1 - share) * max(len(y), 1) + 0.5))) if len(y) else 0.0)
    n = x.shape[1]
    m = Gam(prior=float(np.log(share / (1 - share))), cuts=[_cuts(x[:, f], bins) for f in range(n)], coarse=[_cuts(x[:, f], 12) for f in range(n)])
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(m.cuts)]
    z = np.full(len(y), m.prior)
    for _ in range(rounds):
        for f in range(n):
            p = 1 / (1 + np.exp(-z))
            size = len(m.tables[f])
            step = rate * _shallow(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), l2)
            m.tables[f] += step
            z += step[at[f]]
    low = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(m.coarse)]

    def table(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(m.coarse[f]) + 1, len(m.coarse[g]) + 1
        k = low[f] * shape[1] + low[g]
        return k, np.bincount(k, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(k, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-z))
    ranked = sorted(combinations(range(n), 2), key=lambda fg: (-_quadrants(*table(*fg, p)[1:], l2)[0], fg))[:n_pairs]
    m.pairs = [(f, g, np.zeros((len(m.coarse[f]) + 1, len(m.coarse[g]) + 1))) for f, g in ranked]
    for _ in range(pair_rounds):
        for f, g, values in m.pairs:
            k, gs, hs = table(f, g, 1 / (1 + np.exp(-z)))
            step = rate * _quadrants(gs, hs, l2)[1]
            values += step
            z += step.ravel()[k]
    return m


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``x``, the text's measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = measures(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType([*(docs.schema[k] for k in keep), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """Fits on labelled rows outside the held-out fifth (crc32 of the id as text, modulo 5, is 0)."""
    picked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = picked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = picked.withColumn("draw", F.xxhash64("doc_id") / float(1 << 64) + 0.5)
    n = picked.count()
    picked = lowest(drawn, "draw", ["doc_id"], max_rows, n, n).drop("draw")
    # at most max_rows ids of two numbers each: the size that is broadcast is bounded by the parameter
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text"), ["doc_id", "quality"])
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # rows that repeat an id count once, so max_rows holds
    got = sorted(rows.collect())
    x = np.array([r["x"] for r in got]).reshape(-1, len(MEASURES))
    return fit(x, np.array([r["quality"] for r in got], float))


def scored(docs: DataFrame, model: Gam, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``, from the text only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(measures(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType())]))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).  Columns of these three names
    are replaced."""
    added = ("held_out", "score", "predicted")
    return judged(spark, docs, labels, threshold, max_rows).select(*(F.col("row")[c].alias(c) for c in keep if c not in added), *added)


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """As ``classify``, with all columns of ``docs`` in the struct ``row``."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    out = scored(packed, train(spark, docs, labels, max_rows), ["doc_id", "row"])
    return out.select("row", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
