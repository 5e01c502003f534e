"""Decoding a per-trial target from counts of events, with a null from other target series.

Rows are trials: keys (a session), ``trial``, ``x`` (one number per unit and bin) and ``y`` (the target first, then the null's
series).  All series are scored in one pass over the counts, since they share them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions.kernels import logistics
from recloom.operators import encoding as en
from recloom.operators.catalog import ranked


#: Bytes of the rows of models that are fitted side by side.
STACK_BYTES = 16 << 20


#: A logit up to this is no vote for class 1: models are exact to 1e-9, and a trial between two even classes must not be put by rounding.
TIE = 1e-7


class AnySize(dict):
    """One group of regressors, however many a session has."""

    def __missing__(self, p: int) -> list[str]:
        return ["counts"] * p


def features(counts: DataFrame, trials: DataFrame, keys: Sequence[str], trial: str, n_bins: int) -> DataFrame:
    """``x`` of every trial: its session's units in order, ``n_bins`` numbers each, 0 where ``counts`` (keys, trial, ``unit``,
    ``bin``, ``n``) has no row.  Sessions in which no unit fires in any trial are left out."""
    units = counts.select(*keys, "unit").distinct()
    own = Window.partitionBy(*keys)
    units = units.select(*keys, "unit", (F.row_number().over(own.orderBy("unit")) - 1).alias("_u"))
    sizes = units.groupBy(*keys).agg((F.count("*") * n_bins).cast("int").alias("_p"))
    at = (F.col("_u") * n_bins + F.col("bin")).cast("int")
    found = counts.join(units, [*keys, "unit"]).groupBy(*keys, trial).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("n").cast("double").alias("v")))).alias("_m"))
    every = trials.select(*keys, trial).join(sizes, list(keys)).join(found, [*keys, trial], "left")
    x = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))
    return every.select(*keys, trial, x.alias("x"))


def other_sessions(trials: DataFrame, session: str, trial: str, order: str, y: str, n_null: int) -> DataFrame:
    """``y`` of every trial as an array: its own value, then those of the trials with its number in the ``n_null`` sessions
    that follow in order (from the first again after the last, and never the own one, so that few sessions repeat); a session
    of fewer trials is read from its start again.  Trials without a value, and a single session's, are left out."""
    own = Window.partitionBy(session)
    x = trials.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    x = x.select(session, trial, F.col(y).cast("double").alias("_y"), (F.row_number().over(own.orderBy(order, trial)) - 1).alias("_j"), F.count("*").over(own).alias("_n"))
    sessions = ranked(x.groupBy(session).agg(F.count("*").alias("_of")), session)
    n = sessions.agg(F.count("*").alias("_all"))
    step = F.explode(F.sequence(F.lit(1), F.lit(n_null))).alias("_k")
    source = F.pmod(F.col("rank") + 1 + F.pmod(F.col("_k") - 1, F.col("_all") - 1), F.col("_all"))
    wanted = sessions.crossJoin(F.broadcast(n)).filter("_all > 1").select(session, "rank", "_all", step).select(session, "_k", source.alias("_src"))
    wanted = wanted.join(sessions.select(F.col("rank").alias("_src"), F.col(session).alias("_from"), "_of"), "_src").select(session, "_k", "_from", "_of")
    need = x.select(session, trial, "_j").join(wanted, session).withColumn("_at", F.pmod("_j", "_of"))
    got = need.join(x.select(F.col(session).alias("_from"), F.col("_j").alias("_at"), F.col("_y").alias("_v")), ["_from", "_at"])
    null = got.groupBy(session, trial).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("_null"))
    return x.join(null, [session, trial]).select(session, trial, F.concat(F.array("_y"), "_null").alias("y"))


def runs_of(rows: DataFrame, keys: Sequence[str], trial: str, n_runs: int, seed: int = 0) -> DataFrame:
    """Every trial once per ``run``, with its place ``i`` of ``n`` in that run's order: by time (``trial``) in run 0, by a seeded
    hash in the others, so that folds differ."""
    x = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    own = Window.partitionBy(*keys, "run")
    mixed = F.when(F.col("run") > 0, F.xxhash64(F.col(trial), F.col("run"), F.lit(seed)))
    return x.withColumns({"i": (F.row_number().over(own.orderBy(mixed, trial)) - 1).cast("long"), "n": F.count("*").over(own)})


def decode(rows: DataFrame, keys: Sequence[str], trial: str, n_series: int, n_runs: int = 1, n_folds: int = 5, lam: float = 1.0) -> DataFrame:
    """E19, linear: per key and ``series`` (0 the target, the others its null) the mean over runs of the cross-validated R2, null
    where a series doesn't vary in some fold.  Trials add up to statistics per fold, which are all that one task sees."""
    scores = en.fit_rows(runs_of(rows, keys, trial, n_runs), [*keys, "run"], np.eye(1), 0, n_folds, n_series, en.scoring(AnySize(), 1, n_series, [lam], drop=False))
    mean = F.when(F.count("r2_cv") == F.count("*"), F.avg("r2_cv"))
    return scores.groupBy(*keys, F.col("target").alias("series")).agg(mean.alias("score"))


def decode_classes(rows: DataFrame, keys: Sequence[str], trial: str, n_series: int, n_runs: int = 1, n_folds: int = 5, lam: float = 1.0) -> DataFrame:
    """E19, logistic: as ``decode`` for series of 0 and 1, scored by balanced accuracy over all held-out trials of a run; null
    where a series, or what a fold learns from, has one class only.  A task streams sessions, and the models of
    all runs, folds and series of one step side by side.  The ridge
    treats all directions alike, so counts are turned into as many columns as there are trials, if these are fewer."""
    kinds = dict(rows.dtypes)

    def scores(x: np.ndarray, y: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Per run and series."""
        size = int((run == run[0]).sum())
        fold = ((np.arange(size) + 1) * n_folds - 1) // size
        if x.shape[1] > size:  # all runs have the same trials
            back = np.linalg.svd(x[:size], full_matrices=False)[2]
            x = x @ back.T
        x, y = x.reshape(-1, size, x.shape[1]), y.reshape(-1, size, n_series)
        pred = np.full(y.shape, np.nan)
        used = fold != np.unique(fold)[:, None]
        both = np.array([(y[:, rest].min(1) == 0) & (y[:, rest].max(1) == 1) if rest.any() else np.zeros((len(y), n_series), bool) for rest in used])
        which = np.argwhere(both)  # fold, run, series
        means = np.stack([x[:, v].mean(1) if v.any() else x[:, 0] for v in used])  # fold, run, column
        most = max(1, STACK_BYTES // (8 * size * (x.shape[2] + 1) + 8 * (x.shape[2] + 1) ** 2))
        for first in range(0, len(which), most):
            f, r, t = which[first : first + most].T
            rest = used[f]
            own = x[r] - means[f, r][:, None]
            w = logistics(own, y[r, :, t], rest, lam)
            hit = (own @ w[:, :-1, None])[:, :, 0] + w[:, -1:] > TIE
            at, trial = np.nonzero(~rest)
            pred[r[at], trial, t[at]] = hit[at, trial]
        good = np.isfinite(pred).all(1) & (y.min(1) == 0) & (y.max(1) == 1)
        right = [np.where(y == c, pred == c, False).sum(1) / np.maximum((y == c).sum(1), 1) for c in (0.0, 1.0)]
        return np.where(good, (right[0] + right[1]) / 2, np.nan)

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, run = en.codes(t, keys), t.column("run").to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
        (x, of_x), (y, of_y) = en.lists_of(t, "x"), en.lists_of(t, "y")
        found = [scores(x[of_x[a] : of_x[z]].reshape(z - a, -1), y[of_y[a] : of_y[z]].reshape(z - a, -1), run[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        n = [v.size for v in found]
        row, flat = pa.array(np.repeat(edges[:-1], n)), np.concatenate([v.ravel() for v in found])
        series = pa.array(np.concatenate([np.tile(np.arange(n_series), len(v)) for v in found]), pa.int32())
        yield pa.RecordBatch.from_arrays([*(t.column(k).take(row).combine_chunks() for k in keys), series, pa.array(flat, pa.float64(), mask=np.isnan(flat))], names=[*keys, "series", "score"])

    x = en.streamed(runs_of(rows, keys, trial, n_runs), keys, ["run", "i"], work, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "series int, score double")
    return x.groupBy(*keys, "series").agg(F.when(F.count("score") == F.count("*"), F.avg("score")).alias("score"))


def against_null(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the target's score, its p-value and the null's 95 % quantile over series that have a score; in one pass, as scores are
    what costs."""
    x = scores.withColumn("_seen", F.max(F.when(F.col("series") == 0, F.col("score"))).over(Window.partitionBy(*keys)))
    drawn = (F.col("series") > 0) & F.col("score").isNotNull()
    over = F.coalesce(drawn & (F.col("score") >= F.col("_seen")) & ~F.isnan("score") & ~F.isnan("_seen"), F.lit(False))
    n = F.count_if(drawn)
    p = F.when(n > 0, (1 + F.count_if(over)) / (n + 1))
    x = x.groupBy(*keys).agg(F.max("_seen").alias("score"), p.alias("p_value"), F.percentile(F.when(drawn, F.col("score")), F.lit(0.95)).alias("null_p95"), F.count_if(F.col("series") == 0).alias("_own"))
    return x.filter("_own > 0").drop("_own")
