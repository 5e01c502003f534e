"""Lagged encoding models: targets on behaviour, for all recordings at once.

The only large step is one pass that turns samples into sufficient statistics per (recording, fold); chunks carry a halo of
the neighbouring samples that their lags reach, so each is expanded alone and never stored.  Everything after it (folds,
penalties, dropped groups) is small linear algebra on these statistics, one recording per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recloom.operators.qc import quantiles


def fold_label(i: Column, n: Column, k: int) -> Column:
    """Contiguous folds with edges at floor(n f / k)."""
    return F.floor(((i + 1) * k - 1) / n).cast("int")


def chunk_label(i: Column, start: Column, size: int) -> Column:
    """Chunk inside a fold that begins at ``start``."""
    return F.floor((i - start) / size).cast("int")


def circular_shift(df: DataFrame, i: str, n: str, k: Column) -> DataFrame:
    """Row i moves to (i + k) mod n; key arithmetic, no window."""
    return df.withColumn(i, F.pmod(F.col(i) + k, F.col(n)))


def basis_table(spark: SparkSession, fs: float, t_pre: float, t_post: float, n_basis: int | None) -> DataFrame:
    """``j`` (lag index), ``tau`` (s), ``k`` (bump), ``v``: raised cosines with evenly spaced centres, or the identity."""
    n_pre, n_post = round(t_pre * fs), round(t_post * fs)
    lags = n_pre + n_post + 1
    x = spark.range(lags).select(F.col("id").alias("j"), ((F.col("id") - n_pre) / fs).alias("tau"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((n_basis or lags) - 1))))
    if n_basis is None:
        return x.withColumn("v", (F.col("j") == F.col("k")).cast("double"))
    step = (lags - 1) / (n_basis - 1) if n_basis > 1 else float(lags)
    arg = (F.col("j") - F.col("k") * (step if n_basis > 1 else 0.0)) / step
    return x.withColumn("v", F.when(F.abs(arg) <= 1, 0.5 * (1 + F.cos(arg * float(np.pi)))).otherwise(0.0))


def basis_matrix(basis: DataFrame) -> np.ndarray:
    """The basis as a matrix: (lags x bumps) numbers, set by parameters, not by data."""
    f = basis.select("j", "k", "v").toPandas()
    out = np.zeros((int(f.j.max()) + 1, int(f.k.max()) + 1))
    out[f.j, f.k] = f.v
    return out


def lag_expand(base: DataFrame, basis: DataFrame, keys: Sequence[str], n_pre: int, n: str) -> DataFrame:
    """W5 by joining lags: X[i, r, k] = sum over j of B[j, k] base_r[i - (j - n_pre)], nothing beyond the ends.  For small
    bases; ``statistics`` expands larger ones chunk by chunk."""
    x = base.crossJoin(F.broadcast(basis.filter("v != 0").select("j", "k", F.col("v").alias("_b"))))
    x = x.withColumn("i", F.col("i") + F.col("j") - n_pre).filter((F.col("i") >= 0) & (F.col("i") < F.col(n)))
    return x.groupBy(*keys, "r", "k", "i").agg(F.sum(F.col("v") * F.col("_b")).alias("x"))


#: Lags up to which a basis is summed lag by lag; longer ones go through FFT.
FEW_LAGS = 16


def expand(base: np.ndarray, b: np.ndarray, n_pre: int) -> np.ndarray:
    """Rows x (regressor, bump) of a whole block, zero beyond it; columns ordered by regressor, then bump.  Axes before the last
    two are a stack of blocks."""
    *stack, n, width = base.shape
    lags = len(b)
    if lags <= FEW_LAGS:
        wide = np.zeros((*stack, n + lags - 1, width))
        wide[..., lags - 1 - n_pre : lags - 1 - n_pre + n, :] = base
        out = np.zeros((*stack, n, width, b.shape[1]))
        for j in range(lags):
            out += wide[..., lags - 1 - j : lags - 1 - j + n, :, None] * b[j]
        return out.reshape(*stack, n, width * b.shape[1])
    size = 1 << (n + lags - 1).bit_length()
    fb = np.fft.rfft(b, size, axis=0)
    parts = [np.fft.irfft(np.fft.rfft(base[..., r], size)[..., None] * fb, size, axis=-2)[..., n_pre : n_pre + n, :] for r in range(width)]
    return np.concatenate(parts, axis=-1) if parts else np.zeros((*stack, n, 0))


def pack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """N, sums of x, y, y squared, upper triangle of x'x, x'y, in float64; adding packs merges samples."""
    iu = np.triu_indices(x.shape[1])
    return np.concatenate(([len(x)], x.sum(0), y.sum(0), (y**2).sum(0), (x.T @ x)[iu], (x.T @ y).ravel()))


def chunk_packs(rows: DataFrame, keys: Sequence[str], b: np.ndarray, n_pre: int, n_folds: int, size: int = 15_000) -> DataFrame:
    """Packed statistics (``s``) per key, fold and chunk; those of a key and fold add up.  ``rows``: keys, ``i``, ``n``,
    ``x`` (array of base regressors), ``y`` (array of targets).  A group of the numpy step is one chunk of ``size`` samples
    with its halo, which comes and goes as flat Arrow buffers."""
    n_post = len(b) - 1 - n_pre
    first, last = F.floor((F.col("i") - n_pre) / size), F.floor((F.col("i") + n_post) / size)
    top = F.floor((F.col("n") - 1) / size)
    spread = rows.select(*keys, "i", "n", "x", "y", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, top))).alias("_c"))
    kinds = dict(rows.dtypes)

    def run(t: pa.Table) -> pa.Table:
        i, n, c = t.column("i").to_numpy(), t.column("n")[0].as_py(), t.column("_c")[0].as_py()
        order = np.argsort(i)
        flat = lambda name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(i), -1)[order]
        i, base, y = i[order], flat("x"), flat("y")
        full = np.zeros((int(i[-1] - i[0]) + 1, base.shape[1]))
        full[i - i[0]] = base
        x = expand(full, b, n_pre)[i - i[0]]
        own = (i >= c * size) & (i < (c + 1) * size)
        fold = ((i + 1) * n_folds - 1) // n
        some = np.unique(fold[own])
        packs = [pack(x[at], y[at]) for at in (own & (fold == k) for k in some)]
        columns = [t.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(some), np.int64))) for k in keys]
        return pa.Table.from_arrays([*columns, pa.array(some, pa.int32()), pa.array(packs, pa.list_(pa.float64()))], names=[*keys, "fold", "s"])

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    return spread.groupBy(*keys, "_c").applyInArrow(run, schema + "fold int, s array<double>")


def only_targets(packs: DataFrame, p: int, m: int, keep: Sequence[int]) -> DataFrame:
    """Packs of ``p`` columns and ``m`` targets without the targets that are not in ``keep``, by places in the array."""
    tri = p * (p + 1) // 2
    places = [*range(1 + p), *(1 + p + t for t in keep), *(1 + p + m + t for t in keep), *range(1 + p + 2 * m, 1 + p + 2 * m + tri)]
    places += [1 + p + 2 * m + tri + r * m + t for r in range(p) for t in keep]
    return packs.withColumn("s", F.transform(F.array(*map(F.lit, places)), lambda k: F.get("s", k)))


def statistics(rows: DataFrame, keys: Sequence[str], b: np.ndarray, n_pre: int, n_folds: int, size: int = 15_000) -> DataFrame:
    """The sums of ``chunk_packs`` in long form: keys, ``fold``, ``at`` (place in the pack), ``v``."""
    parts = chunk_packs(rows, keys, b, n_pre, n_folds, size)
    return parts.select(*keys, "fold", F.posexplode("s").alias("at", "v")).groupBy(*keys, "fold", "at").agg(F.sum("v").alias("v"))


def gathered(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One packed array per key and fold: its length is set by the model, not by the recording."""
    return stats.groupBy(*keys, "fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("s"))


def leave_one_out(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total of all folds less one's own."""
    return stats.withColumn("rest", F.sum("v").over(Window.partitionBy(*keys, "at")) - F.col("v"))


def second_difference(m: int) -> np.ndarray:
    """E5: D'D of second differences; the identity under three coefficients."""
    if m < 3:
        return np.eye(m)
    d = np.diff(np.eye(m), n=2, axis=0)
    return d.T @ d


def penalty(groups: Sequence[str], n_basis: int, strength: Mapping[str, float]) -> np.ndarray:
    """E5: along the diagonal, a smoothness block for each base regressor, times its group's strength (none: 0)."""
    return np.kron(np.diag([float(strength.get(g, 0.0)) for g in groups]), second_difference(n_basis))


def centred(s: np.ndarray, p: int, m: int) -> dict[str, np.ndarray]:
    """A stack of packs as means and centred products of ``p`` regressors and ``m`` targets, the stack's axis first."""
    n, sx, sy, sq, tri, xy = np.split(s, np.cumsum([1, p, m, m, p * (p + 1) // 2]), axis=1)
    x, y, (i, j) = sx / n, sy / n, np.triu_indices(p)
    xx = np.zeros((len(s), p, p))
    xx[:, i, j] = xx[:, j, i] = tri
    return {"n": n, "x": x, "y": y, "raw": sq, "xx": xx - n[:, :, None] * x[:, :, None] * x[:, None], "xy": xy.reshape(-1, p, m) - n[:, :, None] * x[:, :, None] * y[:, None], "yy": sq - n * y**2}


def fits(train: dict, pen: np.ndarray, lambdas: Sequence[float], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (stack, penalty, ``keep``, target) of the columns ``keep``, and which of them there are: a system that
    is not positive definite has none.  Products and penalty are made diagonal together once a system, and each penalty is
    then a scaling of this; a penalty that reaches every direction needs no such check, and systems are solved one by one."""
    at = np.ix_(range(len(train["n"])), keep, keep)
    least = min((v for v in lambdas if v > 0), default=0.0)
    own, eps = pen[np.ix_(keep, keep)], np.finfo(float).eps
    system = train["xx"][at]
    size = np.trace(system, axis1=1, axis2=2) + max(lambdas, default=0.0) * np.trace(own)
    if len(keep) and min(lambdas) > 0 and (1e3 * len(keep) * eps * size < least * np.linalg.eigvalsh(own)[0]).all():
        # the penalty alone makes every system positive definite
        cross = train["xy"][:, None, keep]
        return np.concatenate([np.linalg.solve((system + v * own)[:, None], cross) for v in lambdas], axis=1), np.ones((len(system), len(lambdas)), bool)
    low, turn = np.linalg.eigh(system + least * own)
    good = (low[:, :1] > len(keep) * eps * np.abs(low[:, -1:])).all(1) if len(keep) else np.ones(len(low), bool)
    turn = turn / np.sqrt(np.where(good[:, None], low, 1.0))[:, None]
    scale = np.ones((len(low), len(lambdas), len(keep)))
    if any(v != least for v in lambdas):
        share, more = np.linalg.eigh(np.swapaxes(turn, 1, 2) @ own @ turn)
        turn = turn @ more
        scale += (np.array(lambdas) - least)[None, :, None] * share[:, None]
    there = good[:, None] & (scale > 1e-12).all(2)
    cross = np.swapaxes(turn, 1, 2) @ train["xy"][:, keep]
    return turn[:, None] @ (cross[:, None] / np.where(there[:, :, None], scale, 1.0)[..., None]), there


def r2(scored: dict, train: dict, w: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """(stack, penalty, target), from the scored statistics alone.  NaN where the target doesn't vary."""
    xx, xy = scored["xx"][:, keep][:, :, keep][:, None], scored["xy"][:, None, keep]
    rest = scored["yy"][:, None] - 2 * (w * xy).sum(2) + (w * (xx @ w)).sum(2)
    off = (scored["y"] - train["y"])[:, None] - ((scored["x"] - train["x"])[:, None, keep, None] * w).sum(2)
    rest = rest + scored["n"][:, :, None] * off**2
    varies = (scored["yy"] > 1e-12 * np.maximum(scored["raw"], 1e-300))[:, None]
    return np.where(varies, 1 - rest / np.where(varies, scored["yy"][:, None], 1), np.nan)


def codes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row, the same for rows of the same key."""
    out = np.zeros(t.num_rows, np.int64)
    for k in keys:
        column = t.column(k).combine_chunks().dictionary_encode("encode")
        out = out * max(1, len(column.dictionary)) + column.indices.to_numpy(zero_copy_only=False)
    return out


def summed(t: pa.Table, keys: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length of pack: a row of each part (key and fold), the part's key (numbered from 0), and the parts' sums, by key, then
    fold."""
    length = pc.list_value_length(t.column("s")).to_numpy()
    key, fold = codes(t, keys), t.column("fold").to_numpy()
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        rows = rows[np.lexsort((fold[rows], key[rows]))]
        new_key = np.concatenate(([True], key[rows][1:] != key[rows][:-1]))
        first = np.flatnonzero(new_key | np.concatenate(([True], fold[rows][1:] != fold[rows][:-1])))
        flat = t.column("s").take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
        yield rows[first], (np.cumsum(new_key) - 1)[first], np.add.reduceat(flat, first)


def partly_summed(packs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packs of one key and fold that lie together, added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for rows, _, sums in summed(t, keys) if t.num_rows else ():
                own = b.take(pa.array(rows)).select([*keys, "fold"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(sums), pa.list_(pa.float64()))], names=[*keys, "fold", "s"])

    return packs.select(*keys, "fold", "s").mapInArrow(run, packs.select(*keys, "fold", "s").schema)


#: Bytes of matrices that a task works on at a time.
STACK_BYTES = 48 << 20
#: A fit of stacks of parts: its columns with their types, and what makes them.  It gets the parts' sums and each part's key, numbered
#: from 0, and gives the key of each row and the columns.
Fit = tuple[dict[str, str], Callable[[np.ndarray, np.ndarray], tuple]]
TYPES = {"double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def streamed(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` of tables of whole keys.  Keys come sorted, and by ``order`` within one, so that a task streams them; no group is
    made per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            key = codes(t, keys)
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            held = t.slice(cut).to_batches()
            if cut:
                yield from work(t.slice(0, cut))
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fitted(own: pa.Table, parts: np.ndarray, key: np.ndarray, row: np.ndarray, n_targets: int, fit: Fit) -> Iterator[pa.RecordBatch]:
    """``fit`` of as many keys at a time as ``STACK_BYTES`` holds.  ``key``: each part's key in ascending order; ``row``: the row of
    ``own`` that has its key columns."""
    columns, rows = fit
    p = columns_of(parts.shape[1], n_targets)
    most = max(1, STACK_BYTES // (48 * p * p + 8 * parts.shape[1]))
    start = 0
    while start < len(key):
        end = min(len(key), start + most)
        if end < len(key):  # whole keys only
            end = max(np.searchsorted(key, key[end], "left"), np.searchsorted(key, key[start], "right"))
        number = np.cumsum(np.concatenate(([0], key[start:end][1:] != key[start:end][:-1])))
        owner, values = rows(parts[start:end], number)
        at = pa.array(row[start:end][np.searchsorted(number, owner, "left")])
        found = [pa.array(v, TYPES[k], mask=np.isnan(v) if k == "double" else None) for v, k in zip(values, columns.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(c.take(at).combine_chunks() for c in own.columns), *found], names=[*own.column_names, *columns])
        start = end


def per_key(packs: DataFrame, keys: Sequence[str], n_targets: int, fit: Fit) -> DataFrame:
    """``fit`` of stacks of many keys.  ``packs``: ``chunk_packs`` or ``statistics``."""
    kinds = dict(packs.dtypes)
    packs = gathered(packs, keys) if "at" in packs.columns else partly_summed(packs, keys)

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for first, key, sums in summed(t, keys):
            yield from fitted(t.select(list(keys)), sums, key, first, n_targets, fit)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} {k}" for c, k in fit[0].items())])
    return streamed(packs, keys, ["fold"], work, schema)


#: Products of columns up to which a design's statistics are sums of products, not matrix products.
FEW_PRODUCTS = 6


def rolled_packs(i: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, shift: np.ndarray, b: np.ndarray, n_pre: int, n_folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs of one whole recording for each shift and fold that has samples, and the place of its shift and its fold.  Regressors roll,
    targets stay; a target without a regressor on it is left out.  ``i`` ascends."""
    base, known = np.zeros((n, x.shape[1])), np.zeros(n, bool)
    base[i], known[i] = x, True
    source = (np.arange(n) - shift[:, None]) % n
    full, fold = expand(base[source], b, n_pre)[:, i], ((i + 1) * n_folds - 1) // n
    there = known[source][:, i]
    whole = there.all()
    full = full if whole else np.where(there[..., None], full, 0.0)
    some, edges = np.unique(fold, return_index=True)
    edges = np.append(edges, len(i))
    (p, m), (iu, ju) = (full.shape[2], y.shape[1]), np.triu_indices(full.shape[2])
    if p * (p + m) <= FEW_PRODUCTS:  # all folds at once; wide designs go by matrix products, a fold each
        across, t = full.swapaxes(1, 2), np.where(there[:, None], y.T[None], 0.0)
        crossed = (across[:, :, None] * t[:, None]).reshape(len(shift), p * m, -1)
        out = np.add.reduceat(np.concatenate([there[:, None], across, t, t**2, across[:, iu] * across[:, ju], crossed], axis=1), edges[:-1], axis=2).swapaxes(1, 2)
    else:
        out = np.empty((len(shift), len(some), 1 + p + 2 * m + len(iu) + p * m))
        for k in range(len(some)):
            at = slice(edges[k], edges[k + 1])
            own, t = full[:, at], y[None, at] if whole else np.where(there[:, at, None], y[at], 0.0)
            across = own.swapaxes(1, 2)
            out[:, k] = np.concatenate([np.broadcast_to(v, (len(shift), v.shape[1])) for v in (
                there[:, at].sum(1, keepdims=True), own.sum(1), t.sum(1), (t**2).sum(1), (across @ own)[:, iu, ju], (across @ t).reshape(len(shift), -1))], axis=1)
    d, k = np.nonzero(out[:, :, 0])
    return d, some[k], out[d, k]


def lists_of(t: pa.Table, name: str, kind: type = float) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, and where each row's begin and end."""
    column = t.column(name).combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.concatenate(([0], np.cumsum(length)))


#: Samples of a row of ``laid``.
LAID = 1000


def laid(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples (as ``chunk_packs`` takes them), up to ``LAID`` neighbours of a recording as one row: keys, ``n``, flat arrays ``i``,
    ``x``, ``y``, and whether it is the ``whole`` recording.  Where a window has brought samples together by ``keys``, nothing is
    shuffled."""
    blocks = rows.groupBy(*keys, "n", F.floor(F.col("i") / LAID).alias("_c")).agg(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "x", "y")).alias("s"))
    return blocks.select(*keys, F.col("n").cast("long").alias("n"), "s.i", (F.size("s") == F.col("n")).alias("whole"), *(F.flatten(F.col("s")[c]).cast("array<double>").alias(c) for c in "xy"))


def samples(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The samples of ``laid``, a row each."""
    one = blocks.select(*keys, "n", "x", "y", F.size("i").alias("_m"), F.posexplode("i").alias("_p", "i"))
    width = lambda c: (F.size(c) / F.col("_m")).cast("int")
    return one.select(*keys, "i", "n", *(F.slice(c, F.col("_p") * width(c) + 1, width(c)).alias(c) for c in "xy"))


def fit_rows(rows: DataFrame, keys: Sequence[str], b: np.ndarray, n_pre: int, n_folds: int, n_targets: int, fit: Fit, draws: DataFrame | Column | None = None, size: int = 15_000) -> DataFrame:
    """``fit`` of samples (as ``chunk_packs`` takes them, or as ``laid`` lays them), and with ``draws`` (keys, ``perm``, ``shift``; or for
    ``laid`` samples an array of ``perm``, ``shift`` from keys and ``n``) of their rolled designs, keyed by ``perm`` too.  A recording
    of up to ``size`` samples comes to one task, which makes its statistics, fits them and forgets them, so that what is shuffled
    is samples and draws; only longer ones leave statistics that are added up.  Whole recordings that lie in a row are fitted
    where they lie."""
    kinds, rolled = dict(rows.dtypes), draws is not None
    columns, blocks = [*keys, "perm"] if rolled else list(keys), kinds["i"].startswith("array")
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(["perm int"] if rolled else []), *(f"{c} {k}" for c, k in fit[0].items())])

    def made(own: pa.Table, recordings: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """``recordings``: rows of ``own`` and shifts of the draws, and n, i, x, y."""
        held: dict[int, list] = {}
        bytes_ = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for found in held.values():
                parts, owner, row = (np.concatenate(v) for v in zip(*found, strict=True))
                yield from fitted(own, parts, owner, row, n_targets, fit)
            held.clear()

        for of, some, n, i, x, y in recordings:
            x, y = x.reshape(len(i), -1), y.reshape(len(i), -1)
            if (i[1:] < i[:-1]).any():  # a list has no order
                order = np.argsort(i, kind="stable")
                i, x, y = i[order], x[order], y[order]
            step = max(1, STACK_BYTES // (16 * n * max(1, x.shape[1] * b.shape[1])))
            for first in range(0, len(some), step):
                d, _, packs = rolled_packs(i, n, x, y, some[first : first + step], b, n_pre, n_folds)
                if len(packs):
                    held.setdefault(packs.shape[1], []).append((packs, number + d, of[first : first + step][d]))
                number, bytes_ = number + step, bytes_ + packs.nbytes
                if bytes_ > STACK_BYTES:
                    yield from flush()
                    bytes_ = 0
        yield from flush()

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, at = codes(t, keys), t.column("_at").to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
        (x, of_x), (y, of_y) = lists_of(t, "x"), lists_of(t, "y")
        i, of_i = lists_of(t, "i", np.int64) if blocks else (at, np.arange(len(at) + 1))
        n = pc.fill_null(t.column("n"), 0).to_numpy()
        shifts = pc.fill_null(t.column("shift"), 0).to_numpy() if rolled else None

        def recordings() -> Iterator[tuple]:
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                c = a + int(np.searchsorted(at[a:z], 0))
                if c == z or rolled and a == c:
                    continue
                some, of = (shifts[a:c], np.arange(a, c)) if rolled else (np.zeros(1, np.int64), np.array([a]))
                yield of, some, int(n[c]), i[of_i[c] : of_i[z]], x[of_x[c] : of_x[z]], y[of_y[c] : of_y[z]]

        yield from made(t.select(columns), recordings())

    def work_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n, own, of_d, shifts = t.column("n").to_numpy(), t.select(list(keys)), np.arange(t.num_rows + 1), np.zeros(t.num_rows, np.int64)
            lists = [lists_of(t, "i", np.int64), lists_of(t, "x"), lists_of(t, "y")]
            if rolled:
                (shifts, of_d), (perm, _) = lists_of(t, "_shift", np.int64), lists_of(t, "_perm", np.int32)
                own = own.take(pa.array(np.repeat(np.arange(t.num_rows), np.diff(of_d)))).append_column("perm", pa.array(perm))
            some = (r for r in range(t.num_rows) if of_d[r] < of_d[r + 1])
            yield from made(own, ((np.arange(of_d[r], of_d[r + 1]), shifts[of_d[r] : of_d[r + 1]], int(n[r]), *(v[at[r] : at[r + 1]] for v, at in lists)) for r in some))

    there = None
    if blocks and not isinstance(draws, DataFrame):
        lie, pair = F.col("whole") & (F.col("n") <= size), [draws[c].alias(f"_{c}") for c in ("perm", "shift")] if rolled else []
        there = rows.filter(lie).select(*keys, "n", "i", "x", "y", *pair).mapInArrow(work_whole, schema)
        rows = rows.filter(~lie)
        draws = rows.select(*keys, "n").distinct().select(*keys, "n", F.inline(draws)) if rolled else None
    i = F.col("i") if blocks else F.col("i").cast("long")
    short = rows.filter(F.col("n") <= size).select(*keys, (F.get("i", F.lit(0)) if blocks else i).alias("_at"), i.alias("i"), F.col("n").cast("long").alias("n"), "x", "y")
    if rolled:  # before the samples
        short = short.unionByName(draws.select(*keys, F.lit(-1).cast("long").alias("_at"), F.col("perm").cast("int").alias("perm"), F.col("shift").cast("long").alias("shift")), allowMissingColumns=True)
    long = rows.filter(F.col("n") > size)
    long = samples(long, keys) if blocks else long
    packs = null_packs(long, keys, draws, b, n_pre, n_folds, size) if rolled else chunk_packs(long, keys, b, n_pre, n_folds, size)
    out = streamed(short, keys, ["_at"], work, schema).unionByName(per_key(packs, columns, n_targets, fit))
    return out if there is None else there.unionByName(out)


def columns_of(size: int, n_targets: int) -> int:
    """How many columns a pack of ``size`` numbers is about."""
    return next(p for p in range(size) if 1 + p + 2 * n_targets + p * (p + 1) // 2 + p * n_targets >= size)


def scoring(groups: Sequence[str] | Mapping[int, Sequence[str]], n_basis: int, n_targets: int, lambdas: Sequence[float], drop: bool = True) -> Fit:
    """Per key, penalty, dropped group (empty: none) and target the R2 on all samples and its mean over
    held-out folds.  ``groups``: the group of each base regressor, or, where recordings differ, these lists by how many
    regressors a recording has.  A key whose matrix is singular gives rows with a ``status`` and no numbers, and the others
    go on."""
    lists = groups if isinstance(groups, Mapping) else {len(groups): groups}
    lambdas = [float(v) for v in lambdas]

    def rows(parts: np.ndarray, key: np.ndarray) -> tuple:
        p = columns_of(parts.shape[1], n_targets)
        groups = lists[p // n_basis]
        of, pen = np.repeat(np.array(groups), n_basis), penalty(groups, n_basis, dict.fromkeys(groups, 1.0))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total, folds = np.add.reduceat(parts, first), np.diff(np.append(first, len(key)))
        every, several = centred(total, p, n_targets), folds[key] > 1
        parts, key = parts[several], key[several]
        held, rest = centred(parts, p, n_targets), centred(total[key] - parts, p, n_targets)
        full, cv, there = [], [], []
        variants = ["", *dict.fromkeys(groups)] if drop else [""]
        for gone in variants:
            keep = np.flatnonzero(of != gone)
            w, good = fits(every, pen, lambdas, keep)
            own = r2(every, every, w, keep)
            w, fine = fits(rest, pen, lambdas, keep)
            mean = np.full(own.shape, np.nan)
            if len(key):
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                mean[key[at]] = np.add.reduceat(r2(held, rest, w, keep), at) / folds[key[at], None, None]
                good[key[at]] &= np.logical_and.reduceat(fine, at)
            for out, v in ((full, own), (cv, mean)):
                out.append(np.where(good[..., None], v, np.nan))
            there.append(np.repeat(good[..., None], n_targets, axis=2))
        full, cv, there = (np.stack(v, 2) for v in (full, cv, there))  # key, penalty, dropped, target
        place = np.indices(full.shape).reshape(4, -1)
        return place[0], (np.array(lambdas)[place[1]], np.array(variants, object)[place[2]], place[3], full.ravel(), cv.ravel(), np.where(there.ravel(), "ok", "the matrix is not positive definite").astype(object))

    return {"lam": "double", "dropped": "string", "target": "int", "r2_full": "double", "r2_cv": "double", "status": "string"}, rows


def solve(stats: DataFrame, keys: Sequence[str], groups: Sequence[str] | Mapping[int, Sequence[str]], n_basis: int, n_targets: int, lambdas: Sequence[float], drop: bool = True) -> DataFrame:
    """``scoring`` of statistics."""
    return per_key(stats, keys, n_targets, scoring(groups, n_basis, n_targets, lambdas, drop))


def weighing(groups: Sequence[str] | Mapping[int, Sequence[str]], n_basis: int, n_targets: int, lam: float) -> Fit:
    """K9: basis weights per (regressor, bump, target) of the fit on all samples; none for a key that can't be fitted."""
    lists = groups if isinstance(groups, Mapping) else {len(groups): groups}

    def rows(parts: np.ndarray, key: np.ndarray) -> tuple:
        p = columns_of(parts.shape[1], n_targets)
        groups = lists[p // n_basis]
        total = np.add.reduceat(parts, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))))
        w, there = fits(centred(total, p, n_targets), penalty(groups, n_basis, dict.fromkeys(groups, 1.0)), [float(lam)], np.arange(p))
        own, i, t = np.indices((len(w), p, n_targets)).reshape(3, -1)
        some = there[own, 0]
        return own[some], (i[some] // n_basis, i[some] % n_basis, t[some], w[:, 0].ravel()[some])

    return {"r": "int", "k": "int", "target": "int", "w": "double"}, rows


def weights(stats: DataFrame, keys: Sequence[str], groups: Sequence[str] | Mapping[int, Sequence[str]], n_basis: int, n_targets: int, lam: float) -> DataFrame:
    """``weighing`` of statistics."""
    return per_key(stats, keys, n_targets, weighing(groups, n_basis, n_targets, lam))


def kernels(w: DataFrame, basis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kernels in the lag domain."""
    return w.join(F.broadcast(basis.select("j", "k", "v")), "k").groupBy(*keys, "r", "target", "j").agg(F.sum(F.col("v") * F.col("w")).alias("kernel"))


def drop_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per dropped group how much cross-validated R2 goes with it."""
    whole = scores.filter("dropped = ''").select(*keys, "lam", "target", F.col("r2_cv").alias("_all"))
    return scores.filter("dropped != ''").join(whole, [*keys, "lam", "target"]).select(*keys, "lam", "target", "dropped", (F.col("_all") - F.col("r2_cv")).alias("dr2"))


def score_table(scores: DataFrame, keys: Sequence[str], groups: Sequence[str], floor: float = -0.3) -> DataFrame:
    """One row per key, way of choosing the penalty (``mode``: ``pooled`` over a key's targets or one ``per_target``)
    and target, with that penalty, both R2, what each group adds (``dr2_*``, null where a key lacks the group), whether it
    has the group (``has_*``), and ``status``."""
    whole = scores.filter("dropped = ''").select(*keys, "target", "lam", F.col("r2_cv").alias("r2"))
    pooled = pick_lambda_robust(whole, keys, floor).withColumn("mode", F.lit("pooled"))
    own = pick_lambda_robust(whole, [*keys, "target"], floor).withColumn("mode", F.lit("per_target"))
    is_whole = F.col("dropped") == ""
    wide = scores.groupBy(*keys, "target", "lam").agg(
        *(F.max(F.when(is_whole, F.col(c))).alias(c) for c in ("r2_full", "r2_cv", "status")),
        *(F.max(F.when(F.col("dropped") == g, F.col("r2_cv"))).alias(f"_{g}") for g in groups),
        *(F.max(F.col("dropped") == g).alias(f"has_{g}") for g in groups),
    )
    wide = wide.withColumns({f"dr2_{g}": F.col("r2_cv") - F.col(f"_{g}") for g in groups}).drop(*(f"_{g}" for g in groups))
    chosen = wide.join(pooled, [*keys, "lam"]).unionByName(wide.join(own, [*keys, "target", "lam"]))
    first = [*keys, "mode", "target", "lam", "fell_back"]
    return chosen.select(*first, *(c for c in chosen.columns if c not in first))


def with_null(scores: DataFrame, null: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``p_value`` and ``null_p95`` of score rows (``score_table``) from ``null``, the scores of shifted designs over the same
    penalties (``solve`` of ``null_packs``): each row against the draws at its own penalty.  Rows without draws have nulls."""
    own = [*keys, "mode", "target"]
    draws = null.filter("dropped = ''").select(*keys, "target", "lam", "r2_cv").join(scores.select(*own, "lam"), [*keys, "target", "lam"])
    return scores.join(p_value(draws.select(*own, "r2_cv"), scores.select(*own, "r2_cv"), own, "r2_cv"), own, "left")


def described(scores: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score rows with what is known of their targets (``keys``, ``target``, and columns such as band, channel, acronym), these
    first.  A target that ``meta`` lacks keeps its row."""
    about = [c for c in meta.columns if c not in (*keys, "target")]
    out = scores.join(meta, [*keys, "target"], "left")
    return out.select(*keys, "target", *about, *(c for c in scores.columns if c not in (*keys, "target")))


def pick_lambda(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """Penalty of the best median score, the smaller at a tie."""
    m = quantiles(scores, [*group, "lam"], "r2", [0.5]).withColumn("objective", F.col("q")[0])
    return first_best(m, group, "objective", "lam").select(*group, "lam", "objective")


def pick_lambda_robust(scores: DataFrame, group: Sequence[str], floor: float = -0.3, quantile: float = 0.05) -> DataFrame:
    """Best mean of the scores clipped to [-1, 1], among penalties whose low quantile clears the floor; the largest
    penalty where none does."""
    m = scores.groupBy(*group, "lam").agg(F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r2"))).alias("objective"), F.percentile("r2", F.lit(quantile)).alias("low"))
    safe = F.col("low").isNotNull() & ~F.isnan("low") & (F.col("low") >= floor)
    best = first_best(m.filter(safe), group, "objective", "lam").select(*group, F.col("lam").alias("_lam"))
    return fallback_largest(m, best, group, "lam")


def first_best(df: DataFrame, group: Sequence[str], value: str, index: str) -> DataFrame:
    """The row of the largest value, the first of equals by index; missing values lose."""
    own = Window.partitionBy(*group).orderBy(F.when(~F.isnan(value), F.col(value)).desc_nulls_last(), index)
    return df.withColumn("_rn", F.row_number().over(own)).filter("_rn = 1").drop("_rn")


def fallback_largest(candidates: DataFrame, best: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """T4: the best one's value (``_lam``), else the largest candidate."""
    top = candidates.groupBy(*group).agg(F.max(value).alias("_top"))
    return top.join(best, list(group), "left").select(*group, F.coalesce("_lam", "_top").alias(value), F.col("_lam").isNull().alias("fell_back"))


def p_value(null: DataFrame, observed: DataFrame, keys: Sequence[str], v: str = "r2") -> DataFrame:
    """(1 + draws at or over the observed value) / (draws + 1), and the null's 95 % quantile.  Missing draws are
    never over; a missing observed value has no draw over it."""
    x = null.join(observed.select(*keys, F.col(v).alias("_obs")), list(keys))
    over = F.coalesce((F.col(v) >= F.col("_obs")) & ~F.isnan(v) & ~F.isnan("_obs"), F.lit(False))
    return x.groupBy(*keys).agg(((1 + F.count_if(over)) / (F.count("*") + 1)).alias("p_value"), F.percentile(v, F.lit(0.95)).alias("null_p95"))


def shift_draws(sizes: DataFrame, keys: Sequence[str], n_perm: int, margin: int, seed: int = 0) -> DataFrame:
    """Shifts of the null: per recording ``n_perm`` draws in [margin, n - margin) by a seeded hash of the draw's number."""
    x = sizes.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    return x.withColumn("shift", margin + F.pmod(F.xxhash64("perm", F.lit(seed)), F.greatest(F.lit(1), F.col("n") - 2 * margin)))


def null_rows(rows: DataFrame, keys: Sequence[str], draws: DataFrame) -> DataFrame:
    """Base regressors rolled by each draw's shift against targets that stay; keyed by ``perm``."""
    base = rows.select(*keys, "i", "n", "x").join(draws.drop("n"), list(keys))
    base = circular_shift(base, "i", "n", F.col("shift")).drop("shift")
    return base.join(rows.select(*keys, "i", "y"), [*keys, "i"])


def null_packs(rows: DataFrame, keys: Sequence[str], draws: DataFrame, b: np.ndarray, n_pre: int, n_folds: int, size: int = 15_000, batch: int = 10) -> DataFrame:
    """What ``chunk_packs`` gives for ``null_rows``, keyed by ``perm`` too, without a join of samples: they are laid into
    blocks of ``size`` once, and a block of targets meets, for ``batch`` draws at a time, the blocks of base regressors that
    roll onto it and its halo.  ``draws``: keys, ``perm``, ``shift``.  Where a recording lacks samples, a target without a
    regressor on it is left out, and a regressor without a target on it still reaches its neighbours'."""
    n_post, kinds = len(b) - 1 - n_pre, dict(rows.dtypes)
    blocks = rows.select(*keys, "i", "n", "x", "y", F.floor(F.col("i") / size).alias("_c")).groupBy(*keys, "n", "_c")
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("s")).select(*keys, "n", "_c", "s.i", F.flatten("s.x").alias("x"), F.flatten("s.y").alias("y"))
    some = draws.withColumn("_g", F.floor(F.col("perm") / batch)).groupBy(*keys, "_g").agg(F.collect_list(F.struct("perm", "shift")).alias("_d"))
    own = blocks.select(*keys, "n", "_c", "i", "y").join(some, list(keys))
    low = F.greatest(F.lit(0), F.col("_c") * size - n_post)
    high = F.least(F.col("n"), (F.col("_c") + 1) * size + n_pre) - 1
    from_ = F.pmod(low - F.col("shift"), F.col("n"))
    to = from_ + high - low
    # the source runs on past the recording's end into its beginning
    around = F.when(to >= F.col("n"), F.sequence(F.lit(0).cast("long"), F.floor((to - F.col("n")) / size))).otherwise(F.array().cast("array<bigint>"))
    sources = F.array_union(F.sequence(F.floor(from_ / size), F.floor(F.least(to, F.col("n") - 1) / size)), around)
    wanted = own.select(*keys, "n", "_c", "_g", F.explode("_d.shift").alias("shift")).select(*keys, "_c", "_g", F.explode(sources).alias("_src")).distinct()
    base = wanted.join(blocks.select(*keys, F.col("_c").alias("_src"), "i", "x"), [*keys, "_src"]).drop("_src")
    both = own.unionByName(base, allowMissingColumns=True)

    def run(t: pa.Table) -> pa.Table:
        is_own = t.column("y").is_valid().to_numpy(zero_copy_only=False)
        flat = lambda name, at: t.column(name).filter(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        mine = t.filter(pa.array(is_own)).slice(0, 1)
        n, c = mine.column("n")[0].as_py(), mine.column("_c")[0].as_py()
        i, there = flat("i", is_own), flat("i", ~is_own)
        y, x = flat("y", is_own).astype(float).reshape(len(i), -1), flat("x", ~is_own).astype(float).reshape(len(there), -1)
        order = np.argsort(there)
        there, x = there[order], x[order]
        lo, hi = max(0, c * size - n_post), min(n, (c + 1) * size + n_pre)
        fold = ((i + 1) * n_folds - 1) // n
        out = []
        for draw in mine.column("_d")[0].as_py():
            source = (np.arange(lo, hi) - draw["shift"]) % n
            at = np.minimum(np.searchsorted(there, source), len(there) - 1)
            known = there[at] == source
            full = expand(np.where(known[:, None], x[at], 0.0), b, n_pre)[i - lo]
            for k in np.unique(fold):
                rows_of = (fold == k) & known[i - lo]
                if rows_of.any():
                    out.append((draw["perm"], int(k), pack(full[rows_of], y[rows_of])))
        own_keys = [mine.column(k).combine_chunks().take(pa.array(np.zeros(len(out), np.int64))) for k in keys]
        perm, folds, packs = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([*own_keys, pa.array(perm, pa.int32()), pa.array(folds, pa.int32()), pa.array(packs, pa.list_(pa.float64()))], names=[*keys, "perm", "fold", "s"])

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    return both.groupBy(*keys, "_c", "_g").applyInArrow(run, schema + "perm int, fold int, s array<double>")


def per_group(scores: DataFrame, groups: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of scores over a grid of penalties the rows at each target group's own penalty.  ``groups``: ``target``,
    ``grp`` (one row per target of the model); ``best``: keys, ``grp``, ``lam``.  A group without a penalty is an error."""
    wanted = scores.join(F.broadcast(groups), "target", "left").join(best.select(*keys, "grp", F.col("lam").alias("_lam")), [*keys, "grp"], "left")
    known = F.when(F.col("_lam").isNull(), F.raise_error(F.concat(F.lit("no penalty for group "), F.coalesce("grp", F.lit("?")))).cast("boolean")).otherwise(F.col("lam") == F.col("_lam"))
    return wanted.filter(known).drop("_lam")
