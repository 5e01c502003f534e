"""Trials and behaviour traces of many sessions, and the encoding model's base regressors built from them.

Traces are long: keys, ``stream``, ``t``, ``v``, where a position that only one of time and value has is null in the other.
A grid is long as well: keys, ``i``, ``t`` with ``t = t0 + i * dt``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.operators import signal as sg

#: Regressors in the order of the design: name, its group, and what it is made of (time and weight of a trial, or a stream).
EVENT_REGRESSORS = [
    ("stimOn_on", "stimOn", "stimOn_times", None),
    ("stimOn_contrast", "stimOn", "stimOn_times", "contrast"),
    ("move_on", "move", "firstMovement_times", None),
    ("move_choice", "move", "firstMovement_times", "choice"),
    ("feedback_on", "feedback", "feedback_times", None),
    ("feedback_type", "feedback", "feedback_times", "feedbackType"),
]
STREAM_REGRESSORS = [("wheel_vel", "wheel"), ("wheel_speed", "wheel"), ("pupil", "pupil")]
NAMES = [name for name, *_ in EVENT_REGRESSORS] + [name for name, _ in STREAM_REGRESSORS]
STREAMS = ["wheel", "pupil"]


def finite(c: str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = F.col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def signed_difference(plus: str, minus: str) -> Column:
    """One column less another, missing values (null or NaN) as 0."""
    known = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return known(plus) - known(minus)


def trials(table: DataFrame, sessions: DataFrame, keys: Sequence[str], onset: str) -> DataFrame:
    """The trials of the wanted sessions, numbered by onset (``trial``, trials without an onset last), with the signed
    ``contrast`` of ``contrastRight`` and ``contrastLeft``.  A wanted session that has no trials is an error."""
    own = Window.partitionBy(*keys).orderBy(F.col(onset).asc_nulls_last(), *(c for c in table.columns if c not in keys))
    wanted = sessions.select(*keys).distinct()
    x = wanted.join(table.withColumn("_there", F.lit(True)), list(keys), "left")
    which = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    there = F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit("no trials of session "), which)).cast("boolean"))
    x = x.filter(there).drop("_there").withColumn("contrast", signed_difference("contrastRight", "contrastLeft"))
    return x.withColumn("trial", F.row_number().over(own) - 1)


def stream_flags(sessions: DataFrame, traces: DataFrame, keys: Sequence[str], streams: Sequence[str] = STREAMS, least: float = 0.5) -> DataFrame:
    """Per session and stream whether both times and values are there, are equally many, and at least ``least`` of
    the values finite.  A stream that a session lacks gives a row too, with False."""
    share = F.count_if(finite("v")) / F.count("*")
    seen = traces.groupBy(*keys, "stream").agg(F.count("t").alias("n"), ((F.count("t") > 0) & (F.count("t") == F.count("v")) & (share >= least)).alias("usable"))
    wanted = sessions.select(*keys).distinct().withColumn("stream", F.explode(F.array(*map(F.lit, streams))))
    return wanted.join(seen, [*keys, "stream"], "left").select(*keys, "stream", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("usable", F.lit(False)).alias("usable"))


def streams_in_use(flags: DataFrame, traces: DataFrame, grid: DataFrame, keys: Sequence[str], least: float = 0.8) -> DataFrame:
    """E2's gate: keys and streams that are usable and whose times span at least ``least`` of the grid's."""
    usable = flags.filter("usable").select(*keys, "stream")
    side = lambda d, by, a: d.groupBy(*by).agg(F.min("t").alias(f"{a}0"), F.max("t").alias(f"{a}1"))
    both = usable.join(side(traces, [*keys, "stream"], "s"), [*keys, "stream"]).join(side(grid, keys, "g"), list(keys))
    shared = F.greatest(F.lit(0.0), F.least("g1", "s1") - F.greatest("g0", "s0"))
    return both.filter((F.col("g1") > F.col("g0")) & (shared >= least * (F.col("g1") - F.col("g0")))).select(*keys, "stream")


def base_regressors(trials: DataFrame, traces: DataFrame, used: DataFrame, grid: DataFrame, keys: Sequence[str], t0: float, dt: float, width: float | None = None) -> DataFrame:
    """Every regressor at every sample of the grid: keys, ``name``, ``i``, ``v``.  Six come from the trials (an onset and
    a weighted copy for stimulus, movement and feedback), two more from the wheel and one from the pupil where ``used`` has
    the stream.  A trial without a finite time or weight adds nothing; a stream's missing values are interpolated over."""
    parts = [F.struct(F.lit(n).alias("name"), F.col(t).cast("double").alias("t"), (F.lit(1.0) if w is None else F.col(w).cast("double")).alias("w")) for n, _, t, w in EVENT_REGRESSORS]
    e = trials.select(*keys, F.inline(F.array(*parts))).filter(finite("t") & finite("w"))
    g = grid.select(*keys, "i").withColumn("name", F.explode(F.array(*(F.lit(n) for n, *_ in EVENT_REGRESSORS))))
    events = sg.event_to_grid(e, g, [*keys, "name"], "t", "w", t0, dt).select(*keys, "name", "i", F.col("w").alias("v"))
    # infinite values would spoil a whole recording's mean, so they count as missing
    samples = traces.join(used, [*keys, "stream"]).filter(finite("t")).select(*keys, "stream", "t", F.when(finite("v"), F.col("v")).alias("v"))
    x = sg.resample(samples, grid.select(*keys, "i", "t").join(used, list(keys)), [*keys, "stream"], width)
    of = lambda n, stream: F.when(F.col("stream") == stream, F.struct(F.lit(n).alias("name"), (F.abs("v") if n == "wheel_speed" else F.col("v")).alias("y")))
    x = x.select(*keys, "i", F.inline(F.array_compact(F.array(*(of(n, s) for n, s in STREAM_REGRESSORS)))))
    x = sg.zscore(x, [*keys, "name"], "y").select(*keys, "name", "i", F.col("z").alias("v"))
    return events.unionByName(x)


def regressor_table(used: DataFrame, sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E2's groups: keys, ``r`` (place in the session's own design), ``name``, ``grp``."""
    have = used.groupBy(*keys).agg(F.collect_set("stream").alias("_have"))
    every = [(n, g, None) for n, g, *_ in EVENT_REGRESSORS] + [(n, s, s) for n, s in STREAM_REGRESSORS]
    one = lambda n, g: F.struct(F.lit(n).alias("name"), F.lit(g).alias("grp"))
    parts = [one(n, g) if s is None else F.when(F.array_contains("_have", s), one(n, g)) for n, g, s in every]
    x = sessions.select(*keys).distinct().join(have, list(keys), "left")
    return x.select(*keys, F.posexplode(F.array_compact(F.array(*parts))).alias("r", "_c")).select(*keys, "r", "_c.*")


def design_columns(regressors: DataFrame, n_basis: int, keys: Sequence[str]) -> DataFrame:
    """The design's columns (``col``, ``name`` as regressor@bump, ``grp``) with the span (``first``, ``last``) of each group."""
    own = Window.partitionBy(*keys, "grp")
    x = regressors.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_basis - 1)))).withColumn("col", (F.col("r") * n_basis + F.col("k")).cast("long"))
    return x.select(*keys, "r", "k", F.concat("name", F.lit("@b"), F.col("k").cast("string")).alias("name"), "grp", "col", F.min("col").over(own).alias("first"), F.max("col").over(own).alias("last"))


def design_rows(base: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples as the fits take them: keys, ``i``, ``n``, ``x`` (regressors in the design's order), ``y``.  ``targets``: keys,
    ``i``, ``y``; several rows a sample, told apart by further columns, are several models over one design.  Samples are
    numbered from 0."""
    place = F.array_position(F.array(*map(F.lit, NAMES)), F.col("name"))
    x = base.groupBy(*keys, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("r"), "v"))), lambda s: s["v"]).alias("x"))
    ends = base.groupBy(*keys).agg(F.min("i").alias("_a"), (F.max("i") - F.min("i") + 1).alias("n"))
    return targets.join(x, [*keys, "i"]).join(ends, list(keys)).withColumn("i", F.col("i") - F.col("_a")).drop("_a")


def groups_by_size() -> dict[int, list[str]]:
    """Which groups a design of so many regressors has: streams are what makes the difference, and no two designs are of one size."""
    events, out = [g for _, g, *_ in EVENT_REGRESSORS], {}
    for have in ((), ("wheel",), ("pupil",), ("wheel", "pupil")):
        own = events + [s for _, s in STREAM_REGRESSORS if s in have]
        out[len(own)] = own
    return out
