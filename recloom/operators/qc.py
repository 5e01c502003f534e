"""Quality summaries of recordings, their chunks and their channels.  All are plain aggregates with map-side combining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.sources import scratch


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN to NULL at ingest, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def cell_of(v: Column, cells: int) -> Column:
    """A whole number that doesn't fall as ``v`` rises: ``cells`` steps a factor of e, mirrored for negative values."""
    size = F.greatest(F.ln(F.abs(v)), F.lit(-750.0))
    step = (F.least(F.floor(size * cells), F.lit(750 * cells)) + 751 * cells).cast("long")
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0).cast("long"))


def value_counts(long: DataFrame, by: Sequence[str], value: str, cells: int = 4096) -> DataFrame:
    """The stored table that quantiles are read from: ``by``, ``v``, ``c`` (rows with that value) and ``cell``.  Missing values
    are kept as one null; values are counted before the shuffle."""
    v = F.col(value).cast("double")
    counts = long.select(*by, F.when(~F.isnan(v), v).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("c"))
    counts = counts.withColumn("cell", cell_of(F.col("v"), cells))
    path = scratch.folder(long.sparkSession, "counts")
    counts.write.parquet(path)
    return long.sparkSession.read.schema(counts.schema).parquet(path)


def quantiles_of(counts: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``by`` and ``q``, an array of the exact quantiles (linear between neighbours) at ``probs``; groups without a value are
    left out.  Sums per cell tell which cells hold the wanted ranks, and only these cells are sorted, each by itself."""
    counts = counts.filter("v is not null").select(F.struct(*by).alias("_k"), "v", "c", "cell")
    own = Window.partitionBy("_k")
    sizes = counts.groupBy("_k", "cell").agg(F.sum("c").alias("c"))
    sizes = sizes.withColumns({"n": F.sum("c").over(own), "upto": F.sum("c").over(own.orderBy("cell"))})
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(probs)))
    ends = F.filter(F.transform(ranks, lambda w: F.struct(w["i"].alias("i"), w["at"].alias("at"), F.floor(w["at"]).alias("r0"), F.ceil(w["at"]).alias("r1"))), lambda w: (w["r1"] >= F.col("upto") - F.col("c")) & (w["r0"] < F.col("upto")))
    wanted = sizes.withColumn("ws", ends).filter(F.size("ws") > 0)
    wanted = wanted.select(F.col("_k").alias("_w"), F.col("cell").alias("_cell"), (F.col("upto") - F.col("c")).alias("before"), "ws")
    hit = counts.join(wanted, F.col("_k").eqNullSafe(F.col("_w")) & (F.col("cell") == F.col("_cell")))
    hit = hit.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("_k", "cell").orderBy("v")))
    hit = hit.select("_k", "v", (F.col("upto") - F.col("c")).alias("from"), "upto", F.explode("ws").alias("w"))
    at = lambda r: F.max(F.when((F.col("from") <= F.col(r)) & (F.col(r) < F.col("upto")), F.col("v")))
    part = F.first("w.at") - F.floor(F.first("w.at"))
    one = hit.groupBy("_k", F.col("w.i").alias("i")).agg((at("w.r0") * (1 - part) + at("w.r1") * part).alias("x"))
    out = one.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("q"))
    return out.select(*(F.col("_k")[k].alias(k) for k in by), "q")


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], cells: int = 4096) -> DataFrame:
    """Exact quantiles of one column (see ``quantiles_of``); missing values are left out.  Made for a few large groups."""
    return quantiles_of(value_counts(df, by, value, cells), by, probs)


def label_counts(df: DataFrame, keys: Sequence[str], label: str, names: dict, good) -> DataFrame:
    """A1: rows per key with each label, and those whose label is not ``good``; counts are 0, never missing."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col(label) == v).alias(f"n_{k}") for k, v in names.items()), F.count_if(F.col(label) != good).alias("n_bad"))


def chunk_summary(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A4: mean, median and maximum of each measure per key, and the number of chunks."""
    aggs = [f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("median", F.median), ("max", F.max))]
    return df.groupBy(*keys).agg(F.count("*").alias("n_chunks"), *aggs)


def interval_summary(df: DataFrame, keys: Sequence[str], start: str, end: str, fs: Column) -> DataFrame:
    """A5: number and total length in seconds of half-open sample intervals."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.sum(F.try_divide(F.col(end) - F.col(start), fs)).alias("seconds"))


def ratio(a: Column, b: Column) -> Column:
    """A / b, missing where b is 0."""
    return F.when(b != 0, a / b)


def pass_summary(df: DataFrame, by: str, key: str, per_row: Sequence[str], per_key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Medians and maxima per pass; ``per_row`` measures use all rows, ``per_key`` ones a row per recording.  The rows are
    read once, into counts per pass, measure and value; all that is told comes from these."""
    first = F.row_number().over(Window.partitionBy(by, key).orderBy(*order)) == 1
    cells = [(f"rows {m}", F.lit(True), m) for m in per_row] + [(f"once {m}", F.col("_first"), m) for m in per_key]
    cells += [("rows", F.lit(True), None), ("once", F.col("_first"), None)]
    cell = lambda name, on, m: F.when(on, F.struct(F.lit(name).alias("measure"), (F.lit(None) if m is None else F.col(m)).cast("double").alias("v")))
    long = df.withColumn("_first", first).select(by, F.inline(F.array_compact(F.array(*(cell(*c) for c in cells)))))
    counts = value_counts(long, [by, "measure"], "v")
    sums = counts.groupBy(by, "measure").agg(F.sum("c").alias("n"), F.max("v").alias("top"))
    q = quantiles_of(counts, [by, "measure"], [0.5]).select(F.col(by).alias("_by"), F.col("measure").alias("_m"), F.col("q")[0].alias("mid"))
    x = sums.join(q, F.col(by).eqNullSafe(F.col("_by")) & (F.col("measure") == F.col("_m")), "left")
    of = lambda value, name, as_: F.max(F.when(F.col("measure") == name, F.col(value))).alias(as_)
    each = [of(value, f"{kind} {m}", f"{m}_{as_}") for kind, ms in (("rows", per_row), ("once", per_key)) for m in ms for value, as_ in (("top", "max"), ("mid", "median"))]
    return x.groupBy(by).agg(of("n", "rows", "n_rows"), of("n", "once", "n_keys"), *each)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns))


def histogram(df: DataFrame, value: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` bins of equal width between the column's minimum and maximum, the last one closed."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row: the broadcast is of fixed size
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(*by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """Quartiles per label and measure, after unpivoting; the ends come from the same counts."""
    counts = value_counts(df.select(by, *measures).unpivot([by], list(measures), "measure", "v"), [by, "measure"], "v")
    ends = counts.groupBy(by, "measure").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    q = quantiles_of(counts, [by, "measure"], [0.25, 0.5, 0.75]).select(F.col(by).alias("_by"), F.col("measure").alias("_m"), "q")
    q = ends.join(q, F.col(by).eqNullSafe(F.col("_by")) & (F.col("measure") == F.col("_m")), "left")
    return q.select(by, "measure", "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "hi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes first in a stated order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def status_counts(df: DataFrame, status: str, deviation: str | None = None) -> DataFrame:
    """Rows per status, with the worst deviation if there is one."""
    return df.groupBy(status).agg(F.count("*").alias("n"), *([F.max(F.abs(deviation)).alias("worst")] if deviation else []))


def run_time_stats(df: DataFrame, by: str, seconds: str) -> DataFrame:
    """Mean, median and number of run times; zero and missing ones are skipped."""
    counts = value_counts(df.filter(F.col(seconds) != 0), [by], seconds).filter("v is not null")
    out = counts.groupBy(by).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_s"), F.sum("c").alias("n"))
    q = quantiles_of(counts, [by], [0.5]).select(F.col(by).alias("_by"), F.col("q")[0].alias("median_s"))
    return out.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "mean_s", "median_s", "n")


def progress_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Products per subject and step."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_products"))


def completeness(df: DataFrame, key: str, present: dict[str, Column]) -> DataFrame:
    """Per key whether each product is present in all its rows, and whether all are."""
    out = df.groupBy(key).agg(*(F.bool_and(c).alias(k) for k, c in present.items()))
    every = F.lit(True)
    for k in present:
        every = every & F.col(k)
    return out.withColumn("complete", every)


def unit_rates(spikes: DataFrame, unit: Sequence[str], seconds: float | Column) -> DataFrame:
    """Events of each unit and their number a second; a recording of no length has no rate.  A column of seconds must be
    one value per unit."""
    d = F.first(seconds) if isinstance(seconds, Column) else F.lit(float(seconds))
    return spikes.groupBy(*unit).agg(F.count("*").alias("spike_count"), F.try_divide(F.count("*"), d).alias("firing_rate"))


def unit_counts(units: DataFrame, keys: Sequence[str], good: Column) -> DataFrame:
    """All units of each recording and the good ones; an unknown quality is not good."""
    return units.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.count_if(good).alias("n_good"))
