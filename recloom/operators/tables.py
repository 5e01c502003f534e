"""Table work: keyed joins, guards, patches and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that keeps the left side's columns where names clash."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), list(keys), "left")


def outer_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer joins in a row on one key; columns that clash get the suffixes _x and _y."""
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        both = [c for c in a.columns if c in b.columns and c not in keys]
        for c in both:
            a, b = a.withColumnRenamed(c, f"{c}_x"), b.withColumnRenamed(c, f"{c}_y")
        return a.join(b, list(keys), "full")

    return reduce(two, frames)


def strict_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Lookup that fails while it runs, if a key is not found."""
    found = df.join(table.withColumn("_found", F.lit(True)), key, "left")
    ok = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return found.filter(ok).drop("_found")


def settings_of(df: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """Rows with the settings of their kind; a kind without any is an error while it runs.  Spark broadcasts the settings if
    they are as small as a table that a person wrote down."""
    return strict_lookup(df, settings, key)


def fallback(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All rows of the preferred source, and of the other one for keys that the first lacks."""
    return preferred.withColumn("priority", F.lit(0)).unionByName(other.join(preferred.select(key).distinct(), key, "left_anti").withColumn("priority", F.lit(1)))


def identity_guard(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key set how many rows of two versions disagree (missing on one side, or another value)."""
    x, y = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    bad = F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return x.join(y, list(keys), "full").withColumn("_bad", bad)


def patch_columns(df: DataFrame, new: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """K4: columns that start with ``prefix`` are dropped and those of ``new`` joined; all else stays."""
    gone = [c for c in df.columns if c.startswith(prefix)]
    return df.drop(*gone).join(new, list(keys), "left")


def reconcile(copies: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row per key whose copies differ or are missing somewhere."""
    frames = [d.select(key, F.col(value).alias(n)) for n, d in copies.items()]
    out = reduce(lambda a, b: a.join(b, key, "full"), frames)
    names = list(copies)
    same = reduce(lambda a, b: a & b, [F.col(names[0]).eqNullSafe(F.col(n)) for n in names[1:]])
    return out.filter(~same)


def search_path(keys: DataFrame, listing: DataFrame, key: str, path: str, priority: str) -> DataFrame:
    """The existing location that comes first in the search order; null if there is none."""
    best = listing.groupBy(key).agg(F.min(F.struct(priority, path)).alias("_best"))
    return keys.join(best, key, "left").select(*keys.columns, F.col(f"_best.{path}").alias(path))


def position_join(points: DataFrame, table: DataFrame, key: str, axes: Sequence[str], min_rate: float, default: dict) -> DataFrame:
    """Equality join on integer coordinates after moving ``table`` by the difference of medians per axis, rounded half
    to even.  Of rows on one position the last (by ``order``) counts; keys under ``min_rate`` matches are left out;
    unmatched points get defaults."""
    med = lambda d, n: d.groupBy(key).agg(*(F.median(a).alias(f"_{n}{a}") for a in axes))
    shift = med(points, "p").join(med(table, "t"), key).select(key, *(F.bround(F.col(f"_p{a}") - F.col(f"_t{a}")).cast("long").alias(f"_s{a}") for a in axes))
    moved = table.join(shift, key).withColumns({a: F.bround(a).cast("long") + F.col(f"_s{a}") for a in axes}).drop(*(f"_s{a}" for a in axes))
    last = Window.partitionBy(key, *axes).orderBy(F.col("order").desc())
    moved = moved.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "order")
    out = points.withColumns({a: F.bround(a).cast("long") for a in axes}).join(moved.withColumn("_hit", F.lit(1)), [key, *axes], "left")
    rate = F.avg(F.coalesce("_hit", F.lit(0))).over(Window.partitionBy(key))
    out = out.withColumn("_rate", rate).filter(F.col("_rate") >= min_rate)
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()}).withColumn("matched", F.col("_hit").isNotNull()).drop("_hit", "_rate")


def common_grid(signal: DataFrame, grid: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Both cut to the shorter; with ``strict`` unequal lengths are an error."""
    if strict:
        out = signal.withColumn("_s", F.lit(1)).join(grid.withColumn("_g", F.lit(1)), list(keys), "full")
        fine = F.when(F.col("_s").isNull() | F.col("_g").isNull(), F.raise_error(F.lit("signal and grid differ in length")).cast("boolean")).otherwise(True)
        return out.filter(fine).drop("_s", "_g")
    return signal.join(grid, list(keys))


def by_suffix(df: DataFrame, suffix: str, name: str) -> DataFrame:
    """The first column whose name ends so, as ``name``; a null column if there is none."""
    got = [c for c in df.columns if c.endswith(suffix)]
    return df.withColumn(name, F.col(got[0]) if got else F.lit(None).cast("double"))


def map_lookup(key: Column, values: dict) -> Column:
    """Value of a key in a small dict, null when absent."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key] if values else F.lit(None)


def tier_differences(scores: DataFrame, tier: str, keys: Sequence[str], values: Sequence[str], base: str) -> DataFrame:
    """Per key the difference of each value to the tier ``base``."""
    b = scores.filter(F.col(tier) == base).select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    return scores.filter(F.col(tier) != base).join(b, list(keys)).select(*keys, tier, *((F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values))


def rows_sorted(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The rows of each key as one sorted array; for keys with few rows."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def merged_units(spikes: DataFrame, clusters: DataFrame, channels: DataFrame, keys: Sequence[str], cluster: str, channel: str) -> DataFrame:
    """One row per unit that fired: its ``spike_count``, then what its cluster and its cluster's channel have; a unit that
    lacks either keeps nulls.  ``clusters`` holds each cluster's ``channel``."""
    out = spikes.groupBy(*keys, cluster).agg(F.count("*").alias("spike_count"))
    return left_by_key(left_by_key(out, clusters, [*keys, cluster]), channels, [*keys, channel])


def attribute_of_unit(spikes: DataFrame, clusters: DataFrame, channels: DataFrame, keys: Sequence[str], cluster: str, channel: str) -> DataFrame:
    """Every event with what its unit's channel has; events of a unit that no table knows are left out."""
    return spikes.join(clusters, [*keys, cluster]).join(channels, [*keys, channel])


def with_bands(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Every row once per band, with its ``band_index`` and ``band``; the bands lie beside the row, so nothing is joined."""
    return df.select("*", F.posexplode(F.array(*map(F.lit, bands))).alias("band_index", "band"))


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns by name, repeats included; a column that one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Every value of ``key`` that any of them has, once; null counts as a value."""
    return union_rows([f.select(key) for f in frames]).distinct()


def keys_without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``key`` that ``other`` lacks; null equals null."""
    return df.select(key).subtract(other.select(key))


def reshaped(df: DataFrame, names: dict[str, str] | None = None, prefixes: Sequence[str] = (), present: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Columns renamed; those that begin with a prefix dropped, and those that ``present`` has already, but for ``keys``."""
    out = df.withColumnsRenamed(names or {})
    gone = [c for c in out.columns if c.startswith(tuple(prefixes))] if prefixes else []
    gone += [c for c in out.columns if present is not None and c in present.columns and c not in keys]
    return out.drop(*gone)


def keyed(df: DataFrame, **keys) -> DataFrame:
    """Constant or derived key columns in front; one of the name is replaced."""
    cols = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in keys.items()]
    return df.select(*cols, *[c for c in df.columns if c not in keys])


def repository_folders(files: DataFrame, repositories: DataFrame, repository: str, root: str, path: str, folder: str = "folder") -> DataFrame:
    """Of every file the folder it lies in, below its repository's root; null for an unknown repository."""
    x = files.join(repositories.select(repository, root), repository, "left")
    return x.withColumn(folder, F.regexp_replace(F.concat(F.col(root), F.lit("/"), F.col(path)), "/[^/]*$", "")).drop(root)


def first_with_ending(df: DataFrame, keys: Sequence[str], path: str, ending: str) -> DataFrame:
    """the first path, in order of text, that ends so; keys without one are left out."""
    return df.filter(F.col(path).endswith(ending)).groupBy(*keys).agg(F.min(path).alias(path))


def siblings(df: DataFrame, path: str) -> DataFrame:
    """paths that differ in their last ending alone, as one sorted list per ``stem``."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return df.groupBy(stem.alias("stem")).agg(F.sort_array(F.collect_list(path)).alias("files"))


def spread(df: DataFrame, keys: Sequence[str], rows: int, most: int = 1 << 18) -> DataFrame:
    """Dealt by keys over partitions of about ``most`` of the ``rows``, one per core at least.  As their number is stated, Spark
    doesn't put them together again, so what a task sorts or sums up stays the same as tables grow."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)
