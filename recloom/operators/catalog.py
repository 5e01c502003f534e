"""Selection of recordings, triage of what to run again, and the state of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.sources.scratch import folder


def keep_not_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose value differs, missing ones included."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Without the listed keys (a list that a person wrote down); rows without a key stay."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def text_match(column: str, prefix: str | None = None, suffix: str | None = None, part: str | None = None) -> Column:
    """P5: starts, ends, contains, without regard to case."""
    c, out = F.lower(column), F.lit(True)
    for f, v in ((c.startswith, prefix), (c.endswith, suffix), (c.contains, part)):
        out = out & f(v.lower()) if v is not None else out
    return out


def named_ranges(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row per subset that a row belongs to: ``early`` (<= low), ``late`` (>= high), ``all``; one scan."""
    tags = F.array(F.when(F.col(column) <= low, F.lit("early")), F.when(F.col(column) >= high, F.lit("late")), F.lit("all"))
    return df.withColumn("subset", F.explode(F.array_compact(tags)))


def every_nth(df: DataFrame, order: str, n: int, k: int) -> DataFrame:
    """Every n-th key from the k-th in order.  The rank comes from counts per range of keys, not from one task: keys
    are numbered inside range partitions, whose bases are a running sum over one number per partition."""
    return ranked(df, order).filter(F.col("rank") % n == k).drop("rank")


def ranked(df: DataFrame, order: str) -> DataFrame:
    """Rank from 0 in the total order of a unique key, without a window over all rows.  The range partitions are written
    once, with each row's place in its own, so that counting and joining see the same ones whatever runs again."""
    spark = df.sparkSession
    path = folder(spark, "ranked")
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    parts = parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return parts.join(F.broadcast(base.select("_part", "_base")), "_part").withColumn("rank", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(*order).limit(n)


def first_n_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """All rows of the first n groups; the groups are n values, so their join is a broadcast of fixed size."""
    return df.join(F.broadcast(df.select(group).distinct().orderBy(group).limit(n)), group, "left_semi")


def group_flags(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """A2: whether any row of the group has each property."""
    return df.groupBy(*keys).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()))


def count_equals(df: DataFrame, keys: Sequence[str], match: Column, n: int, name: Column | None = None) -> DataFrame:
    """A3: whether exactly n rows of the group match; with ``name``, whether n distinct names do."""
    c = F.count_if(match) if name is None else F.count_distinct(F.when(match, name))
    return df.groupBy(*keys).agg(F.count_if(match).alias("n_matches"), (c == n).alias("has_all"))


def check_skip(df: DataFrame, key: str, collection: str, name: str, ok: Column, n_names: int) -> DataFrame:
    """Any good row per (collection, name), then all of them per key, with the required number of names."""
    per = df.groupBy(key, collection, name).agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("ok"))
    return per.groupBy(key).agg((F.bool_and("ok") & (F.count_distinct(name) == n_names)).alias("skip"))


def todo(has: Column, *done: Column) -> Column:
    """F16: there is something to do unless one of the alternatives is done; missing flags are false."""
    out = F.lit(False)
    for d in done:
        out = out | F.coalesce(d, F.lit(False))
    return F.coalesce(has, F.lit(False)) & ~out


def missing_keys(expected: DataFrame, ready: DataFrame, key: str) -> DataFrame:
    """Keys of ``expected`` that ``ready`` lacks."""
    return expected.join(ready.select(key), key, "left_anti")


def ready_keys(expected: DataFrame, ready: DataFrame, key: str) -> DataFrame:
    """Keys in both."""
    return expected.join(ready.select(key), key, "left_semi")


def incomplete(manifest: DataFrame, key: str, product: str, done: str) -> DataFrame:
    """Keys with some product but without the completion mark."""
    return manifest.groupBy(key).agg(F.bool_or(F.col(product) == done).alias("done"), F.count("*").alias("n_products")).filter("not done").drop("done")


def superset_keys(df: DataFrame, key: str, name: str, required: Sequence[str]) -> DataFrame:
    """U4: keys that have every required name (relational division); only required names are gathered."""
    have = df.filter(F.col(name).isin(list(required))).groupBy(key).agg(F.count_distinct(name).alias("k"))
    return have.filter(F.col("k") == len(set(required))).select(key)


def newer_wins(old: DataFrame, new: DataFrame, key: str, when: str) -> DataFrame:
    """Union of two states, the latest row per key; at a tie the new state's."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy(key).orderBy(F.col(when).desc_nulls_last(), F.col("_from").desc())
    return both.withColumn("_rn", F.row_number().over(own)).filter("_rn = 1").drop("_rn", "_from")


def time_estimate(df: DataFrame, group: str, seconds_each: float, processes: int) -> DataFrame:
    """A10: rows, groups and the estimated duration as text."""
    out = df.agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"))
    return out.withColumn("estimate", duration_text(F.col("n") * seconds_each / processes))


def duration_text(seconds: Column) -> Column:
    """F8: H:MM:SS, fractions cut off."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def session_grid(sessions: DataFrame, blocks: int, block: int) -> DataFrame:
    """Sessions x pseudo-session blocks: in the first block -1 (the real session) comes before the pseudo ids."""
    ids = F.sequence(F.col("blk") * block, F.col("blk") * block + block - 1)
    out = sessions.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return out.withColumn("pseudo_id", F.explode(F.when(F.col("blk") == 0, F.concat(F.array(F.lit(-1)), ids)).otherwise(ids)))


def window_grid(recordings: DataFrame, starts: Sequence[int]) -> DataFrame:
    """Recordings x fixed start times, with the index of each."""
    return recordings.select("*", F.posexplode(F.array(*map(F.lit, starts))).alias("snippet_index", "t_start"))


def catalogue(df: DataFrame, exists: str | None = None, **terms) -> DataFrame:
    """Rows that meet all terms, given as ``column__rule=value`` or ``column=value``.  Rules: ``startswith``, ``endswith``,
    ``contains`` (all without regard to case), ``in``, ``gte``, ``lte``, ``isnull``.  ``exists`` names a flag that must be
    true.  Terms are plain predicates that reach the scan; an unknown rule or column is an error."""
    rules = {
        "startswith": lambda c, v: text_match(c, prefix=v), "endswith": lambda c, v: text_match(c, suffix=v), "contains": lambda c, v: text_match(c, part=v),
        "in": lambda c, v: F.col(c).isin(list(v)), "gte": lambda c, v: F.col(c) >= v, "lte": lambda c, v: F.col(c) <= v,
        "isnull": lambda c, v: F.col(c).isNull() if v else F.col(c).isNotNull(), "": lambda c, v: F.col(c) == v,
    }
    out = df.filter(F.col(exists)) if exists else df
    for term, value in terms.items():
        column, rule = (term, "") if term in df.columns else (term.rpartition("__")[0], term.rpartition("__")[2])
        if column not in df.columns or rule not in rules:
            raise ValueError(f"no such term: {term}")
        out = out.filter(rules[rule](column, value))
    return out


def frozen(df: DataFrame, freeze: str | None, label: str = "freeze", member: str | None = None) -> DataFrame:
    """Recordings of one freeze of the catalogue, or with ``member`` those whose flag of that name is true; with neither
    all of them.  A missing flag is no member."""
    out = df if freeze is None else df.filter(F.col(label) == freeze)
    return out if member is None else out.filter(F.coalesce(F.col(member).cast("boolean"), F.lit(False)))


def select_keys(df: DataFrame, key: str, only: Sequence | None = None, n: int | None = None) -> DataFrame:
    """The listed keys where a list (that a person wrote down) is given, whatever else would be selected; of what is left
    the first ``n`` in order of the key."""
    out = df if only is None else df.filter(F.col(key).isin(list(only)))
    return out if n is None else out.orderBy(key).limit(n)


def merged_state(old: DataFrame, new: DataFrame, key: str, at: str, removed: DataFrame | None = None, wanted: DataFrame | None = None, status: str = "status", done: str = "done") -> tuple[DataFrame, DataFrame]:
    """The state of runs after ``new`` came in, the latest row of ``at`` per key (the new one at a tie) and without
    ``removed`` keys, and the run list: ``wanted`` keys (all of the state's without it) that are not done."""
    state = newer_wins(old, new, key, at)
    state = state if removed is None else state.join(removed.select(key), key, "left_anti")
    keys = (state if wanted is None else wanted).select(key).distinct()
    return state, keys.join(state.filter(F.col(status).eqNullSafe(F.lit(done))).select(key), key, "left_anti")


def good_units(df: DataFrame, failed: str = "bitwise_fail", good=0) -> DataFrame:
    """Rows whose quality mark is the good one; a missing mark is not good."""
    return df.filter(F.col(failed) == good)


def revision_choice(df: DataFrame, keys: Sequence[str], path: str, folders: Sequence[str], present: str, otherwise: str) -> DataFrame:
    """per key ``revision``: ``present`` if one of its paths has one of ``folders`` in it, else ``otherwise``."""
    has = F.lit(False)
    for f in folders:
        has = has | F.coalesce(F.col(path).contains(f), F.lit(False))
    return df.groupBy(*keys).agg(F.when(F.bool_or(has), F.lit(present)).otherwise(F.lit(otherwise)).alias("revision"))
