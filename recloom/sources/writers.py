"""Sinks.  Spark's commit protocol publishes all or nothing; dynamic overwrite replaces only the keys that are written."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.functions.kernels import half_round_trip


def table(df: DataFrame, path: str) -> None:
    """K1, K3, K10."""
    df.write.mode("overwrite").parquet(path)


def by_key(df: DataFrame, path: str, keys: Sequence[str], done: DataFrame | None = None) -> None:
    """K2: a folder per key; keys in ``done`` are left as they are, and only folders of written keys are replaced."""
    if done is not None:
        df = df.join(done.select(*keys), list(keys), "left_anti")
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """K11."""
    df.write.mode("overwrite").option("header", True).csv(path)


def both_precisions(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """K5: a 32-bit table and one whose values went through 16 bits."""
    def run(frames):
        for f in frames:
            yield f.assign(**{c: [half_round_trip(v).tolist() for v in f[c]] for c in columns})

    df.write.mode("overwrite").parquet(f"{path}/float32")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/float32")  # so that the source runs once
    stored.mapInPandas(run, df.schema).write.mode("overwrite").parquet(f"{path}/float16")


def merged(frames: Sequence[DataFrame], names: DataFrame, key: str, new_key: str) -> DataFrame:
    """K6: shard tables as one, under new keys from a name map; keys without a new name are left out."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.join(names, key).drop(key).select(new_key, *[c for c in out.columns if c != key])


def annotated(df: DataFrame, notes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """K7: annotation columns joined on, and the rows (none, if all is well) in which another column changed."""
    out = df.join(notes.drop(*[c for c in notes.columns if c in df.columns and c != key]), key, "left")
    same = out.select(*df.columns)
    return out, df.exceptAll(same).unionByName(same.exceptAll(df))


def per_key(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], dict], schema: str) -> tuple[DataFrame, DataFrame]:
    """``fn`` per key; a key that fails becomes an error row and the others go on.  Returns results and errors."""
    kinds = dict(df.dtypes)
    names = [x.split()[0] for x in schema.split(",")]
    columns = [*names, "status", "error"]

    def begins(f: pd.DataFrame) -> np.ndarray:
        """Which rows, from the second on, have another key than the one before."""
        own = f[list(keys)]
        last = own.shift()
        return ~((own == last) | (own.isna() & last.isna())).all(axis=1).to_numpy()[1:]

    def one(f: pd.DataFrame) -> list:
        try:
            got = dict.fromkeys(names) | fn(f.reset_index(drop=True)) | {"status": "ok", "error": None}
        except Exception as e:  # noqa: BLE001  whatever a key's data raise is that key's error
            got = dict.fromkeys(names) | {"status": "failed", "error": f"{type(e).__name__}: {e}"}
        return [got[c] for c in columns]

    def results(f: pd.DataFrame) -> pd.DataFrame:
        """Of whole keys, which lie together."""
        edges = np.r_[0, np.flatnonzero(begins(f)) + 1, len(f)]
        rows = [one(f.iloc[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        found = {c: pd.Series(v, dtype=object).infer_objects() for c, v in zip(columns, zip(*rows, strict=True), strict=True)}
        return f[list(keys)].iloc[edges[:-1]].reset_index(drop=True).assign(**found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the key that may go on
        for f in frames:
            if not len(f):
                continue
            first = bool(held) and begins(pd.concat([held[-1].iloc[-1:], f.iloc[:1]]))[0]
            edges = np.flatnonzero(np.r_[first, begins(f)])
            if len(edges):
                if held or edges[0]:
                    yield results(pd.concat([*held, f.iloc[: edges[0]]], ignore_index=True))
                if edges[-1] > edges[0]:
                    yield results(f.iloc[edges[0] : edges[-1]])
                held, f = [], f.iloc[edges[-1] :]
            held.append(f)
        if held:
            yield results(pd.concat(held, ignore_index=True))

    # keys come sorted and are streamed; no group is made per key
    own = df.repartition(*keys).sortWithinPartitions(*keys)
    out = own.mapInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + schema + ", status string, error string")
    return out.filter("status = 'ok'").drop("status", "error"), out.filter("status != 'ok'").select(*keys, "status", "error")


def run_settings(spark: SparkSession, path: str, numbers: Mapping[str, float], lists: Mapping[str, Sequence[str]], basis: DataFrame) -> None:
    """K8: what all results of a run share, once: one row of settings (``numbers`` and ``lists`` as maps) and the lag basis."""
    as_map = lambda m, of: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), of(v))))
    row = spark.range(1).select(as_map(numbers, F.lit).alias("numbers"), as_map(lists, lambda v: F.array(*map(F.lit, v))).alias("lists"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    basis.coalesce(1).write.mode("overwrite").parquet(f"{path}/basis")
