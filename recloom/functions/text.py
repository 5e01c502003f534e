"""Columns over paths, names, versions and JSON."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_part(path: Column, k: int) -> Column:
    """k-th part of a path, negative from the end, null beyond."""
    return F.try_element_at(F.split(path, "/"), F.lit(k))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def session_key(path: Column) -> Column:
    """lab/subject/date/number from lab/Subjects/subject/date/number/..., the number on three digits."""
    part = lambda k: F.regexp_extract(path, "([^/]+)/Subjects/([^/]+)/([^/]+)/([^/]+)", k)
    return F.when(path.rlike("[^/]+/Subjects/[^/]+/[^/]+/[^/]+"), F.concat_ws("/", part(1), part(2), part(3), F.lpad(part(4), 3, "0")))


def time_label(seconds: Column) -> Column:
    """T and the milliseconds on ten digits."""
    return F.concat(F.lit("T"), F.lpad(F.bround(seconds * 1000).cast("long").cast("string"), 10, "0"))


def from_time_label(label: Column) -> Column:
    return F.substring(label, 2, 20).cast("double") / 1000


def rebase(path: Column, old: str, new: str) -> Column:
    """another prefix, where the old one is there."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(path)


def version_parts(v: Column, width: int = 4) -> Column:
    """numbers of a dotted version, filled up with zeros; null if it is none."""
    nums = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    return F.when(v.rlike(r"^\d+(\.\d+)*$"), F.slice(F.concat(nums, F.array_repeat(F.lit(0), width)), 1, width))


def version_at_least(v: Column, least: str) -> Column:
    """false for missing or invalid versions."""
    want = [int(x) for x in least.split(".")]
    return F.coalesce(version_parts(v) >= F.array(*map(F.lit, (want + [0] * 4)[:4])), F.lit(False))


def status_case(done: Column, started: Column) -> Column:
    """F11."""
    return F.when(done, "Done").when(started, "Started").otherwise("Not started")


def with_prefix(m: Column, prefix: str) -> Column:
    """entries of a map whose key starts so."""
    return F.map_filter(m, lambda k, v: k.startswith(prefix))


def key_fields(key: Column, names: Sequence[str], between: str = "__") -> list[Column]:
    """the parts of a key, in order; a part that is not there is null."""
    parts = F.split(key, re.escape(between))
    return [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)]


def after(day: Column, default: str, by_kind: Mapping[str, str] | None = None, kind: Column | None = None) -> Column:
    """whether a date or its text is later than the day that holds for its kind; null for what is no date."""
    at = F.lit(default)
    for k, v in (by_kind or {}).items():
        at = F.when(kind == k, F.lit(v)).otherwise(at)
    return F.try_to_timestamp(day.cast("string")).cast("date") > at.cast("date")


def json_fields(text: Column, schema: str) -> Column:
    """fields of a JSON object as a struct; null for a missing, empty or broken text."""
    return F.when(F.trim(text) != "", F.from_json(text, schema))


def namespace(collection: Column, rules: Mapping[str, str | Column], default: str) -> Column:
    """the namespace of the first rule that holds: a prefix of the collection, or a column as a condition keyed by the
    namespace.  ``rules`` maps namespaces to either."""
    out = None
    for name, rule in rules.items():
        holds = collection.startswith(rule) if isinstance(rule, str) else rule
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit(default) if out is None else out.otherwise(default)


def plain_name(name: Column) -> Column:
    """F17."""
    return F.lower(name)
