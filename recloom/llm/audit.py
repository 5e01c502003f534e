"""Filter interaction audit by failing-id relations.

Each filter leaves one table of the ids that fail it.  With five filters there are 120 orders but only 32 sets of filters that
can have run before a step, so the joins are over sets, not orders:

* Survivors: each row that fails anything starts with the empty set; filter by filter it is doubled (without and with the
  filter in its set) and a left-anti join takes those with the filter in their set that are in its table.  What is left are the
  rows (set, id) that survive the set: 32 at most an id, after five joins on the id.
* Removals: a left-semi join of the survivors of each set without a filter with that filter's table; label losses are the
  marked rows among them.
* Redundancies: what fails a filter (what it removes after no other) less what it removes after the set; unique failures are
  what it removes after all others.

Rows that fail nothing (a left-anti join with all tables) survive every set and are only counted.  Orders are then read off
these counts, some 100 a part.

Edge cases: null and empty texts are texts of no words; a null source is the part of the empty string; rows without an id are
counted and filtered by themselves, as after all ids; rows that share an id are each counted, but fail what one of them
fails; labels that repeat count if one row says 1; an empty table gives an empty one, as there is no part; extra columns are
left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm.store import Scratch

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text: too few words, too repetitive, too many capitals, odd signs."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def keyed(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id``, ``key`` (never null), ``part``, ``digest`` of the text, and a flag per filter on one text."""
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.sha1(text.cast("binary"))))
    return docs.select("doc_id", key.alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), *(c.alias(f) for f, c in text_filters(text).items()))


def copies(rows: DataFrame) -> DataFrame:
    """``key`` of rows whose text a row with a smaller id has.  The keepers, one id per text, are joined by id as well as text, so
    that a large group of copies is no hot key."""
    keepers = rows.groupBy("digest").agg(F.min("doc_id").alias("keeper"))
    return rows.join(keepers, (rows["digest"] == keepers["digest"]) & rows["doc_id"].eqNullSafe(keepers["keeper"]), "left_anti").select("key")


def failing_tables(scratch: Scratch, rows: DataFrame, flags: list[str], more: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One stored table of distinct keys per filter: of the rows that it flags, or as given."""
    found = {f: rows.filter(F.col(f)).select("key") for f in flags} | more
    return {f: scratch.save(found[f].distinct(), f"fails-{f}") for f in sorted(found)}


def audit(scratch: Scratch, rows: DataFrame, fails: dict[str, DataFrame], losses: list[str]) -> DataFrame:
    """``rows`` (``key``, ``part`` and a boolean per name in ``losses``) under all orders of the filters in ``fails`` (single letters
    to tables of ``key``): a row per part, order and step."""
    letters = sorted(fails)
    bit = {f: 1 << i for i, f in enumerate(letters)}
    marks = [F.col(c).cast("long").alias(c) for c in losses]
    any_fail = fails[letters[0]]
    for f in letters[1:]:
        any_fail = any_fail.unionByName(fails[f])
    any_fail = scratch.save(any_fail.distinct(), "fails-any")
    clean = rows.join(any_fail, "key", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))

    live = rows.join(any_fail, "key", "left_semi").select("key", "part", *marks, F.lit(0).alias("before"))
    for f in letters:
        both = live.withColumn("before", F.explode(F.array(F.col("before"), F.col("before").bitwiseOR(bit[f]))))
        gone = fails[f].select(F.col("key").alias("id"))
        live = both.join(gone, (F.col("key") == F.col("id")) & (F.col("before").bitwiseAND(bit[f]) != 0), "left_anti")
    live = scratch.save(live, "survivors")

    sums = [F.count("*").alias("n"), *(F.sum(c).alias(c) for c in losses)]
    cells = live.groupBy("part", "before").agg(*sums).withColumn("letter", F.lit(""))
    for f in letters:
        removed = live.filter(F.col("before").bitwiseAND(bit[f]) == 0).join(fails[f], "key", "left_semi")
        cells = cells.unionByName(removed.groupBy("part", "before").agg(*sums).withColumn("letter", F.lit(f)))
    code = F.concat("letter", F.col("before").cast("string"))
    found = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(code, F.struct("n", *losses)))).alias("cells"))
    found = scratch.save(rows.select("part").distinct().join(clean, "part", "left").join(found, "part", "left"), "cells")
    return by_order(found, bit, losses)


def by_order(found: DataFrame, bit: dict[str, int], losses: list[str]) -> DataFrame:
    """From each part's ``clean`` count and ``cells`` (a few dozen counts by set, or by filter and set) to all orders."""
    letters = sorted(bit)
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))).alias("filter_order")
    at = found.select("part", "clean", "cells", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("i", "letter")).filter("letter != ''")
    bits = F.create_map(*(F.lit(x) for f in letters for x in (f, bit[f])))
    before = F.aggregate(F.filter(F.split(F.substring("filter_order", F.lit(1), F.col("i")), ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.element_at(bits, c))
    at = at.withColumn("before", before).withColumn("own", F.element_at(bits, F.col("letter")))

    def cell(letter: Column, of: Column, name: str = "n") -> Column:
        return F.coalesce(F.try_element_at("cells", F.concat(letter, of.cast("string")))[name], F.lit(0).cast("long"))

    letter, every = F.col("letter"), sum(bit.values())
    removed = cell(letter, F.col("before"))
    out = at.select(
        "part", "filter_order", (F.col("i") + 1).cast("int").alias("step"), "letter",
        (F.coalesce("clean", F.lit(0).cast("long")) + cell(F.lit(""), F.col("before") + F.col("own"))).alias("kept"), removed.alias("removed"),
        (cell(letter, F.lit(0)) - removed).alias("redundant"), cell(letter, F.lit(every) - F.col("own")).alias("unique_fails"), *(cell(letter, F.col("before"), c).alias(f"{c}_lost") for c in losses),
    )
    total = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(total, ["part", "letter"]).drop("letter")


def audit_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to D on one text and E on copies, with the losses of good (``quality`` 1) and toxic (``toxic`` 1) documents."""
    scratch = Scratch(spark, "audit")
    rows = scratch.save(keyed(docs), "rows")
    fails = failing_tables(scratch, rows, ["A", "B", "C", "D"], {"E": copies(rows)})
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    own = rows.select("doc_id", "key", "part").join(marked, "doc_id", "left").select("key", "part", *(F.coalesce(F.col(c) == 1, F.lit(False)).alias(name) for c, name in (("q", "good"), ("t", "toxic"))))
    return audit(scratch, scratch.save(own, "marked"), fails, ["good", "toxic"])
