"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line feed.  Inside texts ``\\`` becomes ``\\s``, ``###`` ``\\h`` and
``</turn>`` ``\\e`` (in roles also ``:`` ``\\c``), so a text can neither close nor open a turn, and three replacements
give it back.  Every assistant turn makes an example of its own: all turns before it as context, then its head, its text
and the end mark, with ``loss_start`` (0-based, code points) and ``loss_chars`` around that text alone.  What follows the
last assistant turn, or a conversation without one, is an example without loss.

Edge cases: null texts and roles are empty; turns that tie are ordered by role and text, repeated rows are repeated turns;
a row without conv_id is a conversation of its own (``lone`` numbers these); an empty table gives no examples; extra columns are left out.  A conversation is
one row while it is expanded, as its digest is of all its turns in order; the examples of one are made one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(c: Column) -> Column:
    for raw, code in (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in (("</turn>", "\\e"), ("###", "\\h"), (":", "\\c"), ("\\", "\\s")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def expand(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` to one row per example: ``conv_id``, ``lone``, ``example`` (from 0), ``is_last``,
    ``formatted``, ``loss_start``, ``loss_chars`` (escaped code points; 0 for the rest without a reply)."""
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    rows = turns.select("conv_id", lone, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda t: F.concat(F.lit("### "), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
    conv = conv.select("conv_id", "lone", F.transform("t", lambda t: F.struct((t["role"] == "assistant").alias("reply"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("t"))
    at = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["reply"])
    conv = conv.withColumn("at", at)
    rest = F.when(F.element_at("t", -1)["reply"], F.array().cast("array<int>")).otherwise(F.array(F.size("t")))
    conv = conv.withColumn("at", F.concat("at", rest))
    conv = conv.select("conv_id", "lone", "t", F.size("at").alias("k"), F.posexplode("at").alias("example", "i"))
    own = F.element_at("t", F.col("i"))
    conv = conv.select("conv_id", "lone", "example", (F.col("example") + 1 == F.col("k")).alias("is_last"), own.alias("own"), F.array_join(F.transform(F.slice("t", F.lit(1), F.col("i") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("context"))
    return conv.select(
        "conv_id", "lone", "example", "is_last", F.concat("context", "own.head", "own.body", F.lit(END)).alias("formatted"),
        F.when(F.col("own.reply"), F.length("context") + F.length("own.head")).otherwise(0).alias("loss_start"),
        F.when(F.col("own.reply"), F.length("own.body")).otherwise(0).alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples' formatted text alone: number and digest of its turns, size and digest of what
    the loss masks select, and all formatted characters."""
    loss = unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_chars")))
    rows = examples.select("conv_id", "lone", "example", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"), F.when(F.col("is_last"), F.col("formatted")).alias("whole"))
    conv = rows.groupBy("conv_id", "lone").agg(F.sum("chars").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.max("whole").alias("whole"))
    turns = F.filter(F.split("whole", "</turn>\n", -1), lambda s: s != "")

    def turn(s: Column) -> Column:
        colon = F.instr(s, ": ")
        role = unescape(s.substr(F.lit(5), colon - 5))
        return F.concat(role, F.lit("\n"), unescape(s.substr(colon + 2, F.length(s))), F.lit("\n"))

    conv = conv.withColumn("turns", turns)
    return conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
