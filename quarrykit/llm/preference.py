"""Preference formatting, in DataFrame functions only.

A pair of conversations is split at its longest common prefix of turns. The prefix is rendered once, as the
prompt; what follows is rendered as the chosen and the rejected completion, with spans that say which of its
characters a model is trained on: those of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, of (role, text). Null roles are 'user', null
    texts empty; turns of equal number are ordered by role and text, null numbers first, and equal rows count once.
    A turn without conv_id is a conversation of its own, so that no group holds them all. A conversation of any length
    is one row, as what is made of it is."""
    each = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = each.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    single = each.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    return grouped.unionByName(single).select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """[start, end) of what is trained on: the text and the end mark of the assistant's turns."""
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    size = lambda t: F.length(t.role) + F.length(t.text) + head + tail
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc.at + size(t)).alias("at"),
        F.when(
            t.role == "assistant",
            F.concat(acc.spans, F.array(F.struct((acc.at + head + F.length(t.role)).alias("start"), (acc.at + size(t)).alias("end")))),
        ).otherwise(acc.spans).alias("spans"),
    )
    return F.aggregate(turns, zero, step).spans


def preference_format(pairs: DataFrame) -> DataFrame:
    """pairs: any columns with ``chosen`` and ``rejected``, arrays of (role, text). Adds shared_turns, prompt,
    chosen_completion, rejected_completion and their spans, in place of the two. Other columns stay, and repeated pairs
    get a row each.

    The prefix may be empty, and may be all of either conversation, whose completion is then empty."""
    rest = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    equal = F.zip_with(F.expr("slice(chosen, 1, least(size(chosen), size(rejected)))"), F.expr("slice(rejected, 1, least(size(chosen), size(rejected)))"), lambda a, b: (a.role == b.role) & (a.text == b.text))
    first = F.array_position(equal, False)
    cut = pairs.withColumn("__shared", F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int"))
    cut = cut.select(
        *rest,
        "__shared",
        F.expr("slice(chosen, 1, __shared)").alias("__prompt"),
        F.expr("slice(chosen, __shared + 1, size(chosen))").alias("__chosen"),
        F.expr("slice(rejected, __shared + 1, size(rejected))").alias("__rejected"),
    )
    return cut.select(
        *rest,
        F.col("__shared").alias("shared_turns"),
        _render(F.col("__prompt")).alias("prompt"),
        _render(F.col("__chosen")).alias("chosen_completion"),
        _render(F.col("__rejected")).alias("rejected_completion"),
        _spans(F.col("__chosen")).alias("chosen_spans"),
        _spans(F.col("__rejected")).alias("rejected_spans"),
    )


def pair_up(conversations: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): each conversation with the next, by conv_id, of those that
    open with the same turn; of the two the one with more assistant characters is chosen, on ties the first.
    The last of those, and a conversation that opens like no other, is paired with its own opening: all but
    its last assistant turn, which is rejected as an empty answer.

    Conversations are dealt by ranges of (opening, conv_id), so that any number may share an opening; each
    range looks to the first row of the next."""
    spark = conversations.sparkSession
    opening = F.xxhash64(F.expr("turns[0].role"), F.expr("turns[0].text"))
    keyed = conversations.where("size(turns) > 0").select(opening.alias("opening"), "conv_id", "turns")
    # written, so that the ranges stay as they are when a task is run again
    dealt = materialize(keyed.repartitionByRange(partitions(spark), "opening", "conv_id").withColumn("part", F.spark_partition_id()), "openings")
    order = Window.partitionBy("part").orderBy("opening", "conv_id")
    near = dealt.select("part", "opening", "conv_id", "turns", F.lead(F.struct("opening", "conv_id", "turns")).over(order).alias("next"))
    firsts = dealt.groupBy("part").agg(F.min(F.struct("opening", "conv_id", "turns")).alias("head"))
    heads = firsts.select(F.lag("part").over(Window.orderBy("part")).alias("part"), "head")  # one row for each range
    joined = near.join(heads.where("part is not null"), "part", "left").select("opening", "conv_id", "turns", F.coalesce("next", "head").alias("next"))
    told = lambda turns: F.aggregate(turns, F.lit(0), lambda n, t: n + F.when(t.role == "assistant", F.length(t.text)).otherwise(0))
    paired = joined.select("conv_id", "turns", F.when((F.col("next.opening") == F.col("opening")) & (F.expr("next.turns[0]") == F.expr("turns[0]")), F.col("next")).alias("next"))
    paired = paired.withColumn("first", F.col("next").isNull() | (told(F.col("turns")) >= told(F.col("next.turns"))))
    own, other = F.struct("conv_id", "turns"), F.struct(F.col("next.conv_id").alias("conv_id"), F.col("next.turns").alias("turns"))
    last = F.expr("coalesce(array_max(transform(turns, (t, i) -> if(t.role = 'assistant', i, null))), size(turns))")
    cut = F.struct(F.lit(None).cast("long").alias("conv_id"), F.slice("turns", F.lit(1), last).alias("turns"))
    chosen = F.when(F.col("first"), own).otherwise(other)
    rejected = F.when(F.col("next").isNull(), cut).when(F.col("first"), other).otherwise(own)
    return paired.select(chosen.alias("c"), rejected.alias("r")).select(
        F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.col("c.turns").alias("chosen"), F.col("r.turns").alias("rejected")
    )


def preferences(turns: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, shared_turns, prompt, completions and spans, one row for each conversation.

    A row without conv_id is a conversation of its own; see conversations_of for other nulls, ties and repeated rows.
    Conversations of any length are rendered whole. Other columns are ignored, whatever their names. Empty tables
    give no rows. rejected_id is null where a conversation has no partner."""
    return preference_format(pair_up(conversations_of(turns)))
