"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A chat log often holds a conversation several times, each time a few turns longer. Rolling hashes of turn prefixes find
those: turn k of a conversation gets the hash of its first k turns. A conversation whose whole hash equals a longer
conversation's prefix hash of the same length is a snapshot of it, and an anti-join drops it; of equal conversations the
smallest id stays. Only what remains is rendered.

The rolling hash is the xor of one hash for each (position, role, text) over the turns so far, twice with different
seeds (128 bits): it needs one window sum and no text after the first projection, so texts move once, for rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: How a turn is rendered; fixed values of a widely used chat markup.
TURN_START, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"


def _content(df: DataFrame, role_col: str, text_col: str) -> list[Column]:
    """128 bits of a turn's role and text: all of a turn that the first shuffle carries."""
    role, text = text_of(df[role_col]), text_of(df[text_col])
    return [F.xxhash64(F.lit(seed), F.length(role), role, text).alias(f"_c{seed}") for seed in (1, 2)]


def prefixes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``_conv, _pos, _h1, _h2``; position from 1, hashes of the turns up to it."""
    turns = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), *_content(df, role_col, text_col))
    order = Window.partitionBy("_conv").orderBy(F.asc_nulls_first("_turn"), "_c1", "_c2")
    numbered = turns.withColumn("_pos", F.row_number().over(order).cast("long"))
    hashed = numbered.select("_conv", "_pos", F.xxhash64("_pos", "_c1", "_c2").alias("_t1"), F.xxhash64("_c2", "_c1", "_pos").alias("_t2"))
    upto = Window.partitionBy("_conv").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("_conv", "_pos", F.bit_xor("_t1").over(upto).alias("_h1"), F.bit_xor("_t2").over(upto).alias("_h2"))


def maximal(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``_conv, n_turns, n_copies`` of the conversations that are no proper prefix of another; n_copies counts equal ones."""
    turns = prefixes(df, conv_col, turn_col, role_col, text_col)
    last = turns.groupBy("_conv").agg(F.max(F.struct("_pos", "_h1", "_h2")).alias("_last"))
    whole = last.groupBy("_last").agg(F.min("_conv").alias("_conv"), F.count("*").alias("n_copies"))
    lengths = last.select("_conv", F.col("_last._pos").alias("_n"))
    proper = turns.join(lengths, turns["_conv"].eqNullSafe(lengths["_conv"]) & (turns["_pos"] < lengths["_n"]), "left_semi")
    proper = proper.select(F.struct("_pos", "_h1", "_h2").alias("_last")).distinct()
    return whole.join(proper, "_last", "left_anti").select("_conv", F.col("_last._pos").alias("n_turns"), "n_copies")


def render_maximal(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per retained conversation: ``conv_id, n_turns, n_copies, rendered``.

    Turns are in the order of their numbers, nulls first, those that share a number by their content's hash; gaps don't matter,
    and a repeated row is a turn of its own. Null roles and texts count as empty. Turns of a null conversation id are one
    conversation. An empty table gives no rows. Other columns are not read.
    """
    kept = maximal(df, conv_col, turn_col, role_col, text_col)
    turns = df.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), *_content(df, role_col, text_col), text_of(df[role_col]).alias("role"), text_of(df[text_col]).alias("text")).alias("_turn"))
    chosen = turns.join(kept, turns["conv_id"].eqNullSafe(kept["_conv"]), "inner")
    grouped = chosen.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.array_sort(F.collect_list("_turn")).alias("_turns"))
    lines = F.transform("_turns", lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit(ROLE_END), t["text"], F.lit(TURN_END)))
    return grouped.select("conv_id", "n_turns", "n_copies", F.concat_ws("", lines).alias("rendered"))
