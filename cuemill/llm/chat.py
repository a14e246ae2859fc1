"""Chat formatting: every participant's view of a dialogue (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Turns numbered alike up to this many form a chunk; offsets are summed over chunks, then inside them.
CHUNK = 64
SYSTEM = "system"


def escaped(text: Column) -> Column:
    r"""``<|`` becomes ``<\|``, and ``<\`` becomes ``<\\``, so that a text can't hold a mark and reads back as it was."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def _name(role: Column) -> Column:
    """A name can't end its mark either."""
    return F.replace(F.replace(escaped(role), F.lit("|\\"), F.lit("|\\\\")), F.lit("|>"), F.lit("|\\>"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per participant's view and turn: conv_id, perspective, turn, role, rendered, char_start, char_end, mask_start, mask_end.

    For each participant (each role of the dialogue but ``system``) the dialogue
    is rendered with that speaker as the assistant, the system turns as such,
    and everyone else as a user with a name::

        <|assistant|>\\ntext<|end|>\\n      <|user:name|>\\ntext<|end|>\\n

    A view is its rows' ``rendered`` in order; ``char_start`` and ``char_end``
    place each row in it (characters).  What looks like a mark in a text or a
    name is :func:`escaped`.  The mask, for the loss, covers the
    assistant's text and end mark; it is null for other speakers.

    Turns are in order of turn, role, text (nulls first); a null text is empty, a
    null role is a nameless speaker.  Rows that repeat are turns each; an empty
    table gives no rows; other columns are ignored, whatever their names.  A
    dialogue of system turns alone has no view.  Offsets are running sums in two
    steps, over chunks of turn numbers and inside a chunk, so a dialogue with a
    third of all rows isn't sorted in one task, and no dialogue is gathered in a row.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = escaped(F.coalesce(F.col(text_col), F.lit("")))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("no"), role.alias("who"), text.alias("said"))
    people = rows.where(F.col("who") != SYSTEM).select(F.col("conv").alias("_conv"), F.col("who").alias("perspective")).distinct()
    own = F.col("who") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("who") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), _name(F.col("who")), F.lit("|>\n")))
    views = rows.join(people, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    views = views.withColumn("_head", head).withColumn("_size", (F.length("_head") + F.length("said") + 8).cast("long")).withColumn("_chunk", F.coalesce(F.floor(F.col("no") / chunk), F.lit(-(1 << 62))))
    keys = ["conv", "perspective", "_chunk"]
    inside = F.sum("_size").over(W.partitionBy(*keys).orderBy("no", "who", "said").rowsBetween(W.unboundedPreceding, -1))
    sums = views.groupBy(*keys).agg(F.sum("_size").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("conv", "perspective").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(earlier, F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    placed = views.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, same[0] & same[1] & same[2])
    start = F.col("_before") + F.col("_inside")
    return placed.select(
        F.col("conv").alias(conv_col),
        "perspective",
        F.col("no").alias(turn_col),
        F.col("who").alias(role_col),
        F.concat("_head", "said", F.lit("<|end|>\n")).alias("rendered"),
        start.alias("char_start"),
        (start + F.col("_size")).alias("char_end"),
        F.when(own, start + F.length("_head")).alias("mask_start"),
        F.when(own, start + F.col("_size") - 1).alias("mask_end"),
    )
