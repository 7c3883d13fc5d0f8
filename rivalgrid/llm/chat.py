"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

Every participant of a dialogue is once the assistant: the dialogue is rendered with that speaker's
turns as assistant turns, the others' as turns of users named after their roles, and a mask that
says where the assistant's words stand, which are the ones to learn from. System turns speak to all;
they are no participants and stay system turns.

A rendered dialogue is cut into parts of at most ``TURNS`` turns, so no row and no task grows with a
very long conversation. Positions of turns come from counts per block of turn numbers, not from a
window over the whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = 256
# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def header(speaker: Column, perspective: Column) -> Column:
    own = F.when(speaker == perspective, F.lit("assistant"))
    return F.concat(F.lit(OPEN), own.when(speaker == "system", "system").otherwise(F.concat(F.lit("user name="), speaker)), F.lit("\n"))


def rotate(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = TURNS
) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, mask: one row per participant and part.

    ``mask`` holds [start, end) of the perspective's own words in ``rendered``, in code points, as
    "start:end" joined by commas. Turns stand in order of turn, then role, then text (NULLs first); a
    part is ``most`` turns of that order. A NULL role speaks as "unknown", a NULL text is empty, a NULL
    conversation is one conversation. Repeated rows are turns of their own. A conversation of system
    turns alone has no participant and no row. Extra columns are not read.
    """
    said = turns.select(
        F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("unknown")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"))
    # positions: equal rows are numbered together, so a window never holds more than one turn number
    slots = said.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n"))
    blocks = slots.withColumn("b", F.floor(F.coalesce(F.col("t"), F.lit(-1)) / F.lit(most)))
    per_block = blocks.groupBy("c", "b").agg(F.sum("n").alias("bn"))
    before_block = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before_slot = Window.partitionBy("c", "b").orderBy(F.col("t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.withColumn("s", F.coalesce(F.sum("n").over(before_slot), F.lit(0)))
        .join(per_block.withColumn("bs", F.coalesce(F.sum("bn").over(before_block), F.lit(0))).select(F.col("c").alias("c2"), F.col("b").alias("b2"), "bs"),
              F.col("c").eqNullSafe(F.col("c2")) & (F.col("b") == F.col("b2")))
        .select(F.col("c").alias("c1"), F.col("t").alias("t1"), (F.col("s") + F.col("bs")).alias("start")))
    inside = Window.partitionBy("c", "t").orderBy("r", "x")
    placed = (
        said.withColumn("i", F.row_number().over(inside))
        .join(starts, F.col("c").eqNullSafe(F.col("c1")) & F.col("t").eqNullSafe(F.col("t1")))
        .select("c", "r", "x", (F.col("start") + F.col("i") - 1).alias("pos")))
    people = said.where("r <> 'system'").select(F.col("c").alias("c1"), F.col("r").alias("perspective")).distinct()
    seen = placed.join(people, F.col("c").eqNullSafe(F.col("c1"))).drop("c1").withColumns({
        "part": F.floor(F.col("pos") / F.lit(most)), "head": header(F.col("r"), F.col("perspective"))})
    # within a part, at most ``most`` rows
    listed = seen.groupBy("c", "perspective", "part").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "head", "x", (F.col("r") == F.col("perspective")).alias("own")))).alias("turns"))
    piece = F.transform("turns", lambda s: F.concat(s["head"], s["x"], F.lit(CLOSE)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("mask"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["x"])
        span = F.concat(F.when(acc["mask"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(s["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return listed.select(
        F.col("c").alias(conv_id), "perspective", F.col("part").cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(piece, "").alias("rendered"), F.aggregate("turns", start, step)["mask"].alias("mask"))
