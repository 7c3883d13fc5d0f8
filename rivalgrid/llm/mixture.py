"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's expected copies are its source's target over its source's size. Documents of a source
stand in order of size; the running sum of expected copies plus one random offset per source crosses
integer boundaries, and a document is emitted once per boundary it crosses. Because neighbours are
alike in size, the words taken come close to the target.

A running sum of a constant is the constant times the position, so positions are all that is
needed: a table of counts per (source, size, slice) gives where each slice begins, and a window
numbers the rows inside one slice. Slices split a size that many documents of a source have, so a
source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.llm.common import WORD, fresh

MOST = 3.0


def size_of(text: Column) -> Column:
    """Number of words; NULL is zero."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, cycle: int = 3, most: float = MOST) -> DataFrame:
    """One row per source: source, its words ``total``, ``target``.

    Sources by code point, NULL last, weigh 1, 2, .., ``cycle`` and again. Each would get its weight's
    share of all words; a target stops at ``most`` times its source's words, and what is over goes
    to the others by weight. The level at which that ends is found in one pass over sources by cap
    per weight: level * weight for sources with room, their cap for the others. The table of sources
    is small beside the documents; it is the only thing here in one task.
    """
    total = sizes.groupBy(source).agg(F.sum(size).cast("double").alias("total"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weighed = total.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("double")).withColumns({
        "cap": F.col("total") * most, "per": F.col("total") * most / F.col("weight")})
    filled = Window.orderBy("per", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = weighed.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(filled), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(filled), F.lit(0.0)),
        "all_words": F.sum("total").over(everything), "all_weight": F.sum("weight").over(everything)})
    level = (F.col("all_words") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    # the first source in that order whose cap per weight the level does not pass sets the level
    ended = before.withColumn("level", F.min(F.when(level <= F.col("per"), F.struct("per", level.alias("level")))).over(everything)["level"])
    return ended.select(source, "total", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A fixed number in [0, 1) per source and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, keep_text: bool = True
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size).

    NULL and empty texts have size 0 and take no words; NULL is a source of its own. A source of no
    words has the target 0. Repeated rows are documents of their own. Extra columns are carried; a
    column called like a result gives way to it. Without ``keep_text`` the text is left out.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    part, name, here, start, before = fresh(docs, "part", "name", "here", "start", "before")
    keyed = docs.withColumns({
        "size": size_of(F.col(text)), name: F.concat(F.lit("="), F.col(source)),
        part: F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))), 1, 2)})
    keyed = keyed.withColumn(name, F.coalesce(F.col(name), F.lit(">")))  # ">" sorts after "=...": NULL last, and NULLs join
    counts = keyed.groupBy(name, "size", part).agg(F.count(F.lit(1)).alias("n"))
    to = targets(counts.select(name, (F.col("size") * F.col("n")).alias("words")), name, "words")
    # where each slice begins: the rows of smaller sizes of its source, then the slices before it
    smaller = Window.partitionBy(name).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = counts.groupBy(name, "size").agg(F.sum("n").alias("n")).select(name, "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias(before))
    earlier = Window.partitionBy(name, "size").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.select(name, "size", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start))
    starts = slices.join(by_size, [name, "size"]).withColumn(start, F.col(start) + F.col(before)).drop(before).join(to, name)
    rows = keyed if keep_text else keyed.drop(text)
    inside = Window.partitionBy(name, "size", part).orderBy(F.col(doc_id).asc_nulls_last())
    placed = rows.withColumn(here, F.row_number().over(inside)).join(starts, [name, "size", part])
    each = F.coalesce(F.least(F.col("target") / F.col("total"), F.lit(MOST)), F.lit(0.0))
    u = offset(F.col(source), seed)
    at = F.col(start) + F.col(here)
    copies = F.floor(each * at + u) - F.floor(each * (at - 1) + u)
    carried = [F.col(c) for c in docs.columns if keep_text or c != text]
    return placed.select(
        *carried, F.col("size"), F.col("total").cast("long").alias("source_size"), "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mix itself: each document once per copy, with the columns of ``docs``."""
    (turn,) = fresh(docs, "turn")
    rows = mix(docs, doc_id, text, source, seed).where("copies > 0")
    return rows.select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(turn)).drop(turn)
