"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are grouped by the length of their normalised text and by a hash of its prefix (both levels in
one aggregate: a length that one row has is a pair of length and prefix that one row has). Only rows
of groups that survive, with more than one row, have their full content hashed, and rows of equal
full hash (SHA-256) are copies. White space does not count, and a NULL text is an empty one.

Rows of a group are never brought together: groups are aggregates that combine before the shuffle,
and the verdict goes back to the rows by a join whose large side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalgrid.llm.common import fresh, without_blanks
from rivalgrid.session import cut_lineage

PREFIX = 128


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with keep_id (doc_id of the row of its group that stays), group_size and kept.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    doc_id (a NULL doc_id last); of rows equal in both, one. NULL, empty and blank texts are one
    group. A row without a copy has group_size 1. Extra columns are carried; a column called like a
    result gives way to it. Without ``keep_text`` the text column is left out.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    length, prefix, many, full, points, row = fresh(docs, "length", "prefix", "many", "full", "points", "row")
    text_now = F.coalesce(F.col(text), F.lit(""))
    normal = without_blanks(F.col(text))
    keyed = docs.withColumns({
        length: F.length(normal), prefix: F.xxhash64(F.substring(normal, 1, PREFIX)), points: F.length(text_now)})
    alive = cut_lineage(
        keyed.groupBy(length, prefix).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) > 1))
    hashed = keyed.join(alive, [length, prefix], "left").withColumns({
        full: F.when(F.col(many).isNotNull(), F.sha2(normal.cast("binary"), 256)), row: F.monotonically_increasing_id()})
    rows = cut_lineage(hashed.drop(length, prefix, many, *([] if keep_text else [text])))

    alone = rows.where(F.col(full).isNull()).withColumns({
        "keep_id": F.col(doc_id), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    first = F.min(F.struct((-F.col(points)).alias("a"), F.col(doc_id).isNull().alias("b"), F.col(doc_id).alias("c"), F.col(row).alias("d")))
    groups = cut_lineage(
        rows.where(F.col(full).isNotNull()).groupBy(full).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .select(full, F.col("first.c").alias("keep_id"), F.col("first.d").alias("first_row"), "group_size"))
    together = rows.where(F.col(full).isNotNull()).join(groups, full).withColumn("kept", F.col(row) == F.col("first_row"))
    carried = [c for c in rows.columns if c not in (full, points, row)]
    out = [*[F.col(c) for c in carried], "keep_id", "group_size", "kept"]
    return alone.select(*out).unionByName(together.select(*out))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return mark_copies(docs, doc_id, text).where("kept").select(*[F.col(c) for c in docs.columns])
