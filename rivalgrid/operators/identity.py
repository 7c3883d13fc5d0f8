"""Identity resolution: a chain of id lookups with a name fallback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalgrid.functions.text import merge_name
from rivalgrid.session import cut_lineage


def crosswalk(records: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One record per (name key, category): the one with most ids filled. Keys that stand for
    different ids are ambiguous and left out."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in ids), F.lit(0))
    rows = records.withColumn("name_key", merge_name(F.col("name")))
    keyed = rows.groupBy("name_key", "category").agg(
        F.count_distinct(ids[0]).alias("_n"), F.max_by(F.struct(*ids), F.struct(filled.alias("f"), F.col(ids[0]))).alias("_r"))
    return keyed.where(F.col("_n") <= 1).select("name_key", "category", "_r.*")


def resolve(rows: DataFrame, records: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Attach ``target`` by the first id that matches, then by unambiguous name and category, then a
    composite of whatever is known.

    One key at a time: only rows that have the id are joined on it, so no run of NULL ids meets in one
    task, and rows that a key resolves leave before the next.
    """
    kind = records.schema[target].dataType
    waiting, done = rows, []
    for k in keys:
        side = records.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(target).alias("_hit"))
        asked = cut_lineage(waiting.where(F.col(k).isNotNull()).join(side, k, "left").select(*rows.columns, "_hit"))
        done.append(asked.where(F.col("_hit").isNotNull()).withColumn("resolved_by", F.lit(k)))
        waiting = waiting.where(F.col(k).isNull()).unionByName(asked.where(F.col("_hit").isNull()).drop("_hit"))
    names = crosswalk(records, [target, *[k for k in keys if k != target]]).select("name_key", "category", F.col(target).alias("_hit"))
    waiting = waiting.withColumn("name_key", merge_name(F.col("name")))
    named = F.col("name_key").isNotNull() & F.col("category").isNotNull()
    last = waiting.where(named).join(names, ["name_key", "category"], "left").unionByName(waiting.where(~named).withColumn("_hit", F.lit(None).cast(kind)))
    done.append(last.select(*rows.columns, "_hit").withColumn("resolved_by", F.when(F.col("_hit").isNotNull(), "name").otherwise("unmapped")))
    out = reduce(DataFrame.unionByName, done)
    fallback: Column = F.when(F.col("name").isNotNull(), F.concat(F.lit("unmapped:"), merge_name(F.col("name")), F.lit(":"), F.coalesce("category", F.lit(""))))
    for k in reversed(list(keys)):
        fallback = F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))).otherwise(fallback)
    return out.withColumn("resolved", F.coalesce(F.col("_hit").cast("string"), fallback, F.lit("unmapped:unknown"))).drop("_hit")


def ranks_by_id(ranks: DataFrame, order: str) -> DataFrame:
    """Ranking rows keyed by resolved id; the last one wins."""
    names = [c for c in ranks.columns if c not in ("resolved", order)]
    return ranks.groupBy("resolved").agg(F.max_by(F.struct(*names), order).alias("_r")).select("resolved", "_r.*")
