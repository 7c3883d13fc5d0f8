"""Key/value settings sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")


def read_settings(spark, path: str) -> DataFrame:
    """CSV with league_slug, key, value; a missing column is an error."""
    df = spark.read.option("header", True).csv(path)
    missing = {"league_slug", "key", "value"} - set(df.columns)
    if missing:
        raise ValueError(f"settings sheet lacks columns: {sorted(missing)}")
    return df


def latest_settings(rows: DataFrame, order: str) -> DataFrame:
    """Trim, drop rows without tenant or key, last one wins."""
    trimmed = rows.select(order, *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("league_slug", "key", "value")])
    kept = trimmed.where((F.col("league_slug") != "") & (F.col("key") != ""))
    return kept.groupBy("league_slug", "key").agg(F.max_by("value", order).alias("value"))


def apply_settings(settings: DataFrame, defaults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed overrides over defaults (key, kind, value), and a report of what was ignored.

    kind is number, flag or text. Unknown keys and values that do not parse keep the default.
    """
    known = settings.join(defaults.select("key", "kind", F.col("value").alias("_default")), "key", "left")
    number = F.expr("try_cast(value AS double)")
    flag = F.lower("value").isin(*TRUE_WORDS, *FALSE_WORDS)
    ok = F.when(F.col("kind") == "number", number.isNotNull()).when(F.col("kind") == "flag", flag).otherwise(F.lit(True))
    applied = known.where(F.col("kind").isNotNull() & ok).select("league_slug", "key", "kind", "value")
    # defaults are a catalogue of a few dozen keys, so every tenant takes each of them
    tenants = settings.select("league_slug").distinct()
    base = tenants.withColumn("_d", F.lit(True)).join(defaults.withColumn("_d", F.lit(True)).withColumnRenamed("value", "_default"), "_d").drop("_d")
    merged = base.join(applied.select("league_slug", "key", "value"), ["league_slug", "key"], "left").select(
        "league_slug", "key", "kind", F.coalesce("value", "_default").alias("value"), F.col("value").isNotNull().alias("overridden"))
    report = known.where(F.col("kind").isNull() | ~ok).select(
        "league_slug", "key", "value", F.when(F.col("kind").isNull(), "unknown key").otherwise("bad value").alias("reason"))
    return merged, report


def seeding_rules(settings: DataFrame) -> DataFrame:
    """seed_N_division_priority and seed_N_tiebreak_1..4 -> one row per tenant and seed."""
    pattern = r"^seed_(\d+)_(division_priority|tiebreak_([1-4]))$"
    rows = settings.select(
        "league_slug", "value", F.regexp_extract("key", pattern, 1).alias("_n"), F.regexp_extract("key", pattern, 2).alias("_what"),
        F.regexp_extract("key", pattern, 3).alias("_i")).where(F.col("_n") != "")
    tie = F.when((F.col("_i") != "") & (F.col("value") != ""), F.struct(F.col("_i").alias("i"), F.col("value").alias("v")))
    return rows.groupBy("league_slug", F.col("_n").cast("int").alias("seed")).agg(
        F.coalesce(F.max(F.when(F.col("_what") == "division_priority", F.lower(F.trim("value")).isin(*TRUE_WORDS))), F.lit(False)).alias("division_priority"),
        F.transform(F.array_sort(F.collect_list(tie)), lambda x: x["v"]).alias("tiebreaks"))
