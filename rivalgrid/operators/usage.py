"""Usage shares, bounded lookbacks and peer status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_totals(rows: DataFrame, measure: str, by_category: bool = True) -> DataFrame:
    by = ["season", "week", "grp", *(["category"] if by_category else [])]
    return rows.groupBy(*by).agg(F.sum(measure).alias("total"))


def total_from_top_share(rows: DataFrame, count: str, share: str) -> DataFrame:
    """A group's total recovered from the member with the highest share: count / share, rounded."""
    top = rows.where(F.col(share) > 0).groupBy("season", "week", "grp").agg(
        F.max(share).alias("top_share"), F.max_by(count, F.struct(share, count)).alias("_count"))
    return top.select("season", "week", "grp", "top_share", F.round(F.col("_count") / F.col("top_share")).alias("total"))


def shares(rows: DataFrame, measure: str, name: str) -> DataFrame:
    """Member share of its group's total; totals are aggregated first, so a group may be of any size."""
    keys = ["season", "week", "grp"]
    totals = rows.groupBy(*keys).agg(F.sum(measure).alias("_total"))
    out = rows.join(totals, keys)
    return out.withColumn(name, F.when(F.col("_total") > 0, F.col(measure) / F.col("_total"))).drop("_total")


def last_write(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, order).alias(value))


def lookback(
    wanted: DataFrame, facts: DataFrame, by: Sequence[str], value: str, name: str, back: int = 2, skip_null: bool = True
) -> DataFrame:
    """Most recent of the ``back`` periods before each wanted (by, week).

    Facts are shifted forward onto the periods that may ask for them, so this is an equi join.
    ``skip_null`` passes over periods whose value is NULL; otherwise the first existing row decides.
    """
    shifted = facts.withColumn("_lag", F.explode(F.sequence(F.lit(1), F.lit(back)))).select(
        *by, (F.col("week") + F.col("_lag")).alias("week"), "_lag", F.col(value).alias("_v"))
    if skip_null:
        shifted = shifted.where(F.col("_v").isNotNull())
    picked = shifted.groupBy(*by, "week").agg(F.min_by("_v", "_lag").alias(name))
    return wanted.join(picked, [*by, "week"], "left")


def peers_out(rows: DataFrame, flagged: Column, new: Column) -> DataFrame:
    """Does any other member of the same group, period and category carry the flag (or a new one)?

    Counted per group minus the row itself: no member meets another member, and the counts are
    aggregated before they come back, so a group may be of any size.
    """
    keys = ["season", "week", "grp", "category"]
    marked = rows.withColumns({"_f": flagged.cast("int"), "_n": (flagged & new).cast("int")})
    counts = marked.groupBy(*keys).agg(F.sum("_f").alias("_fs"), F.sum("_n").alias("_ns"))
    out = marked.join(counts, keys)
    return out.withColumns({
        "peer_out": (F.col("_fs") - F.col("_f")) > 0, "peer_out_new": (F.col("_ns") - F.col("_n")) > 0}).drop("_f", "_n", "_fs", "_ns")


def fill_gaps(reports: DataFrame, reserves: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Overlay two status sources: the first wins, the second only fills gaps."""
    second = reserves.select(*keys, F.col(value).alias("_second"))
    return reports.join(second, list(keys), "full").withColumn(value, F.coalesce(value, "_second")).drop("_second")


def ratio_of_sums(rows: DataFrame, by: Sequence[str], num: str, den: str, name: str) -> DataFrame:
    """Share over a window of periods: sum over sum of the pairwise-complete periods, NULL without any."""
    both = F.col(num).isNotNull() & F.col(den).isNotNull()
    d = F.sum(F.when(both, F.col(den)))
    return rows.groupBy(*by).agg(F.when(d > 0, F.sum(F.when(both, F.col(num))) / d).alias(name))


def summary_stats(rows: DataFrame, by: Sequence[str], current_week: int, pts: str = "pts") -> DataFrame:
    """Average and total so far, and the value one and two periods ago."""
    past = F.col("week") < current_week
    def ago(k: int) -> Column:
        return F.max(F.when(F.col("week") == current_week - k, F.col(pts))).alias(f"ago_{k}")
    return rows.groupBy(*by).agg(
        F.avg(F.when(past, F.col(pts))).alias("avg_pts"), F.sum(F.when(past, F.col(pts))).alias("total_pts"), ago(1), ago(2))


def range_stats(rows: DataFrame, by: Sequence[str], measures: Sequence[str], low: int, high: int) -> DataFrame:
    inside = rows.where(F.col("week").between(low, high))
    return inside.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures], F.count_distinct("week").alias("games"))


def unpivot_metrics(rows: DataFrame, keys: Sequence[str], metrics: dict[str, tuple[str, Sequence[str] | None]]) -> DataFrame:
    """Long series from a registry metric -> (column, categories it applies to or None)."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"),
                 (F.col("category").isin(*cats) if cats else F.lit(True)).alias("applies"))
        for name, (column, cats) in metrics.items()
    ])
    return rows.withColumn("_m", F.explode(F.filter(cells, lambda m: m["applies"]))).select(*keys, "_m.metric", "_m.value")
