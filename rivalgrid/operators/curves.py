"""Rank-to-value curves and projections built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import clamp
from rivalgrid.operators.ranking import non_increasing, row_numbers_any_size


def season_averages(rows: DataFrame, min_games: int, pts: str = "pts") -> DataFrame:
    """Mean and population SD per entity-season with enough periods."""
    return rows.groupBy("season", "category", "entity").agg(
        F.avg(pts).alias("ppg"), F.stddev_pop(pts).alias("sd"), F.count(F.lit(1)).alias("games")
    ).where(F.col("games") >= min_games)


def ranked_averages(averages: DataFrame) -> DataFrame:
    """Position of each entity in its season and category; a category may hold any number of entities."""
    return row_numbers_any_size(
        averages, ["season", "category"], [F.col("ppg").desc(), F.col("entity").asc()]
    )


def build_curve(ranked: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(category, rank) -> average over seasons, never rising with rank."""
    raw = ranked.groupBy("category", "rank").agg(
        F.avg("ppg").alias("raw"), F.avg("sd").alias("sd"), *[F.max(k).alias(k) for k in keep]
    )
    return non_increasing(raw, ["category"], "rank", "raw", "ppg").select("category", "rank", "ppg", "sd", *keep)


def starter_average(curve: DataFrame, pool: int) -> DataFrame:
    return curve.where(F.col("rank") <= pool).groupBy("category").agg(F.avg("ppg").alias("starter_avg"))


def blend_curves(
    history: DataFrame, current: DataFrame, max_weight: float = 0.5, full_weeks: int = 8
) -> DataFrame:
    """Mix the running season into the history; ranks it does not have stay historic.

    ``current`` is a ``build_curve`` that kept ``weeks_complete``, the weight's driver.
    """
    w = F.least(F.col("weeks_complete") / F.lit(float(full_weeks)), F.lit(1.0)) * max_weight
    now = current.select("category", "rank", F.col("ppg").alias("_p"), F.col("sd").alias("_s"), w.alias("_w"))
    rows = history.join(now, ["category", "rank"], "left")
    def mix(old: str, new: str):
        return F.coalesce((1 - F.col("_w")) * F.col(old) + F.col("_w") * F.col(new), F.col(old)).alias(old)
    return rows.select("category", "rank", mix("ppg", "_p"), mix("sd", "_s"))


def project(
    entities: DataFrame, sched: DataFrame, curve: DataFrame, index: DataFrame, current_week: int, final_week: int,
    *, external: DataFrame | None = None, dampening: float = 0.5, bounds: tuple[float, float] = (0.5, 1.5),
    zero_statuses: Sequence[str] = ("OUT", "SUSPENSION", "INJURY_RESERVE"),
) -> DataFrame:
    """Per entity and remaining week: curve value x opponent adjustment, zeroed by status or return week.

    ``entities``: entity, grp, category, rank, status, return_week. An external value wins over the
    curve; a bye is zero. A rank past the end of a curve reads the curve's last value.
    """
    last = curve.groupBy("category").agg(F.max("rank").alias("_max"))
    ranked = entities.join(last, "category", "left").withColumn("_rank", F.least("rank", "_max"))
    base = curve.select("category", F.col("rank").alias("_rank"), F.col("ppg").alias("baseline"), F.col("sd").alias("base_sd"))
    weeks = sched.where(F.col("week").between(current_week, final_week)).select("grp", "week", "opp")
    idx = index.select(F.col("grp").alias("opp"), "category", F.col("idx"))
    rows = ranked.join(base, ["category", "_rank"], "left").join(weeks, "grp").join(idx, ["opp", "category"], "left")
    if external is not None:
        rows = rows.join(external.select("entity", "week", "external"), ["entity", "week"], "left")
    else:
        rows = rows.withColumn("external", F.lit(None).cast("double"))
    bye = F.col("opp").isNull()
    factor = 1 + dampening * (clamp(F.coalesce("idx", F.lit(1.0)), *bounds) - 1)
    own = F.when(bye, 0.0).otherwise(F.coalesce("baseline", F.lit(0.0)) * factor)
    by_status = ~bye & (F.col("week") == current_week) & F.coalesce(F.col("status").isin(*zero_statuses), F.lit(False))
    by_return = ~bye & F.coalesce(F.col("week") < F.col("return_week"), F.lit(False))
    value = F.when(bye | by_status | by_return, 0.0).otherwise(F.coalesce("external", own))
    reason = F.when(by_status, F.concat(F.lit("injury:"), F.col("status"))).when(
        by_return & (F.col("week") == current_week), F.concat(F.lit("return_week:"), F.col("return_week").cast("string"))
    )
    return rows.select(
        "entity", "grp", "category", "week", "opp", "idx", own.alias("own_projected"), value.alias("projected"),
        F.coalesce("base_sd", F.lit(0.0)).alias("sd"), reason.alias("zero_reason"),
    )


def projection_totals(weekly: DataFrame, current_week: int, regular_weeks: int) -> DataFrame:
    p, w = F.col("projected"), F.col("week")
    def part(cond):
        return F.sum(F.when(cond, p).otherwise(0.0))
    return weekly.groupBy("entity", "grp", "category").agg(
        F.sum(p).alias("rest_total"), part(w <= regular_weeks).alias("regular_total"),
        part(w > regular_weeks).alias("playoff_total"), part(w == current_week).alias("this_week"),
        F.max("zero_reason").alias("zero_reason"),
    )


def actual_or_missing(
    grid: DataFrame, stats: DataFrame, active: DataFrame, pts: str = "pts"
) -> DataFrame:
    """Dense entity x week view: recorded points, a real zero when active without a row, else NULL.

    ``grid`` carries (season, week, entity, final, opp); a completed, scheduled week without a row
    and without active status is marked missed.
    """
    keys = ["season", "week", "entity"]
    rows = grid.join(stats.select(*keys, F.col(pts).alias("_pts")), keys, "left").join(
        active.select(*keys, F.lit(True).alias("_active")), keys, "left"
    )
    played = F.col("final") & F.col("opp").isNotNull()
    value = F.when(played, F.when(F.col("_pts").isNotNull(), F.col("_pts")).when(F.col("_active"), 0.0))
    return rows.withColumn("actual", value).withColumn("missed", played & value.isNull()).drop("_pts", "_active")


def weekly_arrays(weekly: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per entity with its weeks nested in order (at most one element per week)."""
    return weekly.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("week", *columns))).alias("weekly"))


def running_total_rank(rows: DataFrame) -> DataFrame:
    """Season total to date per entity and its rank within the category."""
    totals = rows.groupBy("season", "category", "entity").agg(F.sum("pts").alias("total"))
    return row_numbers_any_size(totals, ["season", "category"], [F.col("total").desc(), F.col("entity").asc()])


def overall_rank(entities: DataFrame, given: DataFrame) -> DataFrame:
    """A given overall rank wins; others are numbered by total among the ranked entities."""
    rows = entities.join(given.select("entity", F.col("rank").alias("_given")), "entity", "left")
    ranked = row_numbers_any_size(rows, ["season"], [F.col("total").desc(), F.col("entity").asc()], "_own")
    return ranked.withColumn("overall_rank", F.coalesce("_given", "_own")).drop("_given", "_own")


def category_sd(averages: DataFrame) -> DataFrame:
    """Fallback SD per category."""
    return averages.groupBy("category").agg(F.avg("sd").alias("category_sd"))


def trailing_averages(rows: DataFrame) -> DataFrame:
    """Average of the two periods before the last one, and season to date before the current period."""
    by = Window.partitionBy("season", "entity").orderBy("week")
    return rows.withColumns({
        "trailing_avg": F.avg("pts").over(by.rangeBetween(-3, -2)),
        "to_date_avg": F.avg("pts").over(by.rangeBetween(Window.unboundedPreceding, -1)),
    })
