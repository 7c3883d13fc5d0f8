"""Dense period grids over a schedule.

A schedule row is (season, week, grp, opp, home); opp NULL is a bye. Grids are groups x periods,
so they are small whatever the size of the tables below them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_sides(games: DataFrame) -> DataFrame:
    """Game rows (home_grp, away_grp, home_score, away_score) as two perspective rows in one pass."""
    def side(grp: str, opp: str, own: str, other: str, home: bool):
        return F.struct(
            F.col(grp).alias("grp"), F.col(opp).alias("opp"), F.col(own).alias("own_score"),
            F.col(other).alias("opp_score"), F.lit(home).alias("home"),
        )
    views = F.array(
        side("home_grp", "away_grp", "home_score", "away_score", True),
        side("away_grp", "home_grp", "away_score", "home_score", False),
    )
    rest = [c for c in games.columns if c not in ("home_grp", "away_grp", "home_score", "away_score")]
    return games.select(*rest, F.explode(views).alias("_v")).select(*rest, "_v.*")


def with_byes(edges: DataFrame, periods: Sequence[str] = ("season", "week")) -> DataFrame:
    """Complete (season, week) x (groups of the season); a group without a game gets opp NULL."""
    season = periods[0]
    weeks = edges.groupBy(season).agg(F.collect_set(periods[1]).alias("_weeks"))
    grid = edges.select(season, "grp").distinct().join(weeks, season).select(
        season, "grp", F.explode("_weeks").alias(periods[1])
    )
    return grid.join(edges, [*periods, "grp"], "left")


def with_categories(games: DataFrame, categories: Sequence[str]) -> DataFrame:
    return games.withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))


def dense_points(games: DataFrame, points: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Played games x categories with the group's points; nothing recorded is a real zero."""
    grid = with_categories(games, categories)
    keys = ["season", "week", "grp", "category"]
    return grid.join(points.select(*keys, "pts"), keys, "left").withColumn("pts", F.coalesce("pts", F.lit(0.0)))


def with_opponent(rows: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Attach the opponent's values of the same period; ``values`` maps its column to a new name."""
    other = rows.select(*keys, F.col("grp").alias("opp"), *[F.col(c).alias(n) for c, n in values.items()])
    return rows.join(other, [*keys, "opp"])


def weeks_complete(games: DataFrame) -> DataFrame:
    """Per season, the last week up to which every game is final (0 if none)."""
    week = games.groupBy("season", "week").agg(F.min(F.col("final").cast("int")).alias("_done"))
    upto = Window.partitionBy("season").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return (
        week.withColumn("_ok", F.min("_done").over(upto))
        .groupBy("season").agg(F.coalesce(F.max(F.when(F.col("_ok") == 1, F.col("week"))), F.lit(0)).alias("weeks_complete"))
    )


def weeks_played(games: DataFrame) -> DataFrame:
    """Per season, the last week with any final game."""
    return games.groupBy("season").agg(
        F.coalesce(F.max(F.when(F.col("final"), F.col("week"))), F.lit(0)).alias("weeks_played")
    )


def bye_weeks(sched: DataFrame) -> DataFrame:
    return sched.where(F.col("opp").isNull()).groupBy("season", "grp").agg(F.min("week").alias("bye_week"))


def complete_periods_only(rows: DataFrame, games: DataFrame) -> DataFrame:
    """Drop rows of periods that are only partly played."""
    return rows.join(weeks_complete(games), "season").where(F.col("week") <= F.col("weeks_complete")).drop("weeks_complete")


def implied_totals(games: DataFrame) -> DataFrame:
    """Expected score of each side from a line (spread > 0 favours home) and a total; NULL until both exist."""
    half = (F.col("total_line") + F.col("spread_line")) / 2
    other = (F.col("total_line") - F.col("spread_line")) / 2
    return both_sides(games.withColumns({"home_score": half, "away_score": other})).withColumnsRenamed(
        {"own_score": "implied_total", "opp_score": "opponent_implied_total"}
    )


def remaining_schedule(detail: DataFrame, sched: DataFrame, keys: Sequence[str] = ("season", "week", "grp")) -> DataFrame:
    """Every scheduled period of every group; those not in ``detail`` keep NULL measures."""
    return sched.join(detail, list(keys), "left")


def period_for_instant(rows: DataFrame, starts: DataFrame, by: Sequence[str], when: str, start: str, period: str) -> DataFrame:
    """As-of, at or before: the last period that started by ``when`` (NULL before the first).

    Starts are one row per period, so they travel as one sorted array per key.
    """
    table = starts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(period).alias("p")))).alias("_starts"))
    begun = F.filter("_starts", lambda x: x["s"] <= F.col(when))
    return rows.join(table, list(by), "left").withColumn(period, F.try_element_at(begun, F.lit(-1))["p"]).drop("_starts")
