"""The live tier: what polled status documents, landed by ``landing``, say against a static baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalgrid.functions.text import in_live_window


def with_fallback_sd(starters: DataFrame, known: DataFrame, category_sd: DataFrame) -> DataFrame:
    """Starters with pregame mean and SD; unknown ones become stubs with their category's SD."""
    rows = starters.join(known.select("entity", "mean", "sd"), "entity", "left").join(category_sd, "category", "left")
    return rows.withColumns({
        "stub": F.col("mean").isNull(), "mean": F.coalesce("mean", F.lit(0.0)), "sd": F.coalesce("sd", "category_sd", F.lit(0.0))}).drop("category_sd")


def blend(starters: DataFrame, status: DataFrame, fractions: DataFrame) -> DataFrame:
    """Per entity: points so far plus the remaining share of the pregame mean, SD x sqrt(share).

    Without a scoreboard entry a finished entity has nothing left, any other its whole game.
    """
    rows = starters.join(status.select("entity", "points", "finished"), "entity", "left").join(fractions.select("grp", "fraction"), "grp", "left")
    left = F.coalesce("fraction", F.when(F.col("finished"), 0.0).otherwise(1.0))
    points = F.coalesce("points", F.lit(0.0))
    return rows.withColumns({"points": points, "left": left, "projected": points + left * F.col("mean"), "variance": F.col("sd") * F.col("sd") * left})


def team_totals(blended: DataFrame) -> DataFrame:
    return blended.groupBy("team").agg(
        F.sum("projected").alias("mean"), F.sqrt(F.sum("variance")).alias("sd"), F.sum("points").alias("points"))


def gate(events: DataFrame, now: Column, minutes: int = 270) -> DataFrame:
    """Does any tenant have a live or just finished game?"""
    live = in_live_window(F.col("state"), F.col("start"), now, minutes)
    return events.groupBy("tenant").agg(F.max(live).alias("should_run"))


def overlay(baseline: DataFrame, tick: DataFrame, keys: Sequence[str], columns: Sequence[str], period: str) -> DataFrame:
    """Baseline with the tick's own columns replaced where the tick speaks of the same period.

    A tick whose period differs from the baseline's is skipped until the next full run.
    """
    fresh = tick.select(*keys, F.col(period).alias("_period"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = baseline.join(fresh, list(keys), "left")
    same = F.col("_period") == F.col(period)
    out = rows.withColumns({c: F.when(same, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in columns})
    return out.withColumn("live", F.coalesce(same, F.lit(False))).drop("_period", *[f"_{c}" for c in columns])


def drop_stale(outputs: DataFrame, current: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    """Keep only outputs of each tenant's running period."""
    now = current.select(*by, F.col(period).alias("_now"))
    return outputs.join(now, list(by)).where(F.col(period) == F.col("_now")).drop("_now")


def not_yet_landed(wanted: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incremental pull: the keys still to fetch."""
    return wanted.select(*keys).distinct().join(landed.select(*keys).distinct(), list(keys), "left_anti")


def final_games_only(rows: DataFrame, games: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A running period counts game by game: rows of games that are not final wait."""
    return rows.join(games.where("final").select(*keys), list(keys), "left_semi")
