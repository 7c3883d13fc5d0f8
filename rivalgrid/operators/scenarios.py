"""Analytics over tables of season outcomes.

``games``: scenario, game, home, away, home_won. ``groups``: scenario, grp, division, wins, pf. A
scenario holds one league's games, so windows inside a scenario are small; scenarios are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import count_if, win_probability
from rivalgrid.operators.ranking import percentiles_any_size

# Odds swings that matter and the support needed to say so.
MUST_ABS, MUST_REL, BIG_SWING, FLAT_SWING, MIN_SUPPORT, MIN_BRANCH, BRANCH_DROP = 0.10, 0.5, 0.15, 0.01, 30, 100, 0.05


def group_results(games: DataFrame) -> DataFrame:
    """Each game as one result row per side."""
    return games.withColumn("_s", F.explode(F.array(
        F.struct(F.col("home").alias("grp"), F.col("home_won").alias("won")),
        F.struct(F.col("away").alias("grp"), (~F.col("home_won")).alias("won"))))).select("scenario", "game", "_s.grp", "_s.won")


def final_wins(games: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Wins per scenario and group: base wins plus the scenario's results."""
    wins = group_results(games).groupBy("scenario", "grp").agg(F.sum(F.col("won").cast("double")).alias("wins"))
    if base is None:
        return wins
    return wins.join(base.select("grp", "base_wins"), "grp", "left").withColumn(
        "wins", F.col("wins") + F.coalesce("base_wins", F.lit(0.0))).drop("base_wins")


def seeds(groups: DataFrame) -> DataFrame:
    """Division winners first, then the rest, by wins and points."""
    order = [F.col("wins").desc(), F.col("pf").desc(), F.col("grp").asc()]
    top = F.row_number().over(Window.partitionBy("scenario", "division").orderBy(*order)) == 1
    rows = groups.withColumn("division_winner", top)
    seed = F.row_number().over(Window.partitionBy("scenario").orderBy(F.col("division_winner").desc(), *order))
    return rows.withColumn("seed", seed)


def odds(seeded: DataFrame, places: int, byes: int) -> DataFrame:
    s = F.col("seed")
    return seeded.groupBy("grp").agg(
        F.avg("wins").alias("mean_wins"), F.avg((s <= places).cast("double")).alias("playoff"), F.avg((s <= byes).cast("double")).alias("bye"),
        F.avg(F.col("division_winner").cast("double")).alias("division"),
        *[F.avg((s == i).cast("double")).alias(f"seed_{i}") for i in range(1, places + 1)])


def pick_failures(games: DataFrame, picks: Sequence[tuple[int, str]]) -> DataFrame:
    """Per scenario how many picks it violates and, if one, which: enough to condition with or without any pick."""
    miss = F.lit(False)
    for game, side in picks:
        wrong = (F.col("game") == game) & (~F.col("home_won") if side == "home" else F.col("home_won"))
        miss = miss | wrong
    return games.groupBy("scenario").agg(
        count_if(miss).alias("n_missed"), F.max(F.when(miss, F.col("game"))).alias("missed_game"))


def consistent(games: DataFrame, picks: Sequence[tuple[int, str]]) -> DataFrame:
    """Scenarios that hold every pick."""
    return pick_failures(games, picks).where(F.col("n_missed") == 0).select("scenario")


def home_share(games: DataFrame) -> DataFrame:
    return games.groupBy("game").agg(F.avg(F.col("home_won").cast("double")).alias("home_share"))


def _split(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hit rate with each side winning, and its support."""
    hw = F.col("home_won")
    return rows.groupBy(*by).agg(
        F.avg(F.when(hw, F.col("hit"))).alias("with_home"), F.avg(F.when(~hw, F.col("hit"))).alias("with_away"),
        count_if(hw).alias("n_home"), count_if(~hw).alias("n_away"))


def game_splits(seeded: DataFrame, games: DataFrame, places: int) -> DataFrame:
    hits = seeded.select("scenario", "grp", (F.col("seed") <= places).cast("double").alias("hit"))
    return _split(hits.join(games.select("scenario", "game", "home_won"), "scenario"), ["grp", "game"])


def _tier(baseline: str) -> dict[str, Column]:
    home, away = F.col("with_home"), F.col("with_away")
    swing = F.coalesce(F.abs(home - away), F.lit(0.0))
    best = F.when(swing >= FLAT_SWING, F.when(home > away, "home").otherwise("away"))
    low = F.least(home, away)
    enough = (F.col("n_home") >= MIN_SUPPORT) & (F.col("n_away") >= MIN_SUPPORT)
    must = (swing >= BIG_SWING) & (low <= F.greatest(F.lit(MUST_ABS), MUST_REL * F.coalesce(F.col(baseline), F.lit(0.0))))
    tier = F.when(best.isNull() | ~enough, "flat").when(must, "must").when(swing >= BIG_SWING, "big").otherwise("minor")
    return {"swing": swing, "best": best, "tier": tier, "worst_odds": F.when(best.isNotNull(), low)}


def leverage(seeded: DataFrame, games: DataFrame, picks: Sequence[tuple[int, str]], places: int) -> DataFrame:
    """Per group and game: odds with each side winning under the other picks, the side to root for and its tier."""
    failed = pick_failures(games, picks)
    hits = seeded.select("scenario", "grp", (F.col("seed") <= places).cast("double").alias("hit")).join(failed, "scenario")
    base = hits.where(F.col("n_missed") == 0).groupBy("grp").agg(F.avg("hit").alias("baseline"))
    rows = hits.join(games.select("scenario", "game", "home", "away", "home_won"), "scenario")
    counts = (F.col("n_missed") == 0) | ((F.col("n_missed") == 1) & (F.col("missed_game") == F.col("game")))
    split = _split(rows.where(counts), ["grp", "game", "home", "away"]).join(base, "grp")
    own = (F.col("home") == F.col("grp")) | (F.col("away") == F.col("grp"))
    return split.withColumns(_tier("baseline")).withColumn("own", own).withColumn(
        "picked", F.col("game").isin(*[g for g, _ in picks]) if picks else F.lit(False))


def must_haves(rows: DataFrame, by: Sequence[str], n: int = 4) -> DataFrame:
    """Unpicked must-have results, biggest loss first (a league's games per group, so small)."""
    w = Window.partitionBy(*by).orderBy(F.round("worst_odds", 9).asc(), F.col("game").asc())
    return rows.where((F.col("tier") == "must") & ~F.col("picked")).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def slip_branches(seeded: DataFrame, games: DataFrame, picks: Sequence[tuple[int, str]], places: int) -> DataFrame:
    """Assume each own unpicked game is lost: the odds left and what becomes a must-have then.

    One row per (group, lost game, needed game); a branch without needs has NULL there.
    """
    held = games.join(consistent(games, picks), "scenario", "left_semi") if picks else games
    hits = seeded.select("scenario", "grp", (F.col("seed") <= places).cast("double").alias("hit"))
    base = hits.join(held.select("scenario").distinct(), "scenario", "left_semi").groupBy("grp").agg(F.avg("hit").alias("before"))
    lost = group_results(held).where(~F.col("won"))
    if picks:
        lost = lost.where(~F.col("game").isin(*[g for g, _ in picks]))
    branch = lost.select("scenario", "grp", F.col("game").alias("lost_game")).join(hits, ["scenario", "grp"])
    facts = branch.groupBy("grp", "lost_game").agg(F.avg("hit").alias("after"), F.count(F.lit(1)).alias("n")).join(base, "grp")
    facts = facts.where((F.col("n") >= MIN_BRANCH) & (F.col("before") - F.col("after") >= BRANCH_DROP))
    split = _split(branch.join(held.select("scenario", "game", "home_won"), "scenario"), ["grp", "lost_game", "game"])
    rows = split.join(facts, ["grp", "lost_game"]).withColumns(_tier("after"))
    fixed = [g for g, _ in picks]
    rows = rows.withColumn("picked", (F.col("game") == F.col("lost_game")) | (F.col("game").isin(*fixed) if fixed else F.lit(False)))
    needs = must_haves(rows, ["grp", "lost_game"]).select("grp", "lost_game", "game", "best", "worst_odds", "pos")
    return facts.join(needs, ["grp", "lost_game"], "left")


def wins_ladder(seeded: DataFrame, places: int, byes: int) -> DataFrame:
    s = F.col("seed")
    rows = seeded.groupBy("grp", "wins").agg(
        F.count(F.lit(1)).alias("n"), F.avg((s <= places).cast("double")).alias("playoff"), F.avg((s <= byes).cast("double")).alias("bye"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def race_rows(seeded: DataFrame, places: int) -> DataFrame:
    """Scenarios in which a group is outside the safe seeds, with the bar it must clear and who sets it."""
    outside = seeded.where(F.col("seed") >= places)
    w = Window.partitionBy("scenario").orderBy(F.col("pf").desc(), F.col("grp").asc())
    ranked = outside.withColumn("_p", F.row_number().over(w))
    every = Window.partitionBy("scenario")
    def at(p: int, c: str) -> Column:
        return F.max(F.when(F.col("_p") == p, F.col(c))).over(every)
    first = F.col("_p") == 1
    rows = ranked.withColumns({
        "bar": F.when(first, at(2, "pf")).otherwise(at(1, "pf")), "rival": F.when(first, at(2, "grp")).otherwise(at(1, "grp"))})
    return rows.withColumn("gap", F.col("bar") - F.col("pf")).withColumn("via_last", (F.col("seed") == places).cast("double")).drop("_p")


def race(seeded: DataFrame, places: int) -> DataFrame:
    """Per group: share safe, share in by the last place, quartiles of the bar, own points and gap."""
    totals = seeded.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("seed") < places).cast("double")).alias("safe"))
    rows = race_rows(seeded, places)
    out = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("outside"), F.avg("via_last").alias("made_when_outside"))
    out = totals.join(out, "grp", "left")
    met = rows.where(F.col("bar").isNotNull())
    for value, tag in (("bar", "bar"), ("gap", "gap")):
        out = out.join(percentiles_any_size(met, ["grp"], value, {f"{tag}_p25": 0.25, f"{tag}_p50": 0.5, f"{tag}_p75": 0.75}), "grp", "left")
    return out


def rivals(seeded: DataFrame, places: int) -> DataFrame:
    """Who sets the bar how often, and by how much."""
    met = race_rows(seeded, places).where(F.col("rival").isNotNull())
    n = met.groupBy("grp", "rival").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))
    return n.join(percentiles_any_size(met, ["grp", "rival"], "gap", {"gap_p50": 0.5}), ["grp", "rival"])


def head_to_head(games: DataFrame, pool: str) -> DataFrame:
    """Win share against members of the same pool. Each game row already knows its opponent's pool."""
    inside = games.where(F.col(pool) == F.col(f"opp_{pool}"))
    won = F.when(F.col("result") == "W", 1.0).when(F.col("result") == "T", 0.5).otherwise(0.0)
    return inside.groupBy("season", pool, "manager").agg(F.avg(won).alias("h2h"), F.count(F.lit(1)).alias("h2h_games"))


def standings(rows: DataFrame, by: Sequence[str], division: str, criteria: Sequence[str]) -> DataFrame:
    """Ranking by a chain of criteria: division winners queue first, then everyone else."""
    order = [*[F.round(c, 9).desc_nulls_last() for c in criteria], F.col("manager").asc()]
    top = F.row_number().over(Window.partitionBy(*by, division).orderBy(*order)) == 1
    rows = rows.withColumn("division_winner", top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("division_winner").desc(), *order)))


def match_odds(matches: DataFrame, form: DataFrame) -> DataFrame:
    """Win probability of the home side from both sides' mean and SD."""
    home = form.select("season", F.col("grp"), F.col("mean").alias("_m1"), F.col("sd").alias("_s1"))
    away = form.select("season", F.col("grp").alias("opp"), F.col("mean").alias("_m2"), F.col("sd").alias("_s2"))
    rows = matches.join(home, ["season", "grp"]).join(away, ["season", "opp"])
    return rows.withColumn("p_home", win_probability(F.col("_m1"), F.col("_s1"), F.col("_m2"), F.col("_s2"))).withColumnRenamed(
        "_m1", "home_mean").withColumnRenamed("_m2", "away_mean").drop("_s1", "_s2")


def rest_of_season(odds_rows: DataFrame) -> DataFrame:
    """Expected remaining wins, losses and points per group from unplayed matches."""
    sides = odds_rows.withColumn("_s", F.explode(F.array(
        F.struct(F.col("grp").alias("g"), F.col("p_home").alias("p"), F.col("home_mean").alias("m")),
        F.struct(F.col("opp").alias("g"), (1 - F.col("p_home")).alias("p"), F.col("away_mean").alias("m")))))
    return sides.groupBy("season", F.col("_s.g").alias("grp")).agg(
        F.sum("_s.p").alias("exp_wins"), F.sum(1 - F.col("_s.p")).alias("exp_losses"), F.sum("_s.m").alias("exp_points"))
