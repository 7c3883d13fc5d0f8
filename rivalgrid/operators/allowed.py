"""What groups concede by category, measured against what their opponents usually do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import clamp
from rivalgrid.functions.scoring import compile_rules, needed_columns, with_stat_columns
from rivalgrid.operators.grids import with_opponent
from rivalgrid.operators.ranking import leave_one_out, rank_by_category, row_numbers_any_size, trailing

CELL = ["season", "week", "category"]
UNIT = ["season", "grp", "category"]


def points_by_group(rows: DataFrame, pts: str = "pts") -> DataFrame:
    return rows.groupBy("season", "week", "grp", "category").agg(F.sum(pts).alias("pts"))


def conceded(dense: DataFrame) -> DataFrame:
    """The opponent's points of the same period, per defending group."""
    return with_opponent(dense, CELL, {"pts": "allowed"})


def allowed_cells(dense: DataFrame, alone: float | None = None) -> DataFrame:
    """Conceded points with the opponent's usual (its average in its other games)."""
    return with_opponent(leave_one_out(dense, UNIT, "pts", "usual", alone), CELL, {"pts": "allowed", "usual": "opp_usual"})


def league_average(dense: DataFrame) -> DataFrame:
    return dense.groupBy("season", "category").agg(F.avg("pts").alias("league_avg"))


def opponents_usual(dense: DataFrame) -> DataFrame:
    """Average of the faced opponents' leave-one-out averages (0 for an opponent with one game)."""
    return allowed_cells(dense, alone=0.0).groupBy(*UNIT).agg(F.avg("opp_usual").alias("opp_avg"))


def mean_ratio_index(dense: DataFrame, last: int | None = None) -> DataFrame:
    """Mean of per-period ratios to the opponent's usual, and mean conceded, over all or the last n periods."""
    cells = allowed_cells(dense, alone=0.0)
    if last:
        cells = trailing(cells, UNIT, "week", last)
    share = F.when(F.col("opp_usual") > 0, F.col("allowed") / F.col("opp_usual"))
    return cells.groupBy(*UNIT).agg(
        F.coalesce(F.avg(share), F.lit(1.0)).alias("mean_ratio"), F.avg("allowed").alias("allowed_avg")
    )


def _season_facts(dense: DataFrame, last: int) -> DataFrame:
    """Per (season, group, category): average conceded, last-n conceded, opponents' usual, ratio, factor."""
    cells = allowed_cells(dense, alone=0.0)
    back = F.row_number().over(Window.partitionBy(*UNIT).orderBy(F.col("week").desc()))
    facts = cells.withColumn("_back", back).groupBy(*UNIT).agg(
        F.avg("allowed").alias("allowed"),
        F.avg(F.when(F.col("_back") <= last, F.col("allowed"))).alias("last_allowed"),
        F.avg("opp_usual").alias("opp_avg"),
    )
    return facts.join(league_average(dense), ["season", "category"])


def matchup_index(
    dense: DataFrame,
    season: int,
    complete: DataFrame,
    *,
    basis: str = "blend",
    last: int = 5,
    last_weight: float = 0.4,
    prior_weeks: int = 4,
    bounds: tuple[float, float] = (0.5, 1.5),
) -> DataFrame:
    """Opponent-adjusted index of ``season``: ratio of averages, blended with the season before it.

    Each season is measured on its own schedule. ``complete`` is (season, weeks_complete); the
    weight of the current season grows with it. Groups without a game this season keep the prior
    ratio; without any data the index is 1.
    """
    facts = _season_facts(dense.where(F.col("season").isin(season, season - 1)), last)
    per_basis: dict[str, Column] = {
        "season": F.col("allowed"),
        "last": F.col("last_allowed"),
        "blend": last_weight * F.col("last_allowed") + (1 - last_weight) * F.col("allowed"),
    }
    known = F.col("opp_avg") > 0
    keys = ["grp", "category"]
    current = facts.where(F.col("season") == season).select(
        *keys, "allowed", "last_allowed", F.col("league_avg"), "opp_avg",
        F.when(known, per_basis[basis] / F.col("opp_avg")).otherwise(1.0).alias("cur_ratio"),
        F.when(known, F.col("league_avg") / F.col("opp_avg")).otherwise(1.0).alias("factor"),
    )
    prior = facts.where(F.col("season") == season - 1).select(
        *keys, F.when(known, F.col("allowed") / F.col("opp_avg")).otherwise(1.0).alias("prior_ratio")
    )
    weight = complete.select(
        "season", F.least(F.col("weeks_complete") / F.lit(float(max(prior_weeks, 1))), F.lit(1.0)).alias("w")
    )
    rows = current.join(prior, keys, "full").withColumn("season", F.lit(season)).join(weight, "season", "left")
    w = F.coalesce(F.col("w"), F.lit(0.0)) if prior_weeks > 0 else F.lit(1.0)
    blended = w * F.coalesce("cur_ratio", F.lit(1.0)) + (1 - w) * F.coalesce("prior_ratio", F.lit(1.0))
    out = rows.select(
        *keys, clamp(blended, *bounds).alias("idx"), "allowed", "last_allowed",
        F.coalesce("factor", F.lit(1.0)).alias("factor"),
        (F.col("allowed") * F.coalesce("factor", F.lit(1.0))).alias("adjusted"),
        F.when(w >= 1, F.lit(season)).otherwise(F.lit(season - 1)).alias("season_used"),
    )
    return rank_by_category(out, ["category"], "idx", ["grp"])


def schedule_strength(
    index: DataFrame, sched: DataFrame, windows: dict[str, tuple[int, int]], value: str = "idx",
    bounds: tuple[float, float] | None = (0.5, 1.5), default: float | None = 1.0,
) -> DataFrame:
    """Average index of the scheduled opponents over named week windows, ranked (1 = softest)."""
    spans = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in windows.items()
    ])
    faced = (
        sched.where(F.col("opp").isNotNull())
        .withColumn("_w", F.explode(F.filter(spans, lambda s: (F.col("week") >= s["lo"]) & (F.col("week") <= s["hi"]))))
        .select("grp", "opp", F.col("_w.n").alias("win"))
    )
    table = index.select(F.col("grp").alias("opp"), "category", F.col(value).alias("_v"))
    v = clamp("_v", *bounds) if bounds else F.col("_v")
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    out = faced.join(table, "opp").groupBy("win", "category", "grp").agg(
        F.avg(v).alias("avg_idx"), F.count(F.lit(1)).alias("n_games")
    )
    return rank_by_category(out, ["win", "category"], "avg_idx", ["grp"])


def allowed_table(dense: DataFrame, last: int = 5) -> DataFrame:
    """Per (season, category, group): conceded per game, difference to opponents' usual, last-n variants, ranks."""
    cells = allowed_cells(dense)
    back = F.row_number().over(Window.partitionBy(*UNIT).orderBy(F.col("week").desc()))
    diff = F.col("allowed") - F.col("opp_usual")
    late = F.col("_back") <= last
    out = cells.withColumn("_back", back).groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("games"),
        F.sum("allowed").alias("total"),
        F.avg("allowed").alias("per_game"),
        F.avg(diff).alias("diff"),
        F.avg("opp_usual").alias("opp_avg"),
        F.avg(F.when(late, F.col("allowed"))).alias("last_n"),
        F.avg(F.when(late, F.col("opp_usual"))).alias("last_opp_avg"),
        F.avg(F.when(late, diff)).alias("last_diff"),
    )
    for value, name in (("per_game", "rank"), ("diff", "diff_rank"), ("last_diff", "last_diff_rank")):
        out = rank_by_category(out, ["season", "category"], value, ["grp"], name)
    return out


def allowed_detail(members: DataFrame, games: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Per defending group, period and category: totals, member count and the best member."""
    totals = members.groupBy("season", "week", F.col("grp").alias("opp"), "category").agg(
        F.sum("pts").alias("allowed"), *[F.sum(s).alias(s) for s in stats], F.count(F.lit(1)).alias("n_members"),
        F.min(F.struct((-F.col("pts")).alias("k"), "entity")).alias("_top"))
    return games.join(totals, ["season", "week", "opp"]).withColumn("top_entity", F.col("_top.entity")).drop("_top")


def allowed_members(members: DataFrame, games: DataFrame, stats: Sequence[str]) -> DataFrame:
    """The members behind those totals in long form, best first; a group may have any number of them."""
    cell = ["season", "week", "grp", "category"]
    ranked = row_numbers_any_size(members.select(*cell, "entity", "pts", *stats), cell, [F.col("pts").desc(), F.col("entity").asc()], "pos")
    return games.join(ranked.withColumnRenamed("grp", "opp"), ["season", "week", "opp"])


def unit_rows(groups: DataFrame, rules: Sequence[tuple[str, float]]) -> DataFrame:
    """Score unit rows in the context of the opponent's row of the same game."""
    rows = with_opponent(groups, ["season", "week"], {"own_score": "points_allowed", "yards": "yards_allowed"})
    rows = with_stat_columns(rows, needed_columns([r[0] for r in rules], unit=True))
    return rows.withColumn("unit_pts", compile_rules(rules, unit=True))


def chart_series(dense: DataFrame) -> DataFrame:
    """Week series of a group: conceded, the opponent's usual, the category's flat league average."""
    cells = allowed_cells(dense)
    flat = F.avg("pts").over(Window.partitionBy("season", "category"))
    return cells.withColumn("league", flat)


def pivot_categories(table: DataFrame, by: Sequence[str], categories: Sequence[str], value: str) -> DataFrame:
    """Group x category grid with the row total."""
    total = None
    wide = table.groupBy(*by).pivot("category", list(categories)).agg(F.first(value))
    for c in categories:
        cell = F.coalesce(F.col(c), F.lit(0.0))
        total = cell if total is None else total + cell
    return wide.withColumn("total", total)


def all_or_null(table: DataFrame, by: Sequence[str], categories: int, values: Sequence[str]) -> DataFrame:
    """Sum over all categories; NULL when any category is missing or NULL."""
    return table.groupBy(*by).agg(*[
        F.when(F.count(v) == categories, F.sum(v)).alias(v) for v in values
    ])
