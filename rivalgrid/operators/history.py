"""Season history: confidence, power tables, schedule swaps, all-time records.

Game rows: season, week, manager, pf, opp, pa, result, playoff.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import count_if
from rivalgrid.operators.ranking import percentiles_any_size, row_numbers_any_size, running_sums_any_size


def result_of(stored: str = "result") -> Column:
    """A stored result wins over the one the points say."""
    derived = F.when(F.col("pf") > F.col("pa"), "W").when(F.col("pf") < F.col("pa"), "L").otherwise("T")
    return F.when(F.col(stored).isin("W", "L", "T"), F.col(stored)).otherwise(derived)


def value_positions(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: how many samples lie below, how many are equal, how many there are."""
    per = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("equal"))
    cum = running_sums_any_size(per, by, [F.col(value).asc()], {"equal": "_upto"}, {"equal": "n"})
    return cum.select(*by, value, (F.col("_upto") - F.col("equal")).alias("below"), "equal", "n")


def in_sample_confidence() -> Column:
    """(below + half of the equal others) / (n - 1)."""
    return F.when(F.col("n") > 1, (F.col("below") + 0.5 * (F.col("equal") - 1)) / (F.col("n") - 1)).otherwise(0.5)


def confidence(samples: DataFrame, by: Sequence[str], value: str, name: str = "confidence") -> DataFrame:
    table = value_positions(samples, by, value).select(*by, value, in_sample_confidence().alias(name))
    return samples.join(table, [*by, value], "left")


def confidence_of_probes(samples: DataFrame, probes: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Confidence of values that are not part of the sample: below + half of the equal, over n.

    Probes are sorted in among the samples twice (before and after equal values) and read the
    prefix count there.
    """
    data = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    rows = data.select(*by, F.col(value).alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast(probes.schema[key].dataType).alias(key), "_c")
    for kind in (0, 2):
        rows = rows.unionByName(probes.select(*by, F.col(value).alias("_x"), F.lit(kind).alias("_kind"), key, F.lit(0.0).alias("_c")))
    cum = running_sums_any_size(
        rows, by, [F.col("_x").asc(), F.col("_kind").asc(), F.col(key).asc()], {"_c": "_upto"}, {"_c": "_n"})
    return cum.where(F.col("_kind") != 1).groupBy(*by, key).agg(
        F.when(F.max("_n") > 0, F.avg("_upto") / F.max("_n")).otherwise(0.5).alias("confidence"))


def confidence_curve(samples: DataFrame, by: Sequence[str], value: str, points: int = 90) -> DataFrame:
    """Every step-th sorted value with its confidence, closed by the maximum at 1."""
    table = value_positions(samples, by, value).withColumn("confidence", in_sample_confidence())
    step = F.greatest(F.lit(1.0), F.floor(F.col("n") / points))
    # the value covers positions below .. below + equal - 1; it is kept when a step falls inside
    kept = table.where(F.ceil(F.col("below") / step) * step < F.col("below") + F.col("equal"))
    top = table.groupBy(*by).agg(F.max(value).alias(value)).withColumn("confidence", F.lit(1.0))
    return kept.select(*by, value, "confidence").join(top.select(*by, value), [*by, value], "left_anti").unionByName(
        top.select(*by, value, "confidence"))


def read_off_curve(rows: DataFrame, curve: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Linear interpolation between bracketing curve points; below the first point scaled to 0, above the last 1.

    A curve has at most about 90 points, so it travels as one array per key.
    """
    table = curve.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("x"), F.col("confidence").alias("y")))).alias("_curve"))
    x = F.col(value)
    low = F.try_element_at(F.filter("_curve", lambda p: p["x"] < x), F.lit(-1))
    high = F.try_element_at(F.filter("_curve", lambda p: p["x"] >= x), F.lit(1))
    between = low["y"] + (high["y"] - low["y"]) * (x - low["x"]) / (high["x"] - low["x"])
    first = high["y"] * F.when(high["x"] != 0, x / high["x"]).otherwise(1.0)
    return rows.join(table, list(by), "left").withColumn(
        name, F.when(high.isNull(), 1.0).when(low.isNull(), first).otherwise(between)).drop("_curve")


def power_weeks(games: DataFrame) -> DataFrame:
    """Competition ranks of points for and against and the all-play share, per week (a week is one league's size)."""
    week = Window.partitionBy("season", "week")
    below = F.rank().over(week.orderBy("pf")) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy("season", "week", "pf"))
    n = F.count(F.lit(1)).over(week)
    return games.withColumns({
        "pf_rank": F.rank().over(week.orderBy(F.col("pf").desc())),
        "pa_rank": F.when(F.col("pa").isNotNull(), F.rank().over(week.orderBy(F.col("pa").asc_nulls_last()))),
        "all_play": F.when(n > 1, (below + 0.5 * (ties - 1)) / (n - 1))})


def power_table(games: DataFrame) -> DataFrame:
    return power_weeks(games).groupBy("season", "manager").agg(
        F.avg("pf_rank").alias("avg_pf_rank"), F.avg("pa_rank").alias("avg_pa_rank"), F.sum("all_play").alias("exp_wins"))


def schedule_swap(games: DataFrame) -> DataFrame:
    """Record of each manager on each other's schedule: (season, manager, schedule, w, l, t, subbed).

    The answer is this square per season; weeks meet on (season, week) and collapse in the map-side
    aggregate. Facing oneself is replaced by the average of the rest of the league that week.
    """
    w = Window.partitionBy("season", "week")
    n = F.count(F.lit(1)).over(w)
    mine = games.select("season", "week", "manager", "pf", ((F.sum("pf").over(w) - F.col("pf")) / (n - 1)).alias("_rest"))
    theirs = games.select("season", "week", F.col("manager").alias("schedule"), F.col("opp").alias("_opp"), F.col("pa").alias("_pa"))
    rows = mine.join(theirs, ["season", "week"])
    self_met = (F.col("schedule") != F.col("manager")) & (F.col("_opp") == F.col("manager"))
    against = F.when(self_met, F.col("_rest")).otherwise(F.col("_pa"))
    return rows.withColumn("_d", F.col("pf") - against).groupBy("season", "manager", "schedule").agg(
        count_if(F.col("_d") > 0).alias("w"), count_if(F.col("_d") < 0).alias("l"), count_if(F.col("_d") == 0).alias("t"),
        count_if(self_met).alias("subbed"))


def swap_summary(swaps: DataFrame) -> DataFrame:
    """Actual, best, worst, average wins over all schedules, and luck."""
    wins = F.col("w") + 0.5 * F.col("t")
    out = swaps.groupBy("season", "manager").agg(
        F.max(F.when(F.col("schedule") == F.col("manager"), wins)).alias("actual"),
        F.max(wins).alias("best"), F.min(wins).alias("worst"), F.avg(wins).alias("average"))
    return out.withColumn("luck", F.col("actual") - F.col("average"))


def all_time(games: DataFrame) -> DataFrame:
    """One row per manager over all seasons. ``conf_pf`` / ``conf_pa`` are confidences of the scores."""
    rows = games.withColumn("_res", result_of())
    latest = games.agg(F.max("season")).first()[0]
    def bands(c: str, tag: str) -> list[Column]:
        edges = ((0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.0))
        hit = [((F.col(c) >= lo) & ((F.col(c) < hi) | ((F.col(c) == 1.0) if hi == 1.0 else F.lit(False)))) for lo, hi in edges]
        return [F.avg(h.cast("double")).alias(f"{tag}_band{i + 1}") for i, h in enumerate(hit)]
    won, lost = F.col("_res") == "W", F.col("_res") == "L"
    out = rows.groupBy("manager").agg(
        F.max((F.col("season") == latest)).alias("active"), F.count(F.lit(1)).alias("games"), count_if(won).alias("w"), count_if(lost).alias("l"),
        count_if(F.col("_res") == "T").alias("t"), F.avg("conf_pf").alias("avg_conf_pf"), F.avg("conf_pa").alias("avg_conf_pa"),
        F.avg("pf").alias("pf_avg"), F.stddev_pop("pf").alias("pf_sd"), F.min("pf").alias("pf_min"), F.max("pf").alias("pf_max"),
        F.avg("pa").alias("pa_avg"), F.stddev_pop("pa").alias("pa_sd"), F.min("pa").alias("pa_min"), F.max("pa").alias("pa_max"),
        F.min(F.when(won, F.col("pf"))).alias("lowest_win"), F.max(F.when(lost, F.col("pf"))).alias("highest_loss"),
        *bands("conf_pf", "pf"), *bands("conf_pa", "pa"))
    out = out.withColumns({
        "win_pct": (F.col("w") + 0.5 * F.col("t")) / F.col("games"),
        "pf_cov": F.when(F.col("pf_sd") > 0, F.col("pf_sd") / F.col("pf_avg")),
        "pa_cov": F.when(F.col("pa_sd") > 0, F.col("pa_sd") / F.col("pa_avg"))})
    for c in ("pf", "pa"):
        out = out.join(percentiles_any_size(rows, ["manager"], c, {f"{c}_median": 0.5}), "manager", "left")
    return out


def season_scoring(games: DataFrame) -> DataFrame:
    base = games.groupBy("season").agg(
        F.count_distinct("manager").alias("teams"), F.avg("pf").alias("mean"), F.stddev_pop("pf").alias("sd"),
        F.min("pf").alias("low"), F.max("pf").alias("high"))
    return base.join(percentiles_any_size(games, ["season"], "pf", {"median": 0.5}), "season")


def histogram(games: DataFrame, by: Sequence[str], value: str, width: float) -> DataFrame:
    return games.groupBy(*by, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def detect_eras(seasons: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number the eras: a new one starts when a known signature differs from the last known one.

    One row per season, so windows run over a handful of rows per source.
    """
    w = Window.partitionBy(*by).orderBy("season")
    before = F.last("signature", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    change = (first | (F.col("signature").isNotNull() & ~F.col("signature").eqNullSafe(before))).cast("int")
    return seasons.withColumn("_change", change).withColumn("era", F.sum("_change").over(w)).drop("_change")


def name_spans(rows: DataFrame, name: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """First and last season and row count per name, aliases applied first."""
    if aliases:
        rows = rows.replace(aliases, subset=[name])
    return rows.groupBy(name).agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count(F.lit(1)).alias("n"))


def with_and_without_playoffs(games: DataFrame) -> DataFrame:
    """Each game in the pools it belongs to, so one query serves both."""
    pools = F.when(F.col("playoff"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("regular")))
    return games.withColumn("pool", F.explode(pools))


