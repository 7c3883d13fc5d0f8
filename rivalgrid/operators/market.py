"""Price statistics over classified bids (see ``events``). Percentiles are exact and skew-proof."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import count_if, shrink_to_one
from rivalgrid.operators.ranking import percentiles_any_size, row_numbers_any_size, running_sum_any_size, top_n_any_size

# Season phases, calibration edges, minimum counts.
WEEK_BUCKETS = ((1, 3), (4, 6), (7, 9), (10, 12), (13, 18))
CALIBRATION_EDGES = (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 1.0001)
THIN_N, POOLED_MIN_N, SHRINK_K = 8, 30, 10.0
ALL = "All"
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
FIVE_NUMBERS = {**QUARTILES, "p90": 0.9}


def week_bucket(week: str = "week") -> Column:
    out = F.lit(None).cast("string")
    for low, high in WEEK_BUCKETS:
        out = F.when(F.col(week).between(low, high), f"{low}-{high}").otherwise(out)
    return out


def edge_bucket(value: str, edges: Sequence[float]) -> Column:
    """Index of the half-open interval holding the value."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        out = F.when((F.col(value) >= low) & (F.col(value) < high), i).otherwise(out)
    return out


def contested_win() -> Column:
    return (F.col("kind") == "WAIVER") & (F.col("signal") == "won") & (F.col("bid") > 0) & F.col("pct").isNotNull()


def summarize(rows: DataFrame, by: Sequence[str], value: str, probs: dict[str, float] = FIVE_NUMBERS) -> DataFrame:
    """Count, mean and percentiles per group."""
    base = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return base.join(percentiles_any_size(rows, by, value, probs), list(by))


def grouping_cells(rows: DataFrame, value: str) -> DataFrame:
    """Grouping sets (), (category), (bucket), (category, bucket) of one measure.

    Equal values of a cell collapse first, so the four-fold expansion is of counts.
    """
    cells = rows.groupBy("category", "bucket", value).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    every = F.array(*[
        F.struct(c.alias("category"), k.alias("bucket"))
        for c in (F.lit(ALL), F.col("category")) for k in (F.lit(ALL), F.col("bucket"))
    ])
    return cells.withColumn("_k", F.explode(every)).select("_k.category", "_k.bucket", value, "_c")


def baseline_cells(rows: DataFrame, value: str = "pct") -> DataFrame:
    """Counts, means and percentiles of every grouping set."""
    by = ["category", "bucket"]
    cells = grouping_cells(rows, value).groupBy(*by, value).agg(F.sum("_c").alias("_c"))
    cum = running_sum_any_size(cells, by, [F.col(value).asc()], "_c", "_cum", "_n")

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= i) & (i < F.col("_cum")), F.col(value)))

    aggs = []
    for name, p in FIVE_NUMBERS.items():
        pos = (F.col("_n") - 1) * p
        low, high = F.floor(pos), F.ceil(pos)
        aggs.append((at(low) + (at(high) - at(low)) * F.max(pos - low)).alias(name))
    mean = (F.sum(F.col(value) * F.col("_c")) / F.max("_n")).alias("mean")
    return cum.groupBy(*by).agg(F.max("_n").cast("long").alias("n"), mean, *aggs)


def fallback_baseline(cells: DataFrame, baselines: DataFrame, min_n: int = POOLED_MIN_N) -> DataFrame:
    """For each (category, bucket): the first of cell, category, bucket, all with enough rows.

    The baseline table has one row per category and bucket, so the four candidates are read from
    two aggregated maps of it.
    """
    good = baselines.where(F.col("n") >= min_n)
    def level(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return df.select(*keys, F.struct(F.lit(tag).alias("level"), F.col("n").alias("pool_n"), F.col("p50").alias("pool_p50")).alias(f"_{tag}"))
    cat = level(good.where((F.col("category") != ALL) & (F.col("bucket") == ALL)), ["category"], "category")
    buck = level(good.where((F.col("category") == ALL) & (F.col("bucket") != ALL)), ["bucket"], "bucket")
    cell = level(good.where((F.col("category") != ALL) & (F.col("bucket") != ALL)), ["category", "bucket"], "cell")
    # the grand total is one row, so a scalar
    top = level(good.where((F.col("category") == ALL) & (F.col("bucket") == ALL)), [], "all")
    rows = cells.join(cell, ["category", "bucket"], "left").join(cat, "category", "left").join(buck, "bucket", "left").withColumn("_all", top.scalar())
    return rows.withColumn("_g", F.coalesce("_cell", "_category", "_bucket", "_all")).select(*cells.columns, "_g.*")


def ratio_stats(local: DataFrame) -> DataFrame:
    """Local median over pooled median, shrunk towards 1 for few rows. Input: n, p50, pool_p50."""
    r = F.when(F.col("pool_p50") > 0, F.col("p50") / F.col("pool_p50"))
    return local.withColumn("ratio", r).withColumn("shrunk", shrink_to_one(F.col("ratio"), "n", SHRINK_K)).withColumn(
        "thin", (F.col("n") < THIN_N) | F.col("ratio").isNull())


def contest_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share contested, bidders per auction, median margin, share of losing claims."""
    won, outbid = F.col("signal") == "won", F.col("signal") == "outbid"
    claims = rows.where((F.col("kind") == "WAIVER") & (won | outbid)).withColumn(
        "_margin", F.when(won & (F.col("n_bids") >= 2) & F.col("runner_up").isNotNull() & (F.col("budget") > 0),
                          (F.col("win_bid") - F.col("runner_up")) / F.col("budget")))
    base = claims.groupBy(*by).agg(
        count_if(won).alias("auctions"),
        F.avg(F.when(won, (F.col("n_bids") >= 2).cast("double"))).alias("contested_share"),
        F.avg(F.when(won, F.col("n_bids"))).alias("avg_bidders"),
        F.avg(outbid.cast("double")).alias("outbid_share"))
    return base.join(percentiles_any_size(claims, by, "_margin", {"median_margin": 0.5}), list(by), "left")


def team_tendencies(rows: DataFrame, by: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Per team: claims, wins, spend, median price, overpay, biggest win, wins by category."""
    waiver = F.col("kind") == "WAIVER"
    won, outbid = F.col("signal") == "won", F.col("signal") == "outbid"
    win = waiver & won
    rows = rows.withColumns({
        "_pct": F.when(win & F.col("pct").isNotNull() & (F.col("bid") > 0), F.col("pct")),
        "_over": F.when(win & F.col("runner_up").isNotNull() & (F.col("budget") > 0), (F.col("win_bid") - F.col("runner_up")) / F.col("budget")),
    })
    base = rows.groupBy(*by).agg(
        count_if(waiver & (won | outbid)).alias("bids"), count_if(win).alias("wins"), count_if(waiver & outbid).alias("outbid"),
        count_if(~waiver & won).alias("free_adds"), F.sum(F.when(win, F.col("cost")).otherwise(0.0)).alias("spend"),
        F.max(F.when(win, F.col("bid"))).alias("biggest"),
        *[count_if(win & (F.col("category") == c)).alias(f"wins_{c}") for c in categories])
    base = base.withColumn("win_rate", F.when(F.col("bids") > 0, F.col("wins") / F.col("bids")))
    pct = percentiles_any_size(rows, by, "_pct", {"median_win_pct": 0.5})
    over = percentiles_any_size(rows, by, "_over", {"median_overpay": 0.5})
    return base.join(pct, list(by), "left").join(over, list(by), "left")


def spend_by_week(rows: DataFrame, last_week: int) -> DataFrame:
    """Share of each season's spend per week, averaged over seasons, and the running share."""
    spend = rows.where((F.col("signal") == "won") & (F.col("cost") > 0)).groupBy(
        "season", F.least(F.col("week"), F.lit(last_week)).alias("week")).agg(F.sum("cost").alias("_v"))
    shares = spend.withColumn("_s", F.col("_v") / F.sum("_v").over(Window.partitionBy("season")))
    # one row per season and week of the calendar, empty weeks share nothing
    grid = spend.select("season").distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(last_week))))
    by_week = grid.join(shares, ["season", "week"], "left").groupBy("week").agg(
        (F.coalesce(F.sum("_s"), F.lit(0.0)) / F.count(F.lit(1))).alias("share"))
    running = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return by_week.withColumn("cumulative", F.sum("share").over(running))


def miss_stats(pairs: DataFrame, within: float = 0.03) -> DataFrame:
    """Prediction error per category and over all: medians, bias, absolute error, share within reach."""
    rows = pairs.withColumn("category", F.explode(F.array(F.lit(ALL), F.col("category")))).withColumns(
        {"miss": F.col("actual") - F.col("pred")})
    base = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("miss")).alias("mae"),
        F.avg((F.abs("miss") <= within).cast("double")).alias("within"))
    for column, name in (("pred", "med_pred"), ("actual", "med_actual"), ("miss", "bias")):
        base = base.join(percentiles_any_size(rows, ["category"], column, {name: 0.5}), "category")
    return base


def calibration(points: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Predicted against actual rate per probability bucket."""
    return points.withColumn("bin", edge_bucket(p, CALIBRATION_EDGES)).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("actual"))


def local_lens(wins: DataFrame, baselines: DataFrame, last: int = 6, own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per (source, category, bucket): ratio from the cell when it has enough wins, else from the category;
    and the latest comparable wins of the cell in use. ``own`` are the same wins with their tid, where
    ``wins`` come without it."""
    cell = summarize(wins, ["source", "category", "bucket"], "pct", {"p50": 0.5})
    whole = summarize(wins, ["source", "category"], "pct", {"p50": 0.5})
    both = cell.select("source", "category", "bucket", F.col("n").alias("cell_n"), F.col("p50").alias("cell_p50")).join(
        whole.select("source", "category", "n", "p50"), ["source", "category"])
    thick = F.col("cell_n") >= THIN_N
    chosen = both.select(
        "source", "category", "bucket", F.when(thick, "bucket").otherwise("position").alias("basis"),
        F.when(thick, F.col("cell_n")).otherwise(F.col("n")).alias("n"),
        F.when(thick, F.col("cell_p50")).otherwise(F.col("p50")).alias("p50"))
    keyed = chosen.withColumnRenamed("bucket", "_b").withColumn("bucket", F.when(F.col("basis") == "bucket", F.col("_b")).otherwise(ALL))
    lens = ratio_stats(fallback_baseline(keyed, baselines)).drop("bucket").withColumnRenamed("_b", "bucket")
    return lens, latest(wins if own is None else own, ["source", "category", "bucket"], last)


def latest(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The n latest rows of each group, newest periods first."""
    order = [F.col("season").desc(), F.col("week").desc(), F.col("tid").asc()]
    return top_n_any_size(rows, by, order, "tid", n)


def cluster_values(rows: DataFrame, by: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Group sorted values whose gap to the previous value stays within the tolerance.

    Equal values collapse first. The previous value is found by rank, and the running count of
    gaps is a distributed prefix sum, so a group may hold any number of values.
    """
    distinct = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = row_numbers_any_size(distinct, by, [F.col(value).asc()], "_r")
    before = ranked.select(*by, (F.col("_r") + 1).alias("_r"), F.col(value).alias("_prev"))
    gap = F.col(value) - F.col("_prev")
    marked = ranked.join(before, [*by, "_r"], "left").withColumn(
        "_new", F.when(F.col("_prev").isNull() | (gap > tolerance), 1.0).otherwise(0.0))
    islands = running_sum_any_size(marked, by, [F.col(value).asc()], "_new", "_island")
    return islands.groupBy(*by, F.col("_island").cast("int").alias("cluster")).agg(
        F.sum("_c").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
