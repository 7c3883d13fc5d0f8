"""Estimates from nearest comparables. A neighbour set has at most k rows, so windows over it are small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import credibility
from rivalgrid.operators.neighbours import nearest
from rivalgrid.operators.ranking import band_sums, cumulative_share, percentiles_any_size, row_numbers_any_size
from rivalgrid.session import cut_lineage

SHRINK_K = 15.0
CAP_RATIO = 5.0
NEAR_OFFSET = 0.05
# Values of an event's wins that travel as one list.
PACK = 256


def distance_cutoffs(pool: DataFrame, k: int, share: float = 0.85) -> DataFrame:
    """Per category, the ``share`` percentile of each row's own k-th neighbour distance."""
    own = nearest(pool, pool, k, skip_self=True)
    kth = own.groupBy("category", "qid").agg(F.max("dist").alias("kth"))
    return percentiles_any_size(kth, ["category"], "kth", {"cutoff": share})


def _per_query() -> Window:
    return Window.partitionBy("category", "qid")


def base_weight() -> Column:
    return 1.0 / (F.col("dist") + NEAR_OFFSET)


def shrunk_rates(comps: DataFrame) -> DataFrame:
    """Acting share of each neighbour, shrunk towards the pooled share of the other neighbours."""
    w = _per_query()
    acting, eligible = F.col("acting").cast("double"), F.col("eligible").cast("double")
    others = F.sum(eligible).over(w) - eligible
    prior = F.when(others > 0, (F.sum(acting).over(w) - acting) / others).otherwise(0.0)
    return comps.withColumn("rate", (acting + SHRINK_K * prior) / (eligible + SHRINK_K))


def interest_estimate(comps: DataFrame) -> DataFrame:
    """P(any bid) per query: distance-weighted mean of shrunk rates."""
    rows = shrunk_rates(comps).withColumn("w", base_weight())
    return rows.groupBy("category", "qid").agg((F.sum(F.col("w") * F.col("rate")) / F.sum("w")).alias("probability"))


def price_weights(comps: DataFrame) -> DataFrame:
    """Distance weight x credibility; a capped twin where no weight exceeds 5 times the smallest."""
    rows = comps.withColumn("w", base_weight() * credibility("backing"))
    capped = F.least(F.col("w"), F.min("w").over(_per_query()) * CAP_RATIO)
    rows = rows.withColumn("w_capped", F.when(F.count(F.lit(1)).over(_per_query()) < 2, F.col("w")).otherwise(capped))
    share = F.col("w_capped") / F.sum("w_capped").over(_per_query())
    return rows.withColumn("w_share", share)


def weighted_median(rows: DataFrame, value: str, weight: str, name: str, by: list[str], tie: Sequence[str] = ("id",)) -> DataFrame:
    """First value at which half of the weight is reached (neighbour sets are small)."""
    w = Window.partitionBy(*by)
    run = w.orderBy(value, *tie).rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumn("_cum", F.sum(weight).over(run)).withColumn("_all", F.sum(weight).over(w))
    return cum.groupBy(*by).agg(
        F.min(F.when(F.col("_cum") >= F.col("_all") * 0.5 * (1 - 1e-12), F.col(value))).alias(name))


def packed_wins(wins: DataFrame, most: int = PACK) -> DataFrame:
    """The values of each event's wins as lists of at most ``most``: (id, _wins, _values), where _wins counts
    all wins of the event. An event of any size is many short lists, never one long one."""
    event = Window.partitionBy("id")
    placed = wins.where(F.col("id").isNotNull()).select("id", "value").withColumns({
        "_wins": F.count(F.lit(1)).over(event), "_pack": F.floor((F.row_number().over(event.orderBy("value")) - 1) / most)})
    unknown = F.count(F.lit(1)) - F.count("value")
    # a list leaves NULLs out, but a win of unknown value takes its share of the weight
    values = F.concat(F.collect_list("value"), F.array_repeat(F.lit(None).cast("double"), unknown.cast("int")))
    return placed.groupBy("id", "_pack").agg(F.max("_wins").alias("_wins"), values.alias("_values")).drop("_pack")


def confidence_samples(comps: DataFrame, wins: DataFrame) -> DataFrame:
    """Each neighbour's weight split evenly over its event's real wins: (category, qid, value, weight).

    Lists of values travel to the events' neighbours and on to their queries; only there, where all samples
    of a query are together, do they become rows.
    """
    packs = cut_lineage(packed_wins(wins))
    met = comps.select("category", "qid", "id", "w_capped").join(packs, "id").select(
        "category", "qid", (F.col("w_capped") / F.col("_wins")).alias("weight"), "_values")
    return met.repartition("qid").select("category", "qid", F.explode("_values").alias("value"), "weight")


def price_estimate(comps: DataFrame, wins: DataFrame | None = None) -> DataFrame:
    """Mean, capped weighted median and, with the events' wins, the flattened median per query."""
    by = ["category", "qid"]
    rows = price_weights(comps)
    out = rows.groupBy(*by).agg(
        (F.sum(F.col("w") * F.col("target")) / F.sum("w")).alias("price_mean"), F.count(F.lit(1)).alias("n_comps"))
    out = out.join(weighted_median(rows, "target", "w_capped", "price_median", by), by)
    if wins is not None:
        # equal values pool their weight first, so no order among them is needed
        pooled = confidence_samples(rows, wins).groupBy(*by, "value").agg(F.sum("weight").alias("weight"))
        out = out.join(weighted_median(pooled, "value", "weight", "price_flattened", by, tie=()), by, "left")
    return out


def heaviest(comps: DataFrame, n: int = 5) -> DataFrame:
    """The n neighbours with the largest capped weight share."""
    w = _per_query().orderBy(F.round("w_share", 9).desc(), F.col("id"))
    return price_weights(comps).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def usage_percentile(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Mean of two within-category percentile ranks."""
    rows = cumulative_share(rows, ["category"], first, "_p1")
    rows = cumulative_share(rows, ["category"], second, "_p2")
    return rows.withColumn("usage", (F.col("_p1") + F.col("_p2")) / 2).drop("_p1", "_p2")


def usage_band_estimate(rows: DataFrame, reach: float = 0.05) -> DataFrame:
    """Average outcome of the rows within ``reach`` of each row's usage percentile."""
    counted = rows.withColumn("_one", F.lit(1.0))
    sums = band_sums(counted, ["category"], "id", "usage", reach + 1e-9, {"outcome": "_s", "_one": "n"})
    return sums.withColumn("estimate", F.col("_s") / F.col("n")).drop("_s")


def holdout_split(rows: DataFrame, strata: list[str], key: Column, fraction: float, seed: int, forced: Column) -> DataFrame:
    """Reproducible hold-out per stratum by hashed key; rows matching ``forced`` always train.

    Rows are keyed by event, so all rows of one event fall on one side.
    """
    events = rows.where(~forced).select(*strata, key.alias("_key")).distinct()
    hashed = events.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("_key"))))
    ranked = row_numbers_any_size(hashed, strata, [F.col("_h").asc(), F.col("_key").asc()], "_r")
    sizes = events.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    test = ranked.join(sizes, strata).where(F.col("_r") <= F.round(F.col("_n") * fraction)).select(*strata, "_key", F.lit(True).alias("_t"))
    out = rows.withColumn("_key", key).join(test, [*strata, "_key"], "left")
    return out.withColumn("is_test", F.coalesce("_t", F.lit(False)) & ~forced).drop("_t", "_key")


def interest_level(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """high / medium / low by percentile thresholds 0.85 and 0.5."""
    shared = cumulative_share(rows, by, value, "_p")
    level = F.when(F.col("_p") >= 0.85, "high").when(F.col("_p") >= 0.5, "medium").otherwise("low")
    return shared.withColumn("level", level).drop("_p")
