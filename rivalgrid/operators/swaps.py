"""Choosing among scored trades, roster repair and odds scores; ``trades`` works the scores out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalgrid.operators.ranking import first_row, top_n_any_size


def rest_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "entity", "category").agg(F.sum("value").alias("rest_total"))


def top_pool(totals: DataFrame, n: int, excluded: Sequence[str] = ()) -> DataFrame:
    """Best n entities per group by rest-of-season total, some categories left out."""
    rows = totals.where(~F.col("category").isin(*excluded)) if excluded else totals
    return top_n_any_size(rows, ["grp"], [F.col("rest_total").desc(), F.col("entity").asc()], "entity", n)


def mutual_score() -> Column:
    """Product of the gains; the smaller one when both lose, so two losses never look good."""
    a, b = F.col("gain_a"), F.col("gain_b")
    return F.when((a < 0) & (b < 0), F.least(a, b)).otherwise(a * b)


def diverse_top(scored: DataFrame, by: Sequence[str], item: str, cap: int, n: int, score: str = "score", key: str = "scenario") -> DataFrame:
    """Best n per ``by`` in which no incoming item appears more than ``cap`` times."""
    order = [F.round(score, 6).desc(), F.col(key).asc()]
    capped = top_n_any_size(scored, [*by, item], order, key, cap, "_per_item").drop("_per_item")
    return top_n_any_size(capped, by, order, key, n)


def plus_missing_partners(chosen: DataFrame, scored: DataFrame, by: Sequence[str], partner: str, score: str = "score", key: str = "scenario") -> DataFrame:
    """Add the best row of every partner the choice does not represent."""
    keys = [*by, partner]
    best = first_row(scored, keys, [F.round(score, 6).desc(), F.col(key).asc()])
    missing = best.join(chosen.select(*keys).distinct(), keys, "left_anti")
    return chosen.unionByName(missing, allowMissingColumns=True)


def repair(rows: DataFrame, free: DataFrame, categories: Sequence[str], cap: int) -> DataFrame:
    """One repair pass over rosters (grp, entity, category, rest_total): fill empty categories from the
    free pool, then cut the lowest totals over the cap without emptying a category."""
    have = rows.select("grp", "category").distinct()
    wanted = rows.select("grp").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
    empty = wanted.join(have, ["grp", "category"], "left_anti")
    best = free.groupBy("category").agg(F.max_by(F.struct("entity", "rest_total"), F.struct("rest_total", -F.col("entity"))).alias("_f"))
    filled = empty.join(best, "category").select("grp", F.col("_f.entity").alias("entity"), "category", F.col("_f.rest_total").alias("rest_total"))
    every = rows.select("grp", "entity", "category", "rest_total").withColumn("action", F.lit("kept")).unionByName(filled.withColumn("action", F.lit("added")))
    # the best row of each category is never cut; the others compete for the places left
    first = every.groupBy("grp", "category").agg(F.max_by("entity", F.struct("rest_total", -F.col("entity"))).alias("_first"))
    every = every.join(first, ["grp", "category"]).withColumn("_safe", F.col("entity") == F.col("_first"))
    order = [F.col("_safe").desc(), F.col("rest_total").desc(), F.col("entity").asc()]
    keep = top_n_any_size(every, ["grp"], order, "entity", cap, "_k").select("grp", "entity", F.lit(True).alias("_keep"))
    out = every.join(keep, ["grp", "entity"], "left")
    return out.withColumn("action", F.when(F.col("_keep").isNull() & ~F.col("_safe"), "cut").otherwise(F.col("action"))).drop("_first", "_safe", "_keep")


def odds_score(pairs: DataFrame) -> DataFrame:
    """Odds change of a trade from before/after tables: movable sides' smaller delta, mutual flag, rank.

    Columns: before_a, after_a, before_b, after_b, gain_a, gain_b.
    """
    low, high, tolerance, least_gain = 0.01, 0.99, 0.005, 0.005
    def stuck(s: str) -> Column:
        b, a = F.col(f"before_{s}"), F.col(f"after_{s}")
        return ((b < low) & (a < low)) | ((b > high) & (a > high))
    rows = pairs.withColumns({f"delta_{s}": F.col(f"after_{s}") - F.col(f"before_{s}") for s in "ab"}).withColumns({f"stuck_{s}": stuck(s) for s in "ab"})
    move = [F.when(~F.col(f"stuck_{s}"), F.col(f"delta_{s}")) for s in "ab"]
    score, best = F.least(*move), F.greatest(*move)
    ok = (~F.col("stuck_a") | (F.col("gain_a") >= 0)) & (~F.col("stuck_b") | (F.col("gain_b") >= 0))
    mutual = F.coalesce((score >= -tolerance) & (best >= least_gain) & ok, F.lit(False))
    rank = F.when(mutual, 10.0).otherwise(0.0) + score + 0.01 * (F.col("delta_a") + F.col("delta_b")) - F.when(ok, 0.0).otherwise(0.5)
    return rows.withColumns({"score": score, "mutual": mutual, "rank": rank})
