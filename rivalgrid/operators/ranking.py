"""Row numbers, ranks and prefix sums.

``row_numbers`` is the plain window, right for groups of a bounded size (the members of one
roster, the groups of one league). ``row_numbers_any_size`` gives the same numbers when one
group may hold most of the table: a range sort spreads the group over all tasks and a small
per-block table turns block positions into group positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.session import cut_lineage


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ordinal position inside ``by``; ``order`` must end in a unique key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _blocks(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sort the whole table by (by, order) into fixed blocks and remember each row's block."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc() for c in by], *order)
    return cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))


def row_numbers_any_size(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``row_numbers`` for groups of any size: no task holds more than one block of a group."""
    rows = _blocks(df, by, order)
    per_block = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order))
    keys = [*by, "_block"]
    return (
        rows.withColumn("_inside", inside).join(offsets, keys)
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("int"))
        .drop("_offset", "_inside", "_block")
    )


def running_sums_any_size(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str], totals: dict[str, str] | None = None
) -> DataFrame:
    """Inclusive prefix sums {value: name} and group totals {value: name} for groups of any size."""
    rows = _blocks(df, by, order)
    totals = totals or {}
    per_block = rows.groupBy(*by, "_block").agg(*[F.sum(v).alias(f"_s_{v}") for v in sums])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *by, "_block",
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0.0)).alias(f"_o_{v}") for v in sums],
        *[F.sum(f"_s_{v}").over(Window.partitionBy(*by)).alias(name) for v, name in totals.items()],
    )
    span = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_i_{v}": F.sum(v).over(span) for v in sums}).join(offsets, [*by, "_block"])
    out = inside.withColumns({name: F.col(f"_o_{v}") + F.coalesce(f"_i_{v}", F.lit(0.0)) for v, name in sums.items()})
    return out.drop("_block", *[f"_i_{v}" for v in sums], *[f"_o_{v}" for v in sums])


def running_sum_any_size(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str, total: str | None = None
) -> DataFrame:
    return running_sums_any_size(df, by, order, {value: name}, {value: total} if total else None)


def band_sums(
    df: DataFrame, by: Sequence[str], key: str, position: str, reach: float, sums: dict[str, str]
) -> DataFrame:
    """For every row, sums over the rows of its group whose position lies within ``reach``.

    Two probes per row are sorted in among the rows; a prefix sum at the upper probe minus the one
    at the lower probe is the band. No pair of rows is ever formed.
    """
    data = df.select(*by, F.col(key).alias("_key"), F.col(position).alias("_x"), F.lit(1).alias("_kind"), *sums)
    def probe(kind: int, shift: float) -> DataFrame:
        return df.select(*by, F.col(key).alias("_key"), (F.col(position) + shift).alias("_x"), F.lit(kind).alias("_kind"),
                         *[F.lit(0.0).alias(v) for v in sums])
    rows = data.unionByName(probe(0, -reach)).unionByName(probe(2, reach))
    cum = running_sums_any_size(rows, by, [F.col("_x").asc(), F.col("_kind").asc(), F.col("_key").asc()], {v: f"_c_{v}" for v in sums})
    ends = cum.where(F.col("_kind") != 1)
    sign = F.when(F.col("_kind") == 2, 1.0).otherwise(-1.0)
    return ends.groupBy(*by, F.col("_key").alias(key)).agg(*[F.sum(sign * F.col(f"_c_{v}")).alias(n) for v, n in sums.items()])


def cumulative_share(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of the group at or below each value (cume_dist), through a count per distinct value.

    Equal values collapse before the shuffle, so a value held by a third of the rows is one row
    of the sorted table.
    """
    per_value = df.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    ranked = running_sum_any_size(per_value, by, [F.col(value).asc()], "_c", "_cum", "_all")
    share = ranked.select(*by, value, (F.col("_cum") / F.col("_all")).alias(name))
    return df.join(share, [*by, value], "left")


def rank_by_category(
    df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], name: str = "rank", any_size: bool = False
) -> DataFrame:
    """1 = highest. A NULL value keeps a NULL rank."""
    order = [desc(value), *[F.col(t).asc() for t in tie]]
    ranked = (row_numbers_any_size if any_size else row_numbers)(df, by, order, name)
    return ranked.withColumn(name, F.when(F.col(value).isNotNull(), F.col(name)))


def trailing(df: DataFrame, by: Sequence[str], period: str, n: int) -> DataFrame:
    """The last ``n`` periods of each group (groups are period grids, so small)."""
    return row_numbers(df, by, [F.col(period).desc()], "_back").where(F.col("_back") <= n).drop("_back")


def leave_one_out(df: DataFrame, by: Sequence[str], value: str, name: str, alone: float | None = None) -> DataFrame:
    """Average of the other rows of the group; ``alone`` when there is no other row."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    rest = (F.sum(value).over(w) - F.col(value)) / (n - 1)
    return df.withColumn(name, F.when(n > 1, rest).otherwise(F.lit(alone).cast("double")))


def non_increasing(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Smallest value so far, for groups of any size: inside blocks, and over the blocks before."""
    rows = _blocks(df, by, [F.col(order).asc()])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lowest = rows.groupBy(*by, "_block").agg(F.min(value).alias("_low")).select(*by, "_block", F.min("_low").over(before).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # least() passes over NULL: the first block has nothing before it
    return rows.withColumn("_inside", F.min(value).over(inside)).join(lowest, [*by, "_block"]).withColumn(
        name, F.least("_inside", "_before")).drop("_inside", "_before", "_block")


def percentiles_any_size(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, for groups of any size.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here equal
    values collapse first and positions come from a distributed prefix sum.
    """
    per_value = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    cum = running_sum_any_size(per_value, by, [F.col(value).asc()], "_c", "_cum", "_n")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= index) & (index < F.col("_cum")), F.col(value)))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(pos), F.ceil(pos)
        part = F.max(pos - low)
        aggs.append((at(low) + (at(high) - at(low)) * part).alias(name))
    return cum.groupBy(*by).agg(*aggs)


def summaries_any_size(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], facts: dict[str, Column], most: int = 1 << 17
) -> DataFrame:
    """Exact percentiles (as in ``percentiles_any_size``) beside other aggregates, for many groups of which most are small.

    Groups of up to ``most`` rows are sorted inside one task: one shuffle gives everything. Only groups
    beyond that, counted first, go through the range sort.
    """
    sized = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    large = cut_lineage(sized.where(F.col("_rows") > most).select(*[F.col(c).alias(f"_{c}") for c in by]))
    names = [*by, *facts, *probs]

    def sorted_inside(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*by)
        placed = rows.withColumns({
            "_at": F.row_number().over(group.orderBy(F.col(value).asc_nulls_last())) - 1, "_n": F.count(value).over(group)})
        aggs = []
        for name, p in probs.items():
            pos = (F.col("_n") - 1) * F.lit(float(p))
            low, high = (F.max(F.when(F.col("_at") == edge, F.col(value))) for edge in (F.floor(pos), F.ceil(pos)))
            aggs.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
        return placed.groupBy(*by).agg(*[c.alias(n) for n, c in facts.items()], *aggs).select(*names)

    if large.isEmpty():
        return sorted_inside(df)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    hot = cut_lineage(df.join(large, same, "left_semi"))
    shares = percentiles_any_size(hot, by, value, probs).select(*[F.col(c).alias(f"_{c}") for c in by], *probs)
    spread = hot.groupBy(*by).agg(*[c.alias(n) for n, c in facts.items()]).join(shares, same, "left").select(*names)
    return sorted_inside(df.join(large, same, "left_anti")).unionByName(spread)


def weighted_percentiles_any_size(
    df: DataFrame, by: Sequence[str], value: str, weight: str, probs: dict[str, float]
) -> DataFrame:
    """First value whose cumulative weight reaches the target share, for groups of any size."""
    per_value = df.groupBy(*by, value).agg(F.sum(weight).alias("_c"))
    cum = running_sum_any_size(per_value, by, [F.col(value).asc()], "_c", "_cum", "_n")
    # the last value always reaches the target, whatever the summing order left in the last digit
    reach = {n: F.min(F.when(F.col("_cum") >= F.lit(float(p)) * F.col("_n") * (1 - 1e-12), F.col(value))) for n, p in probs.items()}
    return cum.groupBy(*by).agg(*[F.coalesce(c, F.max(value)).alias(n) for n, c in reach.items()])


def top_n_any_size(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, n: int, name: str = "pos") -> DataFrame:
    """The first n rows of each group: a group is cut to n rows in each slice before slices meet, with as
    many slices as there are shuffle partitions."""
    slices = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = Window.partitionBy(*by, "_slice").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices))).withColumn("_p", F.row_number().over(part))
        .where(F.col("_p") <= n).withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n).drop("_slice", "_p")
    )


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each group. Spark's group limit keeps one row per group and task before the
    shuffle, so hot groups stay small and only those rows are sorted again.

    ``order`` is ascending and must end in a unique key.
    """
    names = [c for c in (columns or df.columns) if c not in by]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= 1).select(*by, *names)
