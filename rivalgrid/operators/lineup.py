"""Best line-ups and value above the free pool.

Rows: keys (group, week, maybe a scenario), entity, category, value. Slots are (label, count,
categories). Filling is one ranked pass per slot label over the rows not yet claimed, narrow slots
first: the optimum when slot sets nest (dedicated slots plus shared ones over them).

Only the best few rows of a category can ever start, so rosters of any size are cut to those
before the passes; the bench keeps its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.operators.ranking import top_n_any_size


class Slot(NamedTuple):
    label: str
    count: int
    categories: tuple[str, ...]


def expand_slots(config: DataFrame) -> DataFrame:
    """(label, n) -> numbered instances label1 .. labeln (a single one keeps its bare label)."""
    return config.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn(
        "instance", F.when(F.col("n") > 1, F.concat("label", F.col("_i").cast("string"))).otherwise(F.col("label"))).drop("_i")


def slot_order(slots: Sequence[Slot]) -> list[Slot]:
    return sorted(slots, key=lambda s: len(s.categories))


def _depth(slots: Sequence[Slot]) -> int:
    categories = {c for s in slots for c in s.categories}
    return max(sum(s.count for s in slots if c in s.categories) for c in categories)


def _claim(rows: DataFrame, keys: Sequence[str], slots: Sequence[Slot], order: Sequence[Column], allowed: Column | None = None) -> DataFrame:
    rows = rows.withColumn("slot", F.lit(None).cast("string"))
    for slot in slot_order(slots):
        free = F.col("slot").isNull() & F.col("category").isin(*slot.categories)
        if allowed is not None:
            free = free & allowed
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(free.desc(), *order))
        rows = rows.withColumn("slot", F.when(free & (turn <= slot.count), slot.label).otherwise(F.col("slot")))
    return rows


def starters(rows: DataFrame, keys: Sequence[str], slots: Sequence[Slot]) -> DataFrame:
    """The best line-up per key: claimed rows with their slot."""
    order = [F.col("value").desc(), F.col("entity").asc()]
    few = top_n_any_size(rows, [*keys, "category"], order, "entity", _depth(slots), "_top").drop("_top")
    return _claim(few, keys, slots, order).where(F.col("slot").isNotNull())


def totals(rows: DataFrame, keys: Sequence[str], slots: Sequence[Slot]) -> DataFrame:
    return starters(rows, keys, slots).groupBy(*keys).agg(F.sum("value").alias("total"))


def free_best(free: DataFrame) -> DataFrame:
    """Best free value per week and category (never below zero)."""
    return free.groupBy("week", "category").agg(F.greatest(F.lit(0.0), F.max("value")).alias("best"))


def free_by_week(free: DataFrame) -> DataFrame:
    """One row per week: map category -> best free value."""
    return free_best(free).groupBy("week").agg(F.map_from_entries(F.collect_list(F.struct("category", "best"))).alias("_free"))


def _best_of(categories: Sequence[str]) -> Column:
    return F.greatest(F.lit(0.0), *[F.coalesce(F.try_element_at(F.col("_free"), F.lit(c)), F.lit(0.0)) for c in categories])


def value_above_free(rows: DataFrame, free: DataFrame, keys: Sequence[str], slots: Sequence[Slot]) -> DataFrame:
    """Per key and entity: starting value (points above the best free entity for the slot) and depth value.

    ``keys`` must hold the week. A starter needs a positive value. A slot without one is charged to an
    entity of the group that is worth nothing in every week; a single zero week is only a bye. Bench
    rows count what they exceed the free pool of their category by.
    """
    seasonal = [k for k in keys if k != "week"]
    # windows over one entity's weeks
    dead = F.max("value").over(Window.partitionBy(*seasonal, "entity")) <= 0
    marked = rows.withColumn("_dead", dead).where((F.col("value") > 0) | F.col("_dead"))
    order = [(F.col("value") > 0).desc(), F.when(F.col("value") > 0, F.col("value")).desc_nulls_last(), F.col("entity").asc()]
    depth = _depth(slots)
    slice_ = Window.partitionBy(*keys, "category", F.pmod(F.xxhash64("entity"), F.lit(64))).orderBy(*order)
    # rows beyond the depth of their slice can only sit on the bench
    cut = marked.withColumn("_p", F.row_number().over(slice_))
    claimed = _claim(cut.where(F.col("_p") <= depth), keys, slots, order)
    bench = cut.where(F.col("_p") > depth).withColumn("slot", F.lit(None).cast("string"))
    every = claimed.unionByName(bench).drop("_p").join(free_by_week(free), "week", "left")
    every = every.withColumn("_free", F.coalesce("_free", F.create_map().cast("map<string,double>")))
    replacement = F.lit(None).cast("double")
    for s in slots:
        replacement = F.when(F.col("slot") == s.label, _best_of(s.categories)).otherwise(replacement)
    own = F.coalesce(F.try_element_at(F.col("_free"), F.col("category")), F.lit(0.0))
    zero = F.lit(0.0)
    return every.withColumns({
        "starting_value": F.when(F.col("slot").isNotNull(), F.greatest(F.col("value"), zero) - replacement).otherwise(zero),
        "depth_value": F.when(F.col("slot").isNull() & (F.col("value") > 0), F.greatest(zero, F.col("value") - own)).otherwise(zero),
    }).drop("_dead", "_free")


def value_totals(valued: DataFrame, by: Sequence[str], depth_weight: float = 0.5) -> DataFrame:
    out = valued.groupBy(*by).agg(F.sum("starting_value").alias("starting_value"), F.sum("depth_value").alias("depth_value"))
    return out.withColumn("total_value", F.col("starting_value") + depth_weight * F.col("depth_value"))


def free_pool_value(free: DataFrame) -> DataFrame:
    """Each free entity's value over the best other free entity of its week and category, summed."""
    best = top_n_any_size(free, ["week", "category"], [F.col("value").desc(), F.col("entity").asc()], "entity", 2)
    pair = best.groupBy("week", "category").agg(
        F.max(F.when(F.col("pos") == 1, F.col("entity"))).alias("_first"), F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("_v1"),
        F.max(F.when(F.col("pos") == 2, F.col("value"))).alias("_v2"))
    other = F.coalesce(F.when(F.col("entity") == F.col("_first"), F.col("_v2")).otherwise(F.col("_v1")), F.lit(0.0))
    rows = free.join(pair, ["week", "category"]).withColumn("_d", F.col("value") - F.greatest(other, F.lit(0.0)))
    return rows.groupBy("entity", "category").agg(
        F.sum(F.greatest(F.col("_d"), F.lit(0.0))).alias("gain"), F.sum("_d").alias("net"))


def with_streaming(rows: DataFrame, free: DataFrame, keys: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Rows plus a stand-in for every category in which nobody of the key scores: the best free value."""
    best = F.greatest(F.lit(0.0), F.max("value"))
    wide = rows.groupBy(*keys).pivot("category", list(categories)).agg(best)
    gaps = wide.withColumn("category", F.explode(F.filter(
        F.array(*[F.when(F.coalesce(F.col(c), F.lit(0.0)) <= 0, F.lit(c)) for c in categories]), lambda c: c.isNotNull())))
    stand_in = gaps.select(*keys, "category").join(free_best(free), ["week", "category"]).where(F.col("best") > 0)
    extra = stand_in.select(*keys, F.lit(-1).cast(rows.schema["entity"].dataType).alias("entity"), "category", F.col("best").alias("value"))
    return rows.select(*keys, "entity", "category", "value").unionByName(extra)


def bye_fill(rows: DataFrame, free: DataFrame, keys: Sequence[str], slots: Sequence[Slot]) -> DataFrame:
    """Line-up in which a starter on bye (``on_bye``) gives its slot to the best unused free entity.

    The free rows a week could ever need are the best few per category, carried as one array.
    """
    line = starters(rows, keys, slots)
    need = sum(s.count for s in slots)
    few = top_n_any_size(free.where(F.col("value") > 0), ["week", "category"], [F.col("value").desc(), F.col("entity").asc()], "entity", need)
    packs = few.groupBy("week").agg(F.collect_list(F.struct("entity", "category", "value")).alias("_pack"))
    holes = line.where("on_bye").groupBy(*keys).agg(F.collect_list("slot").alias("_holes"))
    offered = holes.join(packs, "week").select(*keys, "_holes", F.explode("_pack").alias("_f")).select(
        *keys, "_holes", F.col("_f.entity").alias("entity"), F.col("_f.category").alias("category"), F.col("_f.value").alias("value"))
    offered = offered.withColumn("slot", F.lit(None).cast("string")).withColumn("_turn", F.lit(0))
    order = [F.col("value").desc(), F.col("entity").asc()]
    for slot in slot_order(slots):
        free_row = F.col("slot").isNull() & F.col("category").isin(*slot.categories)
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(free_row.desc(), *order))
        wanted = F.size(F.filter("_holes", lambda h: h == slot.label))
        take = free_row & (turn <= wanted)
        offered = offered.withColumns({"_turn": F.when(take, turn).otherwise(F.col("_turn")), "slot": F.when(take, slot.label).otherwise(F.col("slot"))})
    fills = offered.where(F.col("slot").isNotNull()).select(
        *keys, "slot", F.col("_turn").alias("_n"), F.col("entity").alias("fill"), F.col("value").alias("fill_value"))
    hole = F.row_number().over(Window.partitionBy(*keys, "slot", "on_bye").orderBy(*order))
    numbered = line.withColumn("_n", F.when(F.col("on_bye"), hole))
    out = numbered.join(fills, [*keys, "slot", "_n"], "left").drop("_n")
    return out.withColumn("streamed", F.col("fill").isNotNull()).withColumn(
        "final_value", F.col("value") + F.coalesce("fill_value", F.lit(0.0)))


def slot_strength(line: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Average value per numbered slot instance over periods (re-ranked inside the slot label)."""
    n = F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(F.col("value").desc(), F.col("entity").asc()))
    return line.withColumn("instance", n).groupBy(*by, "slot", "instance").agg(F.avg("value").alias("avg_value"))


def efficiency(rows: DataFrame, keys: Sequence[str], slots: Sequence[Slot], started: Column) -> DataFrame:
    """Actual points of the started rows over the best possible line-up."""
    actual = rows.groupBy(*keys).agg(F.sum(F.when(started, F.col("value")).otherwise(0.0)).alias("actual"))
    return actual.join(totals(rows, keys, slots), list(keys)).withColumn(
        "best", F.greatest("total", "actual")).withColumn("mer", F.when(F.col("best") > 0, F.col("actual") / F.col("best"))).drop("total")


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starters that came in and went out, paired best to worst inside a category first, then the rest."""
    ids = [*keys, "entity"]
    gone = before.join(after.select(*ids), ids, "left_anti").select(*keys, "category", F.col("entity").alias("out"), F.col("value").alias("out_value"))
    come = after.join(before.select(*ids), ids, "left_anti").select(*keys, "category", F.col("entity").alias("came"), F.col("value").alias("in_value"))
    in_cat = Window.partitionBy(*keys, "category")
    g = gone.withColumn("_n", F.row_number().over(in_cat.orderBy(F.col("out_value").desc(), "out")))
    c = come.withColumn("_n", F.row_number().over(in_cat.orderBy(F.col("in_value").desc(), "came")))
    same = c.join(g, [*keys, "category", "_n"], "full")
    paired = same.where(F.col("came").isNotNull() & F.col("out").isNotNull()).select(*keys, "came", "in_value", "out", "out_value")
    rest = Window.partitionBy(*keys)
    rc = same.where(F.col("out").isNull()).select(*keys, "came", "in_value", F.row_number().over(rest.orderBy(F.col("in_value").desc(), "came")).alias("_n"))
    rg = same.where(F.col("came").isNull()).select(*keys, "out", "out_value", F.row_number().over(rest.orderBy(F.col("out_value").desc(), "out")).alias("_n"))
    return paired.unionByName(rc.join(rg, [*keys, "_n"], "full").select(*keys, "came", "in_value", "out", "out_value"))
