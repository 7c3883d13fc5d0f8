"""Pick-ups and trades as differences from bounded line-up summaries.

Only the best few rows of a category can start, and what the bench is worth is a sum. So a group and
week is summarised once: per category its best rows (as many as can start, plus as many as may leave)
and the worth of all its rows as depth. A change of roster is then worked out from that summary: the
leaving entities are struck from the few rows, the joining ones are put in, the slots are claimed
again over at most a dozen rows, and the depth sum moves by the entities that moved. Rosters
themselves are never joined with scenarios.

Names below: a line row is (neg, entity, cat), neg the value with the sign turned, so that the natural order
of structs is the order of claims, cat the place of the category in ``categories``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.operators.lineup import Slot, _depth, slot_order, value_above_free, value_totals
from rivalgrid.operators.ranking import first_row, top_n_any_size
from rivalgrid.operators.swaps import mutual_score

_ROW = "array<struct<neg:double,entity:bigint,cat:int>>"
_MANY = 1 << 20


@dataclass(frozen=True)
class Market:
    """What trades are judged by: slots, categories in a fixed order, weight of the bench."""

    slots: tuple[Slot, ...]
    categories: tuple[str, ...]
    depth_weight: float = 0.5

    def number(self, category: Column) -> Column:
        return (F.array_position(F.array(*[F.lit(c) for c in self.categories]), category) - 1).cast("int")


def packs(rows: DataFrame, market: Market) -> DataFrame:
    """One row per entity: its category's number, its values by week, and whether it is dead (never above zero)."""
    return rows.groupBy("entity", market.number(F.col("category")).alias("cat")).agg(
        (F.max("value") <= 0).alias("dead"), F.map_from_entries(F.collect_list(F.struct("week", "value"))).alias("weeks")
    ).select("entity", F.struct(F.col("entity").cast("bigint").alias("entity"), "cat", "dead", "weeks").alias("pack"))


def _shown(value: Column, dead: Column) -> Column:
    """The sort value of a row that can be in a line-up: NULL for a zero week of an entity that has others."""
    return F.when(value > 0, -value).when(dead, F.lit(0.0))


def week_bars(free: DataFrame, market: Market) -> DataFrame:
    """Per week the two best free values of each category (0 if fewer) and whose the best one is."""
    best = top_n_any_size(free.select("week", "category", "entity", "value"), ["week", "category"], [F.col("value").desc(), F.col("entity").asc()], "entity", 2)
    def per_category(pick: Column, pos: int, fill: Column) -> Column:
        return F.array(*[F.coalesce(F.max(F.when((F.col("pos") == pos) & (F.col("category") == c), pick)), fill) for c in market.categories])
    value = F.greatest(F.col("value"), F.lit(0.0))
    return best.groupBy("week").agg(
        per_category(value, 1, F.lit(0.0)).alias("bars"), per_category(value, 2, F.lit(0.0)).alias("second"),
        per_category(F.col("entity").cast("bigint"), 1, F.lit(-1).cast("bigint")).alias("holder"))


def summaries(owned: DataFrame, free: DataFrame, market: Market, leaving: int, raw: bool = False) -> DataFrame:
    """One row per group and week (every week that either side has): top_0, top_1, ... the best rows of each
    category, bars, second, holder of the free pool, and spare, per category the depth worth of all rows
    over the bars and over the second bars. ``raw`` keeps every row at its value, as line-up totals do."""
    bars = week_bars(free, market)
    dead = owned.groupBy("grp", "entity").agg((F.max("value") <= 0).alias("dead"))
    rows = owned.select("grp", "week", "entity", "category", "value").join(dead, ["grp", "entity"]).withColumns({
        "neg": -F.col("value") if raw else _shown(F.col("value"), F.col("dead")), "cat": market.number(F.col("category"))}).where(F.col("neg").isNotNull())
    over = rows.where(F.col("value") > 0).join(bars.select("week", "bars", "second"), "week", "left")
    def worth(bar: str, i: int) -> Column:
        above = F.greatest(F.lit(0.0), F.col("value") - F.coalesce(F.get(F.col(bar), F.lit(i)), F.lit(0.0)))
        return F.coalesce(F.sum(F.when(F.col("cat") == i, above)), F.lit(0.0))
    n = range(len(market.categories))
    spare = over.groupBy("grp", "week").agg(F.array(*[worth("bars", i) for i in n]).alias("spare"), F.array(*[worth("second", i) for i in n]).alias("spare_second"))
    few = top_n_any_size(rows, ["grp", "week", "cat"], [F.col("neg").asc(), F.col("entity").asc()], "entity", _depth(market.slots) + leaving)
    line = F.struct("neg", F.col("entity").cast("bigint").alias("entity"), "cat")
    tops = few.groupBy("grp", "week").agg(*[F.sort_array(F.collect_list(F.when(F.col("cat") == i, line))).alias(f"top_{i}") for i in n])
    # the weeks of a season: a calendar, whatever the tables hold
    weeks = [r["week"] for r in owned.select("week").union(free.select("week")).distinct().collect()]
    kind = owned.schema["week"].dataType
    grid = owned.select("grp").distinct().withColumn("week", F.explode(F.array(*[F.lit(w).cast(kind) for w in weeks]).cast(f"array<{kind.simpleString()}>")))
    zero = F.array(*[F.lit(0.0) for _ in n])
    out = grid.join(tops, ["grp", "week"], "left").join(spare, ["grp", "week"], "left").join(bars, "week", "left")
    return out.select(
        "grp", "week", *[F.coalesce(f"top_{i}", F.array().cast(_ROW)).alias(f"top_{i}") for i in n],
        *[F.coalesce(c, zero).alias(c) for c in ("bars", "second", "spare", "spare_second")],
        F.coalesce("holder", F.array(*[F.lit(-1).cast("bigint") for _ in n])).alias("holder"))


def _of_category(rows: Column, number: int) -> Column:
    return F.filter(rows, lambda x: x["cat"] == number)


def _claims(df: DataFrame, tops: Sequence[Column], market: Market) -> tuple[DataFrame, list[str]]:
    """The claimed rows of each slot, as columns."""
    left = dict(enumerate(tops))
    order, names = slot_order(market.slots), []
    for j, slot in enumerate(order):
        cats = [market.categories.index(c) for c in slot.categories]
        pool = left[cats[0]] if len(cats) == 1 else F.sort_array(F.flatten(F.array(*[left[c] for c in cats])))
        later = {market.categories.index(c) for s in order[j + 1 :] for c in s.categories}
        df = df.withColumn(f"_pool{j}", pool)
        rest = F.slice(F.col(f"_pool{j}"), F.lit(slot.count + 1), F.lit(_MANY))
        left |= {c: rest if len(cats) == 1 else _of_category(rest, c) for c in cats if c in later}
        df = df.withColumn(f"_claim{j}", F.slice(F.col(f"_pool{j}"), F.lit(1), F.lit(slot.count)))
        names.append(f"_claim{j}")
    return df, names


def _worth(claims: Sequence[str], bars: Column, market: Market, only: Sequence[str] | None = None) -> Column:
    """Starters over the free pool, less what they would be worth as depth (which the depth sum holds)."""
    def gained(x: Column, bar: Column) -> Column:
        own = F.greatest(F.lit(0.0), -x["neg"] - F.get(bars, x["cat"]))
        value = -x["neg"] - bar - market.depth_weight * own
        return value if only is None else F.when(_within(x["cat"], only, market), value).otherwise(0.0)

    def of_slot(name: str, slot: Slot) -> Column:
        bar = F.greatest(F.lit(0.0), *[F.get(bars, F.lit(market.categories.index(c))) for c in slot.categories])
        return F.aggregate(F.col(name), F.lit(0.0), lambda acc, x: acc + gained(x, bar))

    return sum((of_slot(n, s) for n, s in zip(claims, slot_order(market.slots), strict=True)), F.lit(0.0))


def _within(cat: Column, only: Sequence[str] | None, market: Market) -> Column:
    return F.lit(True) if only is None else cat.isin(*[market.categories.index(c) for c in only])


def _sum_where(values: Column, only: Sequence[str] | None, market: Market) -> Column:
    picked = [F.get(values, F.lit(i)) for i, c in enumerate(market.categories) if only is None or c in only]
    return sum(picked, F.lit(0.0))


def _this_week(people: str, raw: bool) -> Column:
    """The line rows of entities with their packs in the row's week."""
    def row(p: Column) -> Column:
        value = F.try_element_at(p["weeks"], F.col("week"))
        return F.struct((-value if raw else F.when(value.isNotNull(), _shown(value, p["dead"]))).alias("neg"), p["entity"].alias("entity"), p["cat"].alias("cat"))
    return F.filter(F.transform(F.col(people), row), lambda x: x["neg"].isNotNull())


def _depth_of(people: str, bars: Column, only: Sequence[str] | None, market: Market) -> Column:
    def add(acc: Column, x: Column) -> Column:
        return acc + F.when(_within(x["cat"], only, market), F.greatest(F.lit(0.0), -x["neg"] - F.get(bars, x["cat"]))).otherwise(0.0)
    return F.aggregate(F.col(people), F.lit(0.0), add)


def _after_tops(market: Market) -> list[Column]:
    def top(i: int) -> Column:
        stay = F.filter(F.col(f"top_{i}"), lambda x: ~F.array_contains(F.col("_gone"), x["entity"]))
        return F.sort_array(F.concat(stay, _of_category(F.col("_in"), i)))

    return [top(i) for i in range(len(market.categories))]


def changed_values(sides: DataFrame, lines: DataFrame, market: Market, needs: Sequence[str] | None = None) -> DataFrame:
    """Value per side (scenario, grp, gives, gets; entities as packs) after the change, summed over weeks:
    ``after``, and over the categories in ``needs`` alone ``after_need``."""
    df = sides.select("scenario", "grp", "gives", "gets").join(lines, "grp")
    df = df.withColumns({"_gone": F.transform("gives", lambda p: p["entity"]), "_in": _this_week("gets", False), "_out": _this_week("gives", False)})
    df, claims = _claims(df, _after_tops(market), market)
    bars, measures = F.col("bars"), {"after": None} | ({"after_need": needs} if needs else {})
    values = [
        F.sum(_worth(claims, bars, market, only) + market.depth_weight * (
            _sum_where(F.col("spare"), only, market) + _depth_of("_in", bars, only, market) - _depth_of("_out", bars, only, market))).alias(name)
        for name, only in measures.items()]
    return df.groupBy("scenario", "grp").agg(*values)


def current_values(lines: DataFrame, market: Market, needs: Sequence[str] | None = None) -> DataFrame:
    """Value per group as it is: ``before``, and ``before_need``."""
    df, claims = _claims(lines, [F.col(f"top_{i}") for i in range(len(market.categories))], market)
    measures = {"before": None} | ({"before_need": needs} if needs else {})
    return df.groupBy("grp").agg(*[
        F.sum(_worth(claims, F.col("bars"), market, only) + market.depth_weight * _sum_where(F.col("spare"), only, market)).alias(name)
        for name, only in measures.items()])


def offers(pool: DataFrame, most: int = 1) -> DataFrame:
    """What a group can put up: each pool row, and pairs of them if ``most`` is 2. Columns tenant, grp, ids
    (sorted), n, far (the worst pool position among them). The pool holds a few rows per group."""
    one = pool.select("tenant", "grp", F.array(F.col("entity").cast("bigint")).alias("ids"), F.lit(1).alias("n"), F.col("pos").alias("far"))
    if most == 1:
        return one
    a, b = (pool.select("tenant", "grp", F.col("entity").cast("bigint").alias(f"e{s}"), F.col("pos").alias(f"p{s}")) for s in "ab")
    two = a.join(b, ["tenant", "grp"]).where("ea < eb").select("tenant", "grp", F.array("ea", "eb").alias("ids"), F.lit(2).alias("n"), F.greatest("pa", "pb").alias("far"))
    return one.unionByName(two)


def candidate_trades(pool: DataFrame, two_for_one: int = 6) -> DataFrame:
    """Trades between the groups of one tenant (a league, so few): one for one over the whole pool, two for
    one either way over its best ``two_for_one``. Columns grp_a, give_a (ids), grp_b, give_b, kind, scenario."""
    return _pairs(offers(pool, 2), F.col("na") + F.col("nb"), two_for_one)


def _pairs(put_up: DataFrame, size: Column, reach: int | None) -> DataFrame:
    a, b = (put_up.select("tenant", F.col("grp").alias(f"grp_{s}"), F.col("ids").alias(f"give_{s}"), F.col("n").alias(f"n{s}"), F.col("far").alias(f"f{s}")) for s in "ab")
    met = a.join(b, "tenant").where(F.col("grp_a") < F.col("grp_b"))
    if reach is not None:
        met = met.where((size == 2) | ((size == 3) & (F.col("fa") <= reach) & (F.col("fb") <= reach)))
    text = [F.array_join(F.col(f"give_{s}").cast("array<string>"), "+") for s in "ab"]
    return met.select("grp_a", "give_a", "grp_b", "give_b", F.concat_ws("-", F.col("na").cast("string"), F.col("nb").cast("string")).alias("kind"),
                      F.concat_ws("-", F.col("grp_a").cast("string"), text[0], F.col("grp_b").cast("string"), text[1]).alias("scenario"))


def _sides(trades: DataFrame, people: DataFrame) -> DataFrame:
    """Two rows per trade, with the packs of what leaves and what joins. Packs are gathered once for each
    distinct offer, of which there are a few dozen per group."""
    put_up = trades.select(F.col("give_a").alias("ids")).union(trades.select("give_b")).distinct()
    packed = put_up.withColumn("entity", F.explode("ids")).join(people, "entity").groupBy("ids").agg(F.collect_list("pack").alias("of"))
    named = trades.select("scenario", F.posexplode(F.array(
        F.struct(F.col("grp_a").alias("grp"), F.col("give_a").alias("out"), F.col("give_b").alias("into")),
        F.struct(F.col("grp_b").alias("grp"), F.col("give_b").alias("out"), F.col("give_a").alias("into")))).alias("side", "s")).select("scenario", "side", "s.*")
    gives, gets = packed.select(F.col("ids").alias("out"), F.col("of").alias("gives")), packed.select(F.col("ids").alias("into"), F.col("of").alias("gets"))
    return named.join(gives, "out").join(gets, "into").drop("out", "into")


def trade_gains(owned: DataFrame, free: DataFrame, trades: DataFrame, market: Market, needs: Sequence[str] | None = None) -> DataFrame:
    """``trades`` with gain_a, gain_b and the mutual score; with ``needs`` also need_a and need_b, the gains at those categories."""
    lines = summaries(owned, free, market, 2)
    after = changed_values(_sides(trades, packs(owned, market)), lines, market, needs)
    both = after.join(current_values(lines, market, needs), "grp")
    # to nine digits, so that no gain is no gain whatever the order of a sum
    names = {"gain": F.round(F.col("after") - F.col("before"), 9)} | ({"need": F.round(F.col("after_need") - F.col("before_need"), 9)} if needs else {})
    a = both.select("scenario", F.col("grp").alias("grp_a"), *[c.alias(f"{n}_a") for n, c in names.items()])
    b = both.select("scenario", F.col("grp").alias("grp_b"), *[c.alias(f"{n}_b") for n, c in names.items()])
    return trades.join(a, ["scenario", "grp_a"]).join(b, ["scenario", "grp_b"]).withColumn("score", mutual_score())


def directed(scored: DataFrame) -> DataFrame:
    """Each trade as the groups see it: grp gives one or two (``gives``) and gets one entity (``get``)."""
    def seen(me: str, other: str) -> DataFrame:
        more = [F.col(f"need_{me}").alias("need_gain")] if f"need_{me}" in scored.columns else []
        return scored.where(F.size(f"give_{other}") == 1).select(
            "scenario", F.col(f"grp_{me}").alias("grp"), F.col(f"grp_{other}").alias("partner"), F.col(f"give_{me}").alias("gives"),
            F.get(f"give_{other}", F.lit(0)).alias("get"), F.col(f"gain_{me}").alias("gain"), F.col(f"gain_{other}").alias("partner_gain"), "score", *more)
    return seen("a", "b").unionByName(seen("b", "a"))


def rough_trades(pool: DataFrame, worth: DataFrame, by: Sequence[str], budget: int, locked: Column) -> DataFrame:
    """First phase: every exchange of one or two against one or two, ranked by how even it looks.

    ``worth`` has what each entity is worth to its own group; an exchange looks as good as the side that
    gets less, so minus the difference of the two sums. The best ``budget`` per ``by`` go on to be valued,
    and the ``locked`` ones whatever their rank. Nothing is valued here.
    """
    known = pool.join(worth.select("grp", "entity", "worth"), ["grp", "entity"], "left").withColumn("worth", F.coalesce("worth", F.lit(0.0)))
    sums = offers(known, 2)
    each = known.select("grp", F.col("entity").cast("bigint").alias("id"), "worth")
    sums = sums.withColumn("id", F.explode("ids")).join(each, ["grp", "id"]).groupBy("tenant", "grp", "ids", "n", "far").agg(F.sum("worth").alias("worth"))
    trades = _pairs(sums, F.lit(2), None)
    value = {s: sums.select(F.col("grp").alias(f"grp_{s}"), F.col("ids").alias(f"give_{s}"), F.col("worth").alias(f"worth_{s}")) for s in "ab"}
    ranked = trades.join(value["a"], ["grp_a", "give_a"]).join(value["b"], ["grp_b", "give_b"]).withColumn("rough", -F.abs(F.col("worth_a") - F.col("worth_b")))
    best = top_n_any_size(ranked, by, [F.round("rough", 9).desc(), F.col("scenario").asc()], "scenario", budget, "_b").drop("_b")
    kept = best.unionByName(ranked.where(locked).join(best.select("scenario"), "scenario", "left_anti"))
    return kept.drop("worth_a", "worth_b")


def entity_worth(owned: DataFrame, free: DataFrame, market: Market) -> DataFrame:
    """What each entity is worth to its own group over all weeks: starting plus weighted depth value."""
    valued = value_above_free(owned.select("grp", "week", "entity", "category", "value"), free, ["grp", "week"], market.slots)
    totals = value_totals(valued, ["grp", "entity"], market.depth_weight)
    everyone = owned.select("grp", "entity", "category").distinct()
    return everyone.join(totals.select("grp", "entity", F.col("total_value").alias("worth")), ["grp", "entity"], "left").withColumn("worth", F.coalesce("worth", F.lit(0.0)))


def lineup_weeks(owned: DataFrame, free: DataFrame, trades: DataFrame, market: Market, even: float = 1.0) -> DataFrame:
    """Best line-up totals of both sides of each trade before and after it, week by week, and whom it favours:
    the side whose season gain is larger, or neither within ``even`` points a week."""
    lines = summaries(owned, free, market, 2, raw=True)
    def total(claims: Sequence[str]) -> Column:
        return sum((F.aggregate(F.col(c), F.lit(0.0), lambda acc, x: acc - x["neg"]) for c in claims), F.lit(0.0))
    now, claims = _claims(lines, [F.col(f"top_{i}") for i in range(len(market.categories))], market)
    before = now.select("grp", "week", total(claims).alias("before"))
    df = _sides(trades, packs(owned, market)).join(lines, "grp")
    df = df.withColumns({"_gone": F.transform("gives", lambda p: p["entity"]), "_in": _this_week("gets", True)})
    df, claims = _claims(df, _after_tops(market), market)
    rows = df.select("scenario", "side", "grp", "week", total(claims).alias("after")).join(before, ["grp", "week"])
    rows = rows.withColumn("gain", F.col("after") - F.col("before"))
    season = rows.groupBy("scenario").agg(
        F.sum(F.when(F.col("side") == 0, F.col("gain")).otherwise(-F.col("gain"))).alias("lead"), F.countDistinct("week").alias("n"))
    lead = F.round("lead", 9)
    favors = F.when(F.abs(lead) < even * F.col("n"), "even").when(lead > 0, "a").otherwise("b")
    return rows.join(season.select("scenario", favors.alias("favors")), "scenario")


def pickups(owned: DataFrame, free: DataFrame, market: Market, droppable: Column | None = None) -> DataFrame:
    """Every free entity with a positive total against the entity each group would give up for it: the one
    worth least among those of its category, or among all where the group has none of it.

    Both values see the same free pool: without the one that joins, with the one that leaves. Where the
    best free value was its own, the second best stands in; the depth sums over both are in the summary, and
    over a leaving entity's own value they are a running sum over its group's rows. Rows with a gain only.
    """
    worth = entity_worth(owned, free, market)
    may_go = worth.where(droppable) if droppable is not None else worth
    order = [F.round("worth", 9).asc(), F.col("entity").asc()]
    leave = may_go.withColumn("cat", market.number(F.col("category")))
    own = first_row(leave, ["grp", "cat"], order).select("grp", "cat", F.col("entity").alias("own_drop"))
    overall = first_row(leave, ["grp"], order).select("grp", F.col("entity").alias("any_drop"))
    wanted = free.groupBy("entity").agg(F.sum("value").alias("total")).where(F.col("total") > 0).select("entity")
    adds = packs(free, market).join(wanted, "entity").select(F.col("pack").alias("into"), F.lit(0).alias("tenant"))
    # one tenant's groups against its free pool: each pair is a question, and the groups of a league are few
    pairs = adds.join(overall.withColumn("tenant", F.lit(0)), "tenant").withColumn("cat", F.col("into.cat")).join(own, ["grp", "cat"], "left")
    pairs = pairs.select("grp", "into", F.coalesce("own_drop", "any_drop").alias("entity"))
    pairs = pairs.join(packs(owned, market), "entity").select("grp", "into", F.col("pack").alias("leave"))
    pairs = pairs.withColumn("leave_id", F.col("leave.entity"))

    df = pairs.join(summaries(owned, free, market, 1), "grp").join(_own_depth(owned, market), ["grp", "week", "leave_id"], "left")
    cats = range(len(market.categories))
    gone = F.greatest(F.coalesce(F.try_element_at(F.col("leave.weeks"), F.col("week")), F.lit(0.0)), F.lit(0.0))
    base = [F.when(F.get("holder", F.lit(i)) == F.col("into.entity"), F.get("second", F.lit(i))).otherwise(F.get("bars", F.lit(i))) for i in cats]
    df = df.withColumn("_left_value", gone)
    df = df.withColumn("_base", F.array(*base))
    raised = [F.when(F.col("leave.cat") == i, F.greatest(F.get("_base", F.lit(i)), F.col("_left_value"))).otherwise(F.get("_base", F.lit(i))) for i in cats]
    df = df.withColumn("_bars", F.array(*raised))
    def spare(i: int) -> Column:
        pool = F.when(F.get("holder", F.lit(i)) == F.col("into.entity"), F.get("spare_second", F.lit(i))).otherwise(F.get("spare", F.lit(i)))
        above = (F.col("leave.cat") == i) & (F.col("_left_value") > F.get("_base", F.lit(i)))
        return F.when(above, F.coalesce("own_depth", F.lit(0.0))).otherwise(pool)
    df = df.withColumn("_spare", sum((spare(i) for i in cats), F.lit(0.0)))
    df = df.withColumns({"gives": F.array("leave"), "gets": F.array("into")})
    df = df.withColumns({"_gone": F.array("leave.entity"), "_in": _this_week("gets", False), "_out": _this_week("gives", False)})
    bars = F.col("_bars")
    was, old = _claims(df, [F.col(f"top_{i}") for i in cats], market)
    was = was.withColumn("_before", _worth(old, bars, market) + market.depth_weight * F.col("_spare")).drop(*old, *[f"_pool{j}" for j in range(len(old))])
    now, new = _claims(was, _after_tops(market), market)
    after = _worth(new, bars, market) + market.depth_weight * (F.col("_spare") + _depth_of("_in", bars, None, market) - _depth_of("_out", bars, None, market))
    gains = now.withColumn("_after", after).groupBy("grp", F.col("leave.entity").alias("drop"), F.col("into.entity").alias("add")).agg(
        F.sum(F.col("_after") - F.col("_before")).alias("gain"))
    return gains.where(F.round("gain", 6) > 0)


def _own_depth(owned: DataFrame, market: Market) -> DataFrame:
    """What a group's rows of a category and week exceed the value of each of them by (0 or less ones have none).

    A window over one roster's rows of a category in a week."""
    rows = owned.where(F.col("value") > 0).select("grp", "week", F.col("entity").cast("bigint").alias("leave_id"), "value", "category")
    above = Window.partitionBy("grp", "week", "category").orderBy(F.col("value").desc(), "leave_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("grp", "week", "leave_id", (F.sum("value").over(above) - F.count(F.lit(1)).over(above) * F.col("value")).alias("own_depth"))
