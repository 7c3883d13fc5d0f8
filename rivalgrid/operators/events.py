"""Auction events: bid rows of many sources, cleaned, enriched and consolidated.

Bid rows: source, season, week, entity, team, category, kind, status, bid, tid (a sortable unique
key). Events are keyed (source, season, week, entity); dropping the source pools the sources.
Picks of one row per event are aggregates, not windows, so one event may hold any share of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import clamp, count_if
from rivalgrid.operators.ranking import first_row, summaries_any_size
from rivalgrid.session import cut_lineage

EVENT = ["source", "season", "week", "entity"]
POOLED = ["season", "week", "entity"]
# How informative each signal is, best first.
SIGNAL_PRIORITY = {"won": 0, "outbid": 1, "other_failure": 2, "no_bid": 3}
# Usage and rank bars of the relevance gate; rank and value stand-ins for unknowns.
MIN_PRIOR_POINTS, MIN_SNAP_SHARE = 5.0, 0.15
RANK_CEILING = {"QB": 25, "RB": 73, "WR": 73, "TE": 25, "K": 18}
MISSING_RANK = 150.0


def signal_priority() -> Column:
    out = F.lit(99)
    for signal, p in SIGNAL_PRIORITY.items():
        out = F.when(F.col("signal") == signal, p).otherwise(out)
    return out


def collapse_variants(bids: DataFrame) -> DataFrame:
    """One row per team and event: the executed one, else the highest bid; the rest are counted.

    One aggregate finds both: a group is cut to one row per task before the shuffle, and an event or
    team that is NULL is a group of its own.
    """
    by = [*EVENT, "team"]
    done = F.col("status") == "EXECUTED"
    rest = [c for c in bids.columns if c not in by and c != "tid"]
    # tid is unique, so what follows it never decides
    first = F.struct((~done).alias("_open"), F.when(done, 0.0).otherwise(-F.coalesce("bid", F.lit(0.0))).alias("_value"), "tid", *rest)
    kept = bids.groupBy(*by).agg(F.min(first).alias("_first"), (F.count(F.lit(1)) - 1).alias("variants_dropped"))
    return kept.select(*by, *[F.col(f"_first.{c}").alias(c) for c in (*rest, "tid")], "variants_dropped")


def classify(bids: DataFrame, flat_cost: Column | float = 0.0, outbid_statuses: Sequence[str] = ("OUTBID",)) -> DataFrame:
    """Outcome of a bid and what it cost: losers cost nothing, uncontested pick-ups a flat fee."""
    flat = flat_cost if isinstance(flat_cost, Column) else F.lit(float(flat_cost))
    signal = F.when(F.col("status") == "EXECUTED", "won").when(
        F.col("status").isin(*outbid_statuses), "outbid").otherwise("other_failure")
    cost = F.when(F.col("signal") != "won", 0.0).when(F.col("kind") == "FREEAGENT", flat).otherwise(F.col("bid"))
    return bids.withColumn("signal", signal).withColumn("cost", cost)


def recode_signal(signal: str = "signal") -> Column:
    return F.when(F.col(signal).isin("won", "outbid"), F.col(signal)).otherwise("failed")


def learnable(categories: Sequence[str], bad_ids: Sequence[str] = ()) -> Column:
    """May a model learn from the row? The id exclusion is null-safe: a row without id stays."""
    keep = F.col("signal").isin(*SIGNAL_PRIORITY) & F.col("category").isin(*categories) & (F.col("kind") != "FREEAGENT")
    if bad_ids:
        keep = keep & ~F.coalesce(F.col("txn").isin(*bad_ids), F.lit(False))
    return keep


def trainable(bids: DataFrame, categories: Sequence[str], bad_ids: Sequence[str] = ()) -> DataFrame:
    return bids.where(learnable(categories, bad_ids))


def relevant(prior: Column, snap: Column, rank: Column, category: Column) -> Column:
    """Recent usage, or a season rank within the category's ceiling; unknown values never pass."""
    ceiling = F.create_map(*[F.lit(x) for kv in RANK_CEILING.items() for x in kv])[category]
    usage = (F.coalesce(prior, F.lit(-1.0)) >= MIN_PRIOR_POINTS) | (F.coalesce(snap, F.lit(-1.0)) >= MIN_SNAP_SHARE)
    return usage | F.coalesce(rank <= ceiling, F.lit(False))


def competing_bidders(bids: DataFrame) -> DataFrame:
    claims = bids.where(F.col("kind").isin("WAIVER", "WAIVER_ERROR"))
    return claims.groupBy(*EVENT).agg(F.count_distinct("team").alias("n_bidders"))


def spend_shares(bids: DataFrame) -> DataFrame:
    """Spend per team-season, its source's season total and the share."""
    team = bids.groupBy("source", "season", "team").agg(F.sum("cost").alias("team_spend"))
    total = bids.groupBy("source", "season").agg(F.sum("cost").alias("source_spend"))
    return team.join(total, ["source", "season"]).withColumn(
        "share", F.when(F.col("source_spend") > 0, F.col("team_spend") / F.col("source_spend")))


def effective_budgets(
    bids: DataFrame, reported: DataFrame, provenance: DataFrame, legacy_source: int, legacy_last: int, bad_ids: Sequence[str] = ()
) -> DataFrame:
    """Budget per (source, season): legacy seasons use spend per team, others the reported or current value."""
    legacy = (F.col("source") == legacy_source) & (F.col("season") <= legacy_last)
    counted = ~F.coalesce(F.col("txn").isin(*bad_ids), F.lit(False)) if bad_ids else F.lit(True)
    seasons = bids.groupBy("source", "season").agg(F.sum(F.when(counted, F.col("cost")).otherwise(0.0)).alias("_spend"))
    rows = seasons.join(reported, ["source", "season"], "left").join(provenance, "source", "left")
    budget = F.when(legacy, F.col("_spend") / F.col("size")).otherwise(F.coalesce("reported_budget", "current_budget"))
    return rows.select("source", "season", budget.alias("budget"))


def budget_remaining(bids: DataFrame, budgets: DataFrame, last_week: int) -> DataFrame:
    """Per (source, season, team, week): share of the budget left before the week, for the team and
    on average over the source's active teams. Grid of teams x weeks."""
    weekly = bids.where(F.col("team").isNotNull()).groupBy("source", "season", "team", "week").agg(F.sum("cost").alias("spend"))
    grid = weekly.select("source", "season", "team").distinct().withColumn(
        "week", F.explode(F.sequence(F.lit(1), F.lit(last_week))))
    before = Window.partitionBy("source", "season", "team").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        grid.join(weekly, ["source", "season", "team", "week"], "left")
        .withColumn("spent_before", F.coalesce(F.sum("spend").over(before), F.lit(0.0)))
        .join(budgets, ["source", "season"], "left")
    )
    left = F.when(F.col("budget") > 0, clamp(1 - F.col("spent_before") / F.col("budget"), 0.0, 1.0))
    rows = rows.withColumn("team_left", left)
    avg = rows.groupBy("source", "season", "week").agg(F.avg("team_left").alias("avg_left"))
    return rows.select("source", "season", "team", "week", "spent_before", "team_left").join(avg, ["source", "season", "week"])


def event_stats(bids: DataFrame) -> DataFrame:
    """Every row with its auction's facts: bids, winning bid, best losing bid (failed rows carry none)."""
    won, outbid = F.col("signal") == "won", F.col("signal") == "outbid"
    facts = bids.where(F.col("kind") == "WAIVER").groupBy(*EVENT).agg(
        count_if(won | outbid).alias("n_bids"),
        F.max(F.when(won, F.coalesce("bid", F.lit(0.0)))).alias("win_bid"),
        F.max(F.when(outbid, F.coalesce("bid", F.lit(0.0)))).alias("runner_up"),
    )
    counts = (F.col("kind") == "WAIVER") & (won | outbid)
    rows = bids.join(facts, EVENT, "left").withColumn("signal3", recode_signal())
    return rows.withColumns({c: F.when(counts, F.col(c)) for c in ("n_bids", "win_bid", "runner_up")})


def promote_best_failed(bids: DataFrame) -> DataFrame:
    """Add a synthetic win where a source's event has only failed bids: its highest bid.

    One aggregate holds the best failed bid and whether there is a real one. As in a join, an event
    that is not fully known has no real bid. ``bids`` without tid must not differ in their other columns
    where an event's bids are equal, signal and cost aside, which a promoted bid gets anew.
    """
    names = [c for c in bids.columns if c not in (*EVENT, "tid", "signal", "cost")]
    key = [c for c in ("tid",) if c in bids.columns]
    real = F.col("signal").isin("won", "outbid") & reduce(and_, [F.col(c).isNotNull() for c in EVENT])
    # ascending puts a NULL bid first; tid is unique, so what follows it never decides
    best = F.min(F.when(F.col("signal") == "other_failure", F.struct((-F.col("bid")).alias("_value"), *key, *names)))
    events = bids.groupBy(*EVENT).agg(best.alias("_best"), F.max(real).alias("_real"))
    synthetic = events.where(F.col("_best").isNotNull() & ~F.coalesce("_real", F.lit(False))).select(
        *EVENT, *[F.col(f"_best.{c}").alias(c) for c in (*names, *key)]).withColumns(
        {"signal": F.lit("won"), "cost": F.col("bid").cast("double"), "synthetic": F.lit(True)})
    return bids.withColumn("synthetic", F.lit(False)).unionByName(synthetic)


def consolidate_interest(rows: DataFrame, features: Sequence[str], named_source: int) -> DataFrame:
    """One row per pooled event: sources eligible and acting, mean features, one named source's detail.

    The arrays hold source ids, so they are bounded by the number of sources.
    """
    acted = F.col("signal") != "no_bid"
    named = F.when(F.col("source") == named_source, F.struct("synthetic", "tid", "signal", "bid"))
    order = F.struct(signal_priority().alias("p"), F.col("synthetic"), F.col("tid"))
    out = rows.groupBy(*POOLED).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("category", "signal", "source", "tid"), order).alias("_rep"),
        F.count_distinct("source").alias("sources_eligible"),
        F.count_distinct(F.when(acted, F.col("source"))).alias("sources_acting"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.min(named).alias("_named"),
        *[F.avg(f).alias(f) for f in features],
    )
    shown = F.when((F.col("_n") > 1) & F.col("_named").isNotNull(), F.struct(
        F.col("_named.signal").alias("signal"),
        F.when(F.col("_named.signal") == "won", F.col("_named.bid")).alias("bid")))
    return out.select(*POOLED, "_rep.*", "sources_eligible", "sources_acting", "sources", shown.alias("named_detail"), *features)


def target_share(cost: str = "cost", budget: str = "budget", consolidated: str | None = None) -> Column:
    """Price as a share of the budget; a consolidated value wins, no budget means zero."""
    own = F.when(F.col(budget) > 0, F.col(cost) / F.col(budget)).otherwise(0.0)
    return F.coalesce(F.col(consolidated), own) if consolidated else own


def consolidate_prices(won: DataFrame) -> DataFrame:
    """One price per pooled event: the median of the sources' price shares, and who backs it."""
    rows = cut_lineage(won.select(*POOLED, "source", "category", target_share().alias("target")))
    return summaries_any_size(rows, POOLED, "target", {"target": 0.5}, {
        "category": F.min("category"), "n_rows": F.count(F.lit(1)), "n_sources": F.count_distinct("source"), "mean_target": F.avg("target")})


def win_distribution(won: DataFrame) -> DataFrame:
    """Every source's winning price share per pooled event, in long form; with the bid's key where ``won`` has it."""
    key = [c for c in ("tid",) if c in won.columns]
    return won.where(F.col("budget") > 0).select(*POOLED, "source", *key, (F.col("cost") / F.col("budget")).alias("value"))


def same_week_signal(rows: DataFrame) -> DataFrame:
    """Running period: median and mean of winners and the number of active sources."""
    rows = rows.select(*POOLED, "source", F.when(F.col("signal") == "won", target_share()).alias("price"))
    return summaries_any_size(rows, POOLED, "price", {"median_price": 0.5}, {
        "mean_price": F.avg("price"), "sources_active": F.count_distinct("source"), "n_won": F.count("price")})


def availability(rows: DataFrame, rostered: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that could bid: all that report rosters, minus owners, plus those that acted anyway.

    Counted as totals minus owners without activity, so no (source, entity) pair is produced for
    the sources that did nothing. ``sources`` is (season, week, source).
    """
    acting = rows.groupBy(*POOLED, "source").agg(F.max((F.col("signal") == "won").cast("int")).alias("_won"))
    owned = rostered.select(*POOLED, "source").distinct().withColumn("_owned", F.lit(1))
    reporting = sources.select("season", "week", "source").distinct().withColumn("_reports", F.lit(1))
    both = acting.withColumn("_acts", F.lit(1)).join(owned, [*POOLED, "source"], "full").join(
        reporting, ["season", "week", "source"], "left")
    per = both.groupBy(*POOLED).agg(
        F.sum(F.when(F.col("_acts").isNull() & F.col("_reports").isNotNull(), 1).otherwise(0)).alias("_out"),
        F.sum(F.when(F.col("_acts").isNotNull() & F.col("_reports").isNull(), 1).otherwise(0)).alias("_extra"),
        F.coalesce(F.sum("_won"), F.lit(0)).alias("sources_won"))
    totals = reporting.groupBy("season", "week").agg(F.count(F.lit(1)).alias("_all"))
    return per.join(totals, ["season", "week"], "left").select(
        *POOLED, "sources_won",
        (F.coalesce("_all", F.lit(0)) - F.col("_out") + F.col("_extra")).alias("sources_eligible"))


def busy_sources(bids: DataFrame, rostered: DataFrame, **flags: Column) -> DataFrame:
    """(source, season, week, entity) of every source that bid for an entity or owns it, once each, with flags
    (true if true of any of its bids)."""
    acts = bids.select(*EVENT, *[c.alias(n) for n, c in flags.items()])
    owns = rostered.select(*EVENT, *[F.lit(False).alias(n) for n in flags])
    rows = acts.unionByName(owns)
    return rows.groupBy(*EVENT).agg(*[F.max(n).alias(n) for n in flags]) if flags else rows.distinct()


def no_bid_rows(candidates: DataFrame, sources: DataFrame, rostered: DataFrame, bids: DataFrame) -> DataFrame:
    """Entities a source could have bid for and did not.

    ``candidates`` is (season, week, entity, category), already gated for relevance. Each takes the sources of
    its week but those that bid for it or own it; both lists are bounded by the number of sources, so
    only rows of the answer are made.
    """
    reporting = sources.select("season", "week", "source").distinct().groupBy("season", "week").agg(F.collect_list(F.struct("source")).alias("_all"))
    busy = busy_sources(bids, rostered).groupBy(*POOLED).agg(F.collect_list("source").alias("_busy"))
    free = candidates.join(reporting, ["season", "week"]).join(busy, POOLED, "left")
    left = F.when(F.col("_busy").isNull(), F.col("_all")).otherwise(F.filter(
        "_all", lambda s: F.coalesce(~F.array_contains("_busy", s["source"]), F.lit(True))))
    return free.select(F.explode(left).alias("_free"), *candidates.columns).select("_free.source", *candidates.columns).withColumns(
        {"signal": F.lit("no_bid"), "bid": F.lit(0.0), "cost": F.lit(0.0)})


def pool_counts(bids: DataFrame, learnable: Column, candidates: DataFrame, rostered: DataFrame) -> DataFrame:
    """Pooled events with the sources eligible (those with a learnable bid and those free to bid and silent) and acting.

    Free sources are counted as in ``availability``: all of the week, minus those that bid or own.
    """
    reporting = bids.select("season", "week", "source").distinct().withColumn("_reports", F.lit(1))
    totals = reporting.groupBy("season", "week").agg(F.count("source").alias("_all"))
    busy = busy_sources(bids, rostered, _learns=learnable, _acts=learnable & (F.col("signal") != "no_bid"))
    per = busy.join(reporting, ["season", "week", "source"], "left").groupBy(*POOLED).agg(
        F.max("_learns").alias("_any"), count_if(F.col("_learns") & F.col("source").isNotNull()).alias("_learned"),
        count_if(F.col("_acts") & F.col("source").isNotNull()).alias("_acting"), F.count("_reports").alias("_taken"))
    known = candidates.join(totals, ["season", "week"]).select(*POOLED, "_all")
    # a union, not a join: an entity that is NULL is one event as well
    rows = per.unionByName(known, allowMissingColumns=True).groupBy(*POOLED).agg(
        F.max("_any").alias("_any"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("_learned", "_acting", "_taken", "_all")])
    # nobody is known to have bid for or to own an unknown entity, so all sources are free
    free = F.greatest(F.col("_all") - F.when(F.col("entity").isNull(), F.col("_learned")).otherwise(F.col("_taken")), F.lit(0))
    return rows.where(F.coalesce("_any", F.lit(False)) | (free > 0)).select(
        *POOLED, (F.col("_learned") + free).alias("eligible"), F.col("_acting").alias("acting"))


def source_of_record(existing: DataFrame, incoming: DataFrame, by: Sequence[str], force: bool = False) -> DataFrame:
    """Merge season sets: seasons already held stay unless forced, then the new ones replace them."""
    keys = incoming.select(*by).distinct() if force else existing.select(*by).distinct()
    if force:
        return existing.join(keys, list(by), "left_anti").unionByName(incoming)
    return existing.unionByName(incoming.join(keys, list(by), "left_anti"))


def log_outcomes(log: DataFrame, bids: DataFrame, budgets: DataFrame, processed: DataFrame) -> DataFrame:
    """Logged estimates against what happened: won, lost, no_bid, or pending until the week is processed."""
    acts = bids.where((F.col("kind") == "WAIVER") & F.col("signal").isin("won", "outbid"))
    first_win = F.min_by("bid", F.when(F.col("signal") == "won", F.col("tid")))
    events = acts.groupBy(*EVENT).agg(
        F.count(F.lit(1)).alias("n_bids"), count_if(F.col("signal") == "won").alias("_wins"), first_win.alias("_win_bid"))
    done = processed.select("source", "season", "week").distinct().withColumn("_done", F.lit(True))
    rows = log.join(events, EVENT, "left").join(done, ["source", "season", "week"], "left").join(budgets, ["source", "season"], "left")
    status = F.when(F.col("_wins") > 0, "won").when(F.col("n_bids").isNotNull(), "lost").when(F.col("_done"), "no_bid").otherwise("pending")
    win = F.when((F.col("_wins") > 0) & (F.col("budget") > 0), F.col("_win_bid") / F.col("budget"))
    return rows.withColumn("status", status).withColumn("win_pct", win).drop("_wins", "_win_bid", "_done", "budget")


def season_phase(week: str = "week") -> dict[str, Column]:
    w = F.col(week)
    return {"phase_decline": F.when(w.between(13, 15), 1.0).otherwise(0.0), "phase_final": F.when(w >= 16, 1.0).otherwise(0.0)}


# Numeric features with the value standing for "unknown", and flags.
NUMERIC_FEATURES = {
    "prior_points": 0.0, "snap_share": 0.0, "trailing_avg": 0.0, "to_date_avg": 0.0,
    "weekly_rank": MISSING_RANK, "ros_rank": MISSING_RANK, "carry_share": 0.0, "target_share": 0.0,
}
HAD_FLAGS = ("snap_share", "trailing_avg", "to_date_avg", "weekly_rank", "ros_rank", "carry_share", "target_share")
FLAG_FEATURES = ("had_prior_row", "own_status_flag", "peer_out", "peer_out_new")
FEATURES = ["week", *NUMERIC_FEATURES, *[f"had_{f}" for f in HAD_FLAGS], *FLAG_FEATURES]


def feature_columns() -> list[Column]:
    """The 20 model features: unknowns get a stand-in and a had_ flag."""
    out = [F.col("week").cast("double").alias("week")]
    out += [F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in NUMERIC_FEATURES.items()]
    out += [F.col(c).isNotNull().cast("double").alias(f"had_{c}") for c in HAD_FLAGS]
    out += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FLAG_FEATURES]
    return out
