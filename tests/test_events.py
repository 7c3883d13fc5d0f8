"""Auction rows: null trap, promotion, collapsing, curves, history, text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rivalgrid.functions import text as tx
from rivalgrid.functions.numeric import bracket_byes, win_probability
from rivalgrid.operators import curves as cv
from rivalgrid.operators import events as ev
from rivalgrid.operators import history as hs
from rivalgrid.operators.grids import weeks_complete
from rivalgrid.operators.market import cluster_values
from rivalgrid.operators.swaps import odds_score

SCHEMA = "source int, season int, week int, entity int, team int, category string, kind string, signal string, bid double, cost double, txn string, tid int"


def bid(tid, signal, value=1.0, txn="x", source=1, kind="WAIVER", team=1):
    return (source, 2024, 2, 7, team, "RB", kind, signal, value, value if signal == "won" else 0.0, txn, tid)


def test_rows_without_id_survive_the_exclusion(spark):
    df = spark.createDataFrame([bid(1, "no_bid", txn=None), bid(2, "won", txn="bad"), bid(3, "won"), bid(4, "won", kind="FREEAGENT")], SCHEMA)
    assert sorted(r["tid"] for r in ev.trainable(df, ["RB"], ["bad"]).collect()) == [1, 3]


def test_best_failed_bid_is_promoted_once(spark):
    df = spark.createDataFrame([bid(1, "other_failure", 5.0), bid(2, "other_failure", 9.0), bid(3, "other_failure", 9.0), bid(4, "won", 2.0, source=2), bid(5, "other_failure", 50.0, source=2)], SCHEMA)
    out = ev.promote_best_failed(df)
    new = out.where("synthetic").collect()
    assert [(r["tid"], r["signal"], r["cost"]) for r in new] == [(2, "won", 9.0)]
    assert out.count() == 6


def test_real_win_beats_a_synthetic_one(spark):
    rows = spark.createDataFrame([(*bid(9, "won", 3.0, source=2), False), (*bid(1, "won", 3.0), True)], SCHEMA + ", synthetic boolean")
    got = ev.consolidate_interest(rows, ["bid"], 1).first()
    assert got["source"] == 2 and got["sources"] == [1, 2] and got["sources_acting"] == 2
    assert got["named_detail"]["bid"] == 3.0


def test_variants_collapse_to_the_executed_row(spark):
    schema = "source int, season int, week int, entity int, team int, status string, bid double, tid int"
    df = spark.createDataFrame([(1, 1, 1, 1, 1, "FAILED", 9.0, 1), (1, 1, 1, 1, 1, "EXECUTED", 2.0, 2), (2, 1, 1, 1, 1, "FAILED", 3.0, 3), (2, 1, 1, 1, 1, "FAILED", 4.0, 4)], schema)
    got = {r["source"]: (r["tid"], r["variants_dropped"]) for r in ev.collapse_variants(df).collect()}
    assert got == {1: (2, 1), 2: (4, 1)}


def test_availability_never_exceeds_the_sources(spark):
    acts = spark.createDataFrame([bid(1, "won", source=1), bid(2, "outbid", source=2)], SCHEMA)
    owned = spark.createDataFrame([(1, 2024, 2, 7), (3, 2024, 2, 7)], "source int, season int, week int, entity int")
    sources = spark.createDataFrame([(s, 2024, 2) for s in (1, 2, 3, 4)], "source int, season int, week int")
    got = ev.availability(acts, owned, sources).first()
    assert (got["sources_won"], got["sources_eligible"]) == (1, 3)


def test_curve_averages_ranks_and_never_rises(spark):
    rows = [(2023, "RB", 1, 12.0, 1.0), (2023, "RB", 2, 9.0, 1.0), (2023, "RB", 3, 6.0, 1.0), (2024, "RB", 4, 10.0, 1.0), (2024, "RB", 5, 8.0, 1.0), (2024, "RB", 6, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "season int, category string, entity int, ppg double, sd double")
    curve = cv.build_curve(cv.ranked_averages(df)).orderBy("rank").collect()
    assert [r["ppg"] for r in curve] == [11.0, 8.5, 5.5]


def test_weeks_complete_stops_at_the_first_open_game(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 2, False), (1, 3, True), (2, 1, False)], "season int, week int, final boolean")
    assert {r["season"]: r["weeks_complete"] for r in weeks_complete(df).collect()} == {1: 1, 2: 0}


def test_confidence_in_sample(spark):
    df = spark.createDataFrame([("e", v) for v in (60.0, 80.0, 100.0, 120.0)], "era string, pf double")
    got = {r["pf"]: r["c"] for r in hs.confidence(df, ["era"], "pf", "c").collect()}
    assert got[100.0] == pytest.approx(2 / 3)


def test_schedule_swap_substitutes_the_rest_of_the_league(spark):
    rows = [(1, 1, "a", 10.0, "b", 20.0), (1, 1, "b", 20.0, "a", 10.0), (1, 1, "c", 4.0, "d", 5.0), (1, 1, "d", 5.0, "c", 4.0)]
    df = spark.createDataFrame(rows, "season int, week int, manager string, pf double, opp string, pa double")
    got = {(r["manager"], r["schedule"]): (r["w"], r["l"], r["subbed"]) for r in hs.schedule_swap(df).collect()}
    # on b's schedule a would meet itself, so it meets the average of b, c, d: 29/3
    assert got[("a", "b")] == (1, 0, 1) and got[("a", "a")] == (0, 1, 0)


def test_clusters_by_gap(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 1.15, 3.0, 3.0, 9.0)], "g string, v double")
    got = sorted((r["low"], r["high"], r["n"]) for r in cluster_values(df, ["g"], "v", 0.2).collect())
    assert got == [(1.0, 1.15, 3), (3.0, 3.0, 2), (9.0, 9.0, 1)]


def test_text_and_time(spark):
    df = spark.createDataFrame([("D'Andre  St. Brown Jr.", "2026-09-18 09:46:17 EDT", "Oct 4", "2019-2021,2024")], "n string, z string, m string, s string")
    row = df.select(tx.merge_name(F.col("n")).alias("n"), tx.zoned_to_utc(F.col("z")).alias("z"), tx.month_day_in_season(F.col("m"), F.lit(2025)).alias("m"), tx.season_list(F.col("s")).alias("s"),
                    tx.local_to_utc(F.lit("2025-11-02"), F.lit("13:00")).alias("dst")).first()
    assert row["n"] == "dandre st brown" and row["m"] == dt.date(2025, 10, 4) and row["s"] == [2019, 2020, 2021, 2024]
    assert row["z"] == dt.datetime(2026, 9, 18, 13, 46, 17) and row["dst"] == dt.datetime(2025, 11, 2, 18, 0)


def test_small_formulas(spark):
    df = spark.createDataFrame([(6, 100.0, 0.0, 90.0)], "n int, a double, sd double, b double")
    row = df.select(bracket_byes("n").alias("b"), win_probability(F.col("a"), F.col("sd"), F.col("b"), F.col("sd")).alias("p"),
                    win_probability(F.lit(110.0), F.lit(20.0), F.lit(100.0), F.lit(20.0)).alias("q")).first()
    assert row["b"] == 2 and row["p"] == 1.0 and row["q"] == pytest.approx(0.63816, abs=1e-4)


def test_immovable_sides_do_not_count(spark):
    df = spark.createDataFrame([(0.999, 1.0, 0.4, 0.5, 1.0, -3.0), (0.5, 0.4, 0.4, 0.5, 1.0, 1.0)], "before_a double, after_a double, before_b double, after_b double, gain_a double, gain_b double")
    a, b = odds_score(df).collect()
    assert a["mutual"] and a["score"] == pytest.approx(0.1)
    assert not b["mutual"] and b["score"] == pytest.approx(-0.1)


def test_a_price_that_is_null_keeps_its_event(spark):
    rows = [(1, 2024, 2, 7, "RB", 10.0, 100.0), (2, 2024, 2, 7, "RB", 30.0, 100.0), (3, 2024, 2, 8, "RB", None, 100.0), (1, 2024, 2, None, "RB", 5.0, 100.0)]
    won = spark.createDataFrame(rows, "source int, season int, week int, entity int, category string, cost double, budget double")
    got = {r["entity"]: (r["n_rows"], r["n_sources"], r["target"]) for r in ev.consolidate_prices(won).collect()}
    assert got == {7: (2, 2, pytest.approx(0.2)), 8: (1, 1, None), None: (1, 1, 0.05)}


def exchanges(df):
    """Shuffles of the plan as first made, without broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_collapsing_and_promoting_shuffle_once(spark):
    schema = "source int, season int, week int, entity int, team int, status string, bid double, tid int"
    raw = spark.createDataFrame([(1, 1, 1, 1, 1, "FAILED", 9.0, 1), (1, 1, 1, None, 1, "FAILED", 9.0, 2), (1, 1, 1, None, 1, "FAILED", None, 3)], schema)
    out = ev.collapse_variants(raw)
    assert exchanges(out) == 1
    assert {(r["entity"], r["tid"], r["variants_dropped"]) for r in out.collect()} == {(1, 1, 0), (None, 2, 1)}
    bids = spark.createDataFrame([bid(1, "other_failure", 5.0), bid(2, "outbid", 9.0, team=2)], SCHEMA)
    assert exchanges(ev.promote_best_failed(bids)) == 1


def test_promotion_of_an_unknown_entity_sees_no_real_bid(spark):
    rows = [(1, 2024, 2, None, 1, "RB", "WAIVER", s, 4.0, 0.0, "x", t) for t, s in ((1, "other_failure"), (2, "outbid"))]
    out = ev.promote_best_failed(spark.createDataFrame(rows, SCHEMA)).where("synthetic").collect()
    assert [(r["tid"], r["cost"]) for r in out] == [(1, 4.0)]


def test_free_sources_are_listed_and_counted_alike(spark):
    acts = spark.createDataFrame([bid(1, "won", source=1), bid(2, "outbid", source=2), bid(3, "outbid", source=3, kind="FREEAGENT"),
                                  (4, 2024, 2, 9, 1, "RB", "WAIVER", "won", 1.0, 1.0, "x", 4), (5, 2024, 2, 9, 1, "RB", "WAIVER", "won", 1.0, 1.0, "x", 5)], SCHEMA)
    owned = spark.createDataFrame([(1, 2024, 2, 7), (4, 2024, 2, 7), (6, 2024, 2, 7)], "source int, season int, week int, entity int")
    wanted = spark.createDataFrame([(2024, 2, 7, "RB"), (2024, 2, 8, "RB"), (2024, 2, None, None), (2024, 3, 7, "RB")], "season int, week int, entity int, category string")
    free = ev.no_bid_rows(wanted, acts, owned, acts)
    assert sorted((r["entity"] or 0, r["source"]) for r in free.collect()) == [*((0, s) for s in range(1, 6)), (7, 5), *((8, s) for s in range(1, 6))]
    plan = free._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    counts = ev.pool_counts(acts, ev.learnable(["RB"]), wanted, owned)
    got = {r["entity"]: (r["eligible"], r["acting"]) for r in counts.collect()}
    # entity 7: sources 1 and 2 bid (3 is no learnable bid), 5 is free; 9 is no candidate
    assert got == {7: (3, 2), 8: (5, 0), 9: (2, 2), None: (5, 0)}
