"""Auction queries over invented bids, beside their SQL."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from rivalgrid.operators import comps  # noqa: E402
from rivalgrid.operators import events as ev  # noqa: E402
from rivalgrid.operators import market as mk  # noqa: E402
from rivalgrid.plans import bindings  # noqa: E402
from rivalgrid.plans import block_2_events as b2  # noqa: E402
from rivalgrid.session import cuts  # noqa: E402

TABLES = ("nation", "customer", "orders", "lineitem")


def auction_tables(folder, seed=7, customers=60, orders=1500, items=3, parts=900):
    """Bids of 25 sources for some entities in two seasons and a part of a third."""
    rng = np.random.default_rng(seed)
    days = pd.to_datetime("1998-01-01") + pd.to_timedelta(rng.integers(0, 760, orders), unit="D")
    made = {
        "nation": pd.DataFrame({"n_nationkey": np.arange(25, dtype="int32"), "n_name": [f"N{i}" for i in range(25)], "n_regionkey": np.arange(25, dtype="int32") % 5}),
        "customer": pd.DataFrame({"c_custkey": np.arange(customers), "c_nationkey": (np.arange(customers) % 25).astype("int32")}),
        "orders": pd.DataFrame({"o_orderkey": np.arange(orders), "o_custkey": rng.integers(0, customers, orders), "o_orderdate": days.astype("datetime64[us]"),
                                "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "5-LOW"], orders)}),
        "lineitem": pd.DataFrame({
            "l_orderkey": np.repeat(np.arange(orders), items), "l_linenumber": np.tile(np.arange(1, items + 1, dtype="int32"), orders),
            "l_partkey": rng.integers(0, parts, orders * items), "l_suppkey": rng.integers(0, 12, orders * items),
            "l_quantity": rng.integers(1, 51, orders * items).astype(float), "l_extendedprice": np.round(rng.uniform(900, 100000, orders * items), 2),
            "l_returnflag": rng.choice(["R", "A", "N"], orders * items, p=[0.5, 0.3, 0.2]),
            "l_shipdate": np.repeat(days, items).astype("datetime64[us]")})}
    for name, rows in made.items():
        rows.to_parquet(folder / f"{name}.parquet", index=False)
    return str(folder)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return auction_tables(tmp_path_factory.mktemp("auction"))


def plain(rows):
    def cell(v):
        return "~" if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and plain(got.select(*columns).collect()) == plain(want)


def test_local_lens_equals_sql(spark, sf):
    same_as_sql(spark, sf, "a46_local_lens")


def test_local_lens_takes_the_keys_of_wins_from_their_twins(spark):
    rows = [(1, "RB", "1-3", 2000, w, 0.1 * w, w) for w in (1, 2, 3)] * 3
    keyed = spark.createDataFrame(rows, "source int, category string, bucket string, season int, week int, pct double, tid int")
    wins = keyed.drop("tid")
    lens, last = mk.local_lens(wins, mk.baseline_cells(wins), 2, keyed)
    assert [(r["basis"], r["n"]) for r in lens.collect()] == [("bucket", 9)]
    assert [r["week"] for r in last.orderBy("pos").collect()] == [3, 3]
    assert lens.where(F.col("ratio").isNotNull()).isEmpty()  # no pool of 30 rows to hold it against


@pytest.mark.parametrize("name", ["m07_price_estimate", "m08_confidence_samples", "a36_consolidate_prices", "a49_three_way_error"])
def test_price_queries_equal_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


def test_shared_tables_leave_no_scratch_tables_behind(spark, tmp_path):
    folder = auction_tables(tmp_path, seed=8, orders=200)
    before = set(cuts(spark))
    b2.prices(spark, folder)
    shared = {path for path, _ in bindings._WRITTEN.values()}
    assert set(cuts(spark)) - before <= shared  # not the rows that prices are summed up from


def test_wins_travel_as_short_lists_and_none_is_lost(spark):
    rows = [(1, 0.5)] * 7 + [(1, 0.25), (1, None), (1, None), (2, 0.125), (None, 0.75)]
    wins = spark.createDataFrame(rows, "id long, value double")
    packs = comps.packed_wins(wins, 3).collect()
    assert {len(r["_values"]) for r in packs if r["id"] == 1} <= {1, 2, 3}
    assert {(r["id"], r["_wins"]) for r in packs} == {(1, 10), (2, 1)}
    near = spark.createDataFrame([("QB", 9, 1, 5.0), ("QB", 9, 2, 1.0), ("QB", 8, 3, 1.0)], "category string, qid long, id long, w_capped double")
    got = sorted(((r["qid"], r["value"] or 0.0, r["weight"]) for r in comps.confidence_samples(near, wins).collect()))
    assert got == [(9, 0.0, 0.5)] * 2 + [(9, 0.125, 1.0), (9, 0.25, 0.5)] + [(9, 0.5, 0.5)] * 7


def test_samples_reach_their_query_in_one_shuffle_without_keys(spark):
    near = spark.createDataFrame([("QB", q, i, 0.1 * i, 0.2, 3) for q in (1, 2) for i in (3, 4)], "category string, qid long, id long, dist double, target double, backing int")
    wins = spark.createDataFrame([(3, 0.1), (3, 0.3), (4, 0.2)], "id long, value double")
    got = {r["qid"]: (r["n_comps"], r["price_flattened"]) for r in comps.price_estimate(near, wins).collect()}
    assert got == {1: (2, 0.2), 2: (2, 0.2)}
    samples = comps.confidence_samples(comps.price_weights(near), wins).groupBy("category", "qid", "value").agg(F.sum("weight"))
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(qid" in line for line in plan.splitlines()) == 1


def test_wins_are_promoted_without_keys(spark):
    schema = "source int, season int, week int, entity int, signal string, bid double, cost double"
    rows = [(1, 2024, 2, 7, "other_failure", 5.0, 0.0), (1, 2024, 2, 7, "other_failure", 9.0, 0.0), (1, 2024, 2, 7, "other_failure", 9.0, 0.0),
            (2, 2024, 2, 7, "won", 2.0, 2.0), (2, 2024, 2, 7, "other_failure", 50.0, 0.0), (3, 2024, 2, 7, "other_failure", None, 0.0)]
    won = ev.promote_best_failed(spark.createDataFrame(rows, schema)).where(F.col("signal") == "won")
    assert sorted((r["source"], r["cost"], r["synthetic"]) for r in won.collect()) == [(1, 9.0, True), (2, 2.0, False), (3, None, True)]


def test_written_bids_hold_no_column_that_others_give(spark, sf):
    written, read = bindings.collapsed(spark, sf), bindings.bids(spark, sf)
    assert not {"category", "txn", "signal", "cost"} & set(written.columns)
    assert read.columns == [*written.columns, "category", "txn", "signal", "cost"] and read.count() == written.count()
