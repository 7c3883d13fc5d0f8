"""Line-ups against exhaustive search."""

import itertools

import numpy as np

from rivalgrid.operators import lineup as ln
from rivalgrid.operators.lineup import Slot

SLOTS = [Slot("QB", 1, ("QB",)), Slot("RB", 1, ("RB",)), Slot("WR", 1, ("WR",)), Slot("FLEX", 2, ("RB", "WR"))]


def best_total(rows):
    places = [s.categories for s in SLOTS for _ in range(s.count)]
    pool = [*rows, *[(None, None, 0.0)] * len(places)]
    best = 0.0
    for pick in itertools.permutations(range(len(pool)), len(places)):
        chosen = [pool[i] for i in pick]
        if all(c[1] is None or c[1] in p for c, p in zip(chosen, places)):
            best = max(best, sum(c[2] for c in chosen))
    return best


def test_total_is_the_optimum(spark):
    rng = np.random.default_rng(9)
    data = []
    for g in range(6):
        for e in range(4):
            data.append((g, 1, g * 10 + e, str(rng.choice(["QB", "RB", "WR"])), float(rng.integers(0, 30))))
    df = spark.createDataFrame(data, "grp int, week int, entity long, category string, value double")
    got = {r["grp"]: r["total"] for r in ln.totals(df, ["grp", "week"], SLOTS).collect()}
    for g in range(6):
        assert got[g] == best_total([(r[2], r[3], r[4]) for r in data if r[0] == g])


def test_value_above_free(spark):
    rows = [(0, 1, 1, "QB", 20.0), (0, 1, 2, "RB", 9.0), (0, 1, 3, "RB", 7.0), (0, 1, 4, "RB", 6.0), (0, 1, 5, "RB", 5.0),
            (1, 1, 6, "QB", 0.0), (1, 2, 6, "QB", 0.0), (2, 1, 7, "QB", 0.0), (2, 2, 7, "QB", 8.0)]
    df = spark.createDataFrame(rows, "grp int, week int, entity long, category string, value double")
    free = spark.createDataFrame([(9, 1, 90, "QB", 12.0), (9, 1, 91, "RB", 4.0), (9, 2, 90, "QB", 3.0)], df.schema)
    got = {(r["entity"], r["week"]): (r["starting_value"], r["depth_value"]) for r in ln.value_above_free(df, free, ["grp", "week"], SLOTS).collect()}
    assert got[(1, 1)] == (8.0, 0.0)
    assert got[(2, 1)] == (5.0, 0.0) and got[(3, 1)] == (3.0, 0.0) and got[(4, 1)] == (2.0, 0.0)
    assert got[(5, 1)] == (0.0, 1.0)
    # worth nothing in every week: charged the replacement; a single zero week is only a bye
    assert got[(6, 1)] == (-12.0, 0.0) and got[(6, 2)] == (-3.0, 0.0)
    assert (7, 1) not in got and got[(7, 2)] == (5.0, 0.0)


def test_bye_fill_uses_each_free_entity_once(spark):
    rows = [(0, 1, 1, "RB", 0.0, True), (0, 1, 2, "RB", 0.0, True), (0, 1, 3, "WR", 8.0, False)]
    df = spark.createDataFrame(rows, "grp int, week int, entity long, category string, value double, on_bye boolean")
    free = spark.createDataFrame([(9, 1, 90, "RB", 6.0), (9, 1, 91, "WR", 5.0), (9, 1, 92, "QB", 30.0)], "grp int, week int, entity long, category string, value double")
    got = {(r["slot"], r["entity"]): (r["fill"], r["final_value"]) for r in ln.bye_fill(df, free, ["grp", "week"], SLOTS).collect()}
    assert got == {("RB", 1): (90, 6.0), ("FLEX", 2): (91, 5.0), ("WR", 3): (None, 8.0)}


def test_streaming_fills_only_empty_categories(spark):
    rows = [(0, 1, 1, "QB", 0.0), (0, 1, 2, "RB", 1.0)]
    df = spark.createDataFrame(rows, "grp int, week int, entity long, category string, value double")
    free = spark.createDataFrame([(9, 1, 90, "QB", 12.0), (9, 1, 91, "RB", 40.0)], df.schema)
    got = ln.totals(ln.with_streaming(df, free, ["grp", "week"], ["QB", "RB", "WR"]), ["grp", "week"], SLOTS).first()["total"]
    assert got == 13.0
