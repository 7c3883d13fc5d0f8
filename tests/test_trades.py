"""Pick-ups and trades against rosters laid out in plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivalgrid.operators import swaps as sw
from rivalgrid.operators import trades as tr
from rivalgrid.operators.lineup import Slot

SLOTS = (Slot("QB", 1, ("QB",)), Slot("RB", 1, ("RB",)), Slot("WR", 1, ("WR",)), Slot("FLEX", 2, ("RB", "WR")))
CATS = ("QB", "RB", "WR", "K")
MARKET = tr.Market(SLOTS, CATS)
SCHEMA = "grp int, week int, entity long, category string, value double"


def league(seed, groups=4, size=7, weeks=3, free=9):
    """Rows with zero weeks, missing weeks, dead entities and equal values."""
    r = np.random.default_rng(seed)
    rows = []
    for g, n in [(g, size) for g in range(groups)] + [(9, free)]:
        for e in range(n):
            dead = r.random() < 0.2
            for w in range(1, weeks + 1):
                if r.random() < 0.85:
                    rows.append((g, w, g * 100 + e, CATS[(e + g) % (4 if e % 3 else 3)], 0.0 if dead or r.random() < 0.2 else float(r.integers(1, 12))))
    return rows


def value(roster, free, weeks, needs=None):
    """Total of (starting + half the depth) over weeks; rosters and pools are lists of entities' (category, {week: value})."""
    total = 0.0
    for w in weeks:
        bar = {c: max([0.0, *[v[w] for k, v in free.values() if k == c and w in v]]) for c in CATS}
        rows = []
        for e, (c, v) in roster.items():
            dead = max(v.values()) <= 0
            if w in v and (v[w] > 0 or dead):
                rows.append((-v[w] if v[w] > 0 else 0.0, e, c))
        rows.sort()
        for slot in SLOTS:
            took = [r for r in rows if r[2] in slot.categories][: slot.count]
            for r in took:
                rows.remove(r)
                total += (-r[0] - max(bar[c] for c in slot.categories)) if needs is None or r[2] in needs else 0.0
        total += sum(0.5 * max(0.0, -r[0] - bar[r[2]]) for r in rows if needs is None or r[2] in needs)
    return total


def line_up(roster, weeks):
    out = {}
    for w in weeks:
        rows = sorted((-v[w], e, c) for e, (c, v) in roster.items() if w in v)
        total = 0.0
        for slot in SLOTS:
            took = [r for r in rows if r[2] in slot.categories][: slot.count]
            for r in took:
                rows.remove(r)
                total -= r[0]
        out[w] = total
    return out


def parts(rows):
    groups = {}
    for g, w, e, c, v in rows:
        groups.setdefault(g, {}).setdefault(e, (c, {}))[1][w] = v
    free = groups.pop(9)
    return groups, free, sorted({r[1] for r in rows})


def frames(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.where("grp <> 9"), df.where("grp = 9")


@pytest.mark.parametrize("seed", [1, 2])
def test_trades_are_valued_as_whole_rosters(spark, seed):
    rows = league(seed)
    groups, free, weeks = parts(rows)
    owned, pool_free = frames(spark, rows)
    pool = sw.top_pool(sw.rest_totals(owned), 5, ["K"]).withColumn("tenant", F.lit(0))
    got = {r.scenario: r for r in tr.trade_gains(owned, pool_free, tr.candidate_trades(pool, 3), MARKET, ("RB",)).collect()}

    totals = {g: sorted(((sum(v.values()), -e) for e, (c, v) in mine.items() if c != "K"), reverse=True)[:5] for g, mine in groups.items()}
    names = {g: [-e for _, e in t] for g, t in totals.items()}
    want = {}
    for a, b in itertools.combinations(sorted(groups), 2):
        swaps = [((x,), (y,)) for x in names[a] for y in names[b]]
        swaps += [(tuple(sorted(p)), (y,)) for p in itertools.combinations(names[a][:3], 2) for y in names[b][:3]]
        swaps += [((x,), tuple(sorted(p))) for p in itertools.combinations(names[b][:3], 2) for x in names[a][:3]]
        for give, get in swaps:
            gains = []
            for me, other, out, into in ((a, b, give, get), (b, a, get, give)):
                after = {e: v for e, v in groups[me].items() if e not in out} | {e: groups[other][e] for e in into}
                gains += [value(after, free, weeks, n) - value(groups[me], free, weeks, n) for n in (None, ("RB",))]
            want[f"{a}-{'+'.join(map(str, give))}-{b}-{'+'.join(map(str, get))}"] = gains
    assert got.keys() == want.keys()
    for key, (ga, na, gb, nb) in want.items():
        r = got[key]
        assert np.allclose([r.gain_a, r.need_a, r.gain_b, r.need_b], [ga, na, gb, nb], atol=1e-8), key
        assert np.isclose(r.score, min(ga, gb) if ga < -1e-9 and gb < -1e-9 else ga * gb, atol=1e-6)


def test_rough_phase_keeps_its_budget_and_the_locked(spark):
    owned, free = frames(spark, league(3))
    pool = sw.top_pool(sw.rest_totals(owned), 4).withColumn("tenant", F.lit(0))
    worth = tr.entity_worth(owned, free, MARKET)
    locked = (F.col("kind") == "1-1") & (F.get("give_b", F.lit(0)) == 301)
    rows = tr.rough_trades(pool, worth, ["grp_a"], 5, locked).collect()
    w = {r.entity: r.worth for r in worth.collect()}
    held = {g: [r.entity for r in pool.collect() if r.grp == g] for g in range(4)}
    every = []
    for a, b in itertools.combinations(range(4), 2):
        put = {g: [tuple(sorted(c)) for n in (1, 2) for c in itertools.combinations(held[g], n)] for g in (a, b)}
        for x in put[a]:
            for y in put[b]:
                even = -abs(sum(w[e] for e in x) - sum(w[e] for e in y))
                every.append((a, -round(even, 9), f"{a}-{'+'.join(map(str, x))}-{b}-{'+'.join(map(str, y))}", x, y))
    want = {t[2] for g in range(4) for t in sorted(t for t in every if t[0] == g)[:5]} | {t[2] for t in every if len(t[3]) == 1 and t[4] == (301,)}
    assert {r.scenario for r in rows} == want


def test_trade_by_week_and_whom_it_favours(spark):
    rows = league(4)
    groups, free, weeks = parts(rows)
    owned, pool_free = frames(spark, rows)
    a, b = [sorted(e for e in groups[g])[:2] for g in (0, 1)]
    trades = spark.createDataFrame([(0, a, 1, b[:1], "s")], "grp_a int, give_a array<long>, grp_b int, give_b array<long>, scenario string")
    got = {(r.grp, r.week): (r.before, r.after, r.favors) for r in tr.lineup_weeks(owned, pool_free, trades, MARKET).collect()}
    after = [{e: v for e, v in groups[0].items() if e not in a} | {b[0]: groups[1][b[0]]}, {e: v for e, v in groups[1].items() if e != b[0]} | {e: groups[0][e] for e in a}]
    sides = [(line_up(groups[g], weeks), line_up(after[g], weeks)) for g in (0, 1)]
    lead = sum(sides[0][1][w] - sides[0][0][w] - sides[1][1][w] + sides[1][0][w] for w in weeks)
    favors = "even" if abs(lead) < len(weeks) else "a" if lead > 0 else "b"
    assert got == {(g, w): (sides[g][0][w], sides[g][1][w], favors) for g in (0, 1) for w in weeks}


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_pickups_see_one_free_pool_before_and_after(spark, seed):
    rows = league(seed)
    groups, free, weeks = parts(rows)
    owned, pool_free = frames(spark, rows)
    worth = {(r.grp, r.entity): round(r.worth, 9) for r in tr.entity_worth(owned, pool_free, MARKET).collect()}
    want = {}
    for g, mine in groups.items():
        for f, (c, v) in free.items():
            if sum(v.values()) <= 0:
                continue
            same = [e for e in mine if mine[e][0] == c] or list(mine)
            drop = min(same, key=lambda e: (worth[g, e], e))
            pool = {e: x for e, x in free.items() if e != f} | {drop: mine[drop]}
            gain = value({e: x for e, x in mine.items() if e != drop} | {f: free[f]}, pool, weeks) - value(mine, pool, weeks)
            if round(gain, 6) > 0:
                want[g, f] = (drop, gain)
    got = {(r.grp, r.add): (r["drop"], r.gain) for r in tr.pickups(owned, pool_free, MARKET).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


def test_directed_view_and_diversity(spark):
    rows = [("s1", 0, [1], 1, [11], 5.0, 4.0, 20.0), ("s2", 0, [1, 2], 1, [11], 3.0, 2.0, 6.0), ("s3", 0, [3], 1, [11], 2.0, 1.0, 2.0), ("s4", 0, [1], 1, [11, 12], 9.0, -1.0, -9.0)]
    scored = spark.createDataFrame(rows, "scenario string, grp_a int, give_a array<long>, grp_b int, give_b array<long>, gain_a double, gain_b double, score double")
    seen = tr.directed(scored)
    assert {(r.scenario, r.grp) for r in seen.collect()} == {("s1", 0), ("s2", 0), ("s3", 0), ("s1", 1), ("s3", 1), ("s4", 1)}
    top = sw.diverse_top(seen, ["grp"], "get", 2, 5)
    assert {(r.scenario, r.grp) for r in top.collect()} == {("s1", 0), ("s2", 0), ("s1", 1), ("s4", 1), ("s3", 1)}
    late = seen.withColumn("partner", F.when(F.col("scenario") == "s3", F.lit(7)).otherwise(F.col("partner")))
    more = sw.plus_missing_partners(top.where("scenario <> 's3'"), late, ["grp"], "partner")
    assert {(r.scenario, r.grp) for r in more.where("partner = 7").collect()} == {("s3", 0), ("s3", 1)}
