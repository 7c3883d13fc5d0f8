"""Price statistics: baselines, ratios, contests, tendencies, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.operators import events as ev
from rivalgrid.operators import market as mk
from rivalgrid.operators.ranking import percentiles_any_size, weighted_percentiles_any_size
from rivalgrid.plans import bindings as b
from rivalgrid.plans.block_2_events import TID, TID_SPEC, with_tid
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS

BUCKET = "CASE WHEN week BETWEEN 1 AND 3 THEN '1-3' WHEN week BETWEEN 4 AND 6 THEN '4-6' WHEN week BETWEEN 7 AND 9 THEN '7-9' WHEN week BETWEEN 10 AND 12 THEN '10-12' WHEN week BETWEEN 13 AND 18 THEN '13-18' END"
QUANTS = "quantile_cont(pct, 0.25) AS p25, quantile_cont(pct, 0.5) AS p50, quantile_cont(pct, 0.75) AS p75, quantile_cont(pct, 0.9) AS p90"
VIEWS.update({
    "v_wins": f"SELECT *, {BUCKET} AS bucket FROM v_full WHERE kind = 'WAIVER' AND signal = 'won' AND bid > 0 AND pct IS NOT NULL",
    "v_base": f"""
        SELECT coalesce(category, 'All') AS category, coalesce(bucket, 'All') AS bucket, count(*) AS n, avg(pct) AS mean, {QUANTS}
        FROM v_wins WHERE source <> 0 GROUP BY GROUPING SETS ((), (category), (bucket), (category, bucket))""",
    "v_fallback": """
        SELECT c.*, coalesce(x.p50, k.p50, w.p50, a.p50) AS pool_p50, coalesce(x.n, k.n, w.n, a.n) AS pool_n,
               CASE WHEN x.n IS NOT NULL THEN 'cell' WHEN k.n IS NOT NULL THEN 'category' WHEN w.n IS NOT NULL THEN 'bucket' WHEN a.n IS NOT NULL THEN 'all' END AS level
        FROM (SELECT source, category, bucket, count(*) AS n, quantile_cont(pct, 0.5) AS p50 FROM v_wins GROUP BY source, category, bucket) c
        LEFT JOIN (SELECT * FROM v_base WHERE n >= 30 AND category <> 'All' AND bucket <> 'All') x ON x.category = c.category AND x.bucket = c.bucket
        LEFT JOIN (SELECT * FROM v_base WHERE n >= 30 AND category <> 'All' AND bucket = 'All') k ON k.category = c.category
        LEFT JOIN (SELECT * FROM v_base WHERE n >= 30 AND category = 'All' AND bucket <> 'All') w ON w.bucket = c.bucket
        LEFT JOIN (SELECT * FROM v_base WHERE n >= 30 AND category = 'All' AND bucket = 'All') a ON TRUE""",
})


def wins(spark, sf, rows=None):
    rows = b.budgeted_bids(spark, sf) if rows is None else rows
    return rows.where(mk.contested_win()).withColumn("bucket", mk.week_bucket())


def keyed_wins(spark, sf):
    """Contested wins with their own key."""
    return wins(spark, sf, ev.event_stats(b.priced_bids(spark, sf)))


def baselines(spark, sf):
    return mk.baseline_cells(wins(spark, sf).where(F.col("source") != b.NAMED_SOURCE))


@query("p27_contested_wins", f"source:i season:i week:i entity:i bucket:s pct:d {TID_SPEC}",
       f"SELECT source, season, week, entity, bucket, pct, {TID} FROM v_wins")
def contested(spark, sf):
    """Contested wins with their week bucket."""
    return with_tid(keyed_wins(spark, sf))


@query("a40_baseline_grouping_sets", "category:s bucket:s n:i mean:d p25:d p50:d p75:d p90:d", "SELECT * FROM v_base")
def grouping_sets(spark, sf):
    return baselines(spark, sf)


@query("a41_five_number_summary", "source:i season:i n:i mean:d p25:d p50:d p75:d p90:d",
       f"SELECT source, season, count(*) AS n, avg(pct) AS mean, {QUANTS} FROM v_wins GROUP BY source, season")
def five_numbers(spark, sf):
    return mk.summarize(wins(spark, sf), ["source", "season"], "pct")


def local_cells(spark, sf):
    return mk.summarize(wins(spark, sf), ["source", "category", "bucket"], "pct", {"p50": 0.5})


@query("j21_baseline_fallback", "source:i category:s bucket:s n:i level:s pool_n:n pool_p50:d",
       "SELECT source, category, bucket, n, level, pool_n, pool_p50 FROM v_fallback")
def fallback(spark, sf):
    return mk.fallback_baseline(local_cells(spark, sf), baselines(spark, sf))


RATIO = """SELECT *, CASE WHEN pool_p50 > 0 THEN p50 / pool_p50 END AS ratio, 1 + (p50 / pool_p50 - 1) * (n / (n + 10.0)) AS shrunk, n < 8 AS thin FROM v_fallback"""


@query("a42_local_price_ratio", "source:i category:s bucket:s n:i ratio:d shrunk:d thin:b", RATIO)
def local_ratio(spark, sf):
    """A42 and the ratio grid of A74."""
    return mk.ratio_stats(fallback(spark, sf))


CONTEST = """SELECT {keys}, count(*) FILTER (WHERE signal = 'won') AS auctions,
    avg(CAST(n_bids >= 2 AS INT)) FILTER (WHERE signal = 'won') AS contested_share, avg(n_bids) FILTER (WHERE signal = 'won') AS avg_bidders,
    quantile_cont((win_bid - runner_up) / budget, 0.5) FILTER (WHERE signal = 'won' AND n_bids >= 2 AND runner_up IS NOT NULL AND budget > 0) AS median_margin,
    avg(CAST(signal = 'outbid' AS INT)) AS outbid_share
    FROM v_full WHERE kind = 'WAIVER' AND signal IN ('won', 'outbid') GROUP BY {keys}"""
CONTEST_SPEC = "auctions:i contested_share:d avg_bidders:d median_margin:d outbid_share:d"


@query("a43_contest_stats", f"source:i {CONTEST_SPEC}", CONTEST.format(keys="source"))
def contests(spark, sf):
    return mk.contest_stats(b.budgeted_bids(spark, sf), ["source"])


@query("a74_contest_by_season", f"source:i season:i category:s {CONTEST_SPEC}", CONTEST.format(keys="source, season, category"))
def contests_by_season(spark, sf):
    return mk.contest_stats(b.budgeted_bids(spark, sf), ["source", "season", "category"])


@query("a44_team_tendencies",
       "source:i team:i bids:i wins:i outbid:i free_adds:i spend:d biggest:d wins_QB:i wins_RB:i wins_WR:i wins_TE:i wins_K:i win_rate:d median_win_pct:d median_overpay:d",
       """SELECT source, team, count(*) FILTER (WHERE kind = 'WAIVER' AND signal IN ('won', 'outbid')) AS bids,
            count(*) FILTER (WHERE kind = 'WAIVER' AND signal = 'won') AS wins, count(*) FILTER (WHERE kind = 'WAIVER' AND signal = 'outbid') AS outbid,
            count(*) FILTER (WHERE kind <> 'WAIVER' AND signal = 'won') AS free_adds,
            coalesce(sum(cost) FILTER (WHERE kind = 'WAIVER' AND signal = 'won'), 0) AS spend,
            max(bid) FILTER (WHERE kind = 'WAIVER' AND signal = 'won') AS biggest, """
       + ", ".join(f"count(*) FILTER (WHERE kind = 'WAIVER' AND signal = 'won' AND category = '{c}') AS wins_{c}" for c in b.CATEGORIES)
       + """, count(*) FILTER (WHERE kind = 'WAIVER' AND signal = 'won') / nullif(count(*) FILTER (WHERE kind = 'WAIVER' AND signal IN ('won', 'outbid')), 0) AS win_rate,
            quantile_cont(pct, 0.5) FILTER (WHERE kind = 'WAIVER' AND signal = 'won' AND bid > 0) AS median_win_pct,
            quantile_cont((win_bid - runner_up) / budget, 0.5) FILTER (WHERE kind = 'WAIVER' AND signal = 'won' AND runner_up IS NOT NULL AND budget > 0) AS median_overpay
          FROM v_full GROUP BY source, team""")
def tendencies(spark, sf):
    return mk.team_tendencies(b.budgeted_bids(spark, sf), ["source", "team"], b.CATEGORIES)


@query("w13_spend_by_week", "week:i share:d cumulative:d",
       """SELECT week, share, sum(share) OVER (ORDER BY week) AS cumulative FROM (
            SELECT w.week, sum(coalesce(v / total, 0)) / count(*) AS share
            FROM (SELECT unnest(range(1, 13)) AS week) w CROSS JOIN (SELECT season, sum(cost) AS total FROM v_bids WHERE signal = 'won' AND cost > 0 GROUP BY season) t
            LEFT JOIN (SELECT season, week, sum(cost) AS v FROM v_bids WHERE signal = 'won' AND cost > 0 GROUP BY season, week) s ON s.season = t.season AND s.week = w.week
            GROUP BY w.week)""")
def spend_by_week(spark, sf):
    return mk.spend_by_week(b.bids(spark, sf), b.WEEKS)


@query("a45_median_by_week", "week:i n:i mean:d p25:d p50:d p75:d p90:d",
       f"SELECT least(week, 10) AS week, count(*) AS n, avg(pct) AS mean, {QUANTS} FROM v_wins GROUP BY least(week, 10)")
def median_by_week(spark, sf):
    rows = wins(spark, sf).withColumn("week", F.least(F.col("week"), F.lit(10)))
    return mk.summarize(rows, ["week"], "pct")


@query("a46_local_lens", "source:i category:s bucket:s basis:s n:i ratio:d shrunk:d",
       """SELECT source, category, bucket, basis, n, p50 / pool AS ratio, 1 + (p50 / pool - 1) * (n / (n + 10.0)) AS shrunk FROM (
            SELECT c.source, c.category, c.bucket, CASE WHEN c.n >= 8 THEN 'bucket' ELSE 'position' END AS basis,
              CASE WHEN c.n >= 8 THEN c.n ELSE p.n END AS n, CASE WHEN c.n >= 8 THEN c.p50 ELSE p.p50 END AS p50,
              CASE WHEN c.n >= 8 THEN c.pool_p50 ELSE coalesce(k.p50, a.p50) END AS pool
            FROM v_fallback c JOIN (SELECT source, category, count(*) AS n, quantile_cont(pct, 0.5) AS p50 FROM v_wins GROUP BY source, category) p
              ON p.source = c.source AND p.category = c.category
            LEFT JOIN (SELECT * FROM v_base WHERE n >= 30 AND category <> 'All' AND bucket = 'All') k ON k.category = c.category
            LEFT JOIN (SELECT * FROM v_base WHERE n >= 30 AND category = 'All' AND bucket = 'All') a ON TRUE)""")
def lens(spark, sf):
    return mk.local_lens(wins(spark, sf), baselines(spark, sf), own=keyed_wins(spark, sf))[0]


@query("a46_latest_comparables", f"source:i category:s bucket:s pos:i season:i week:i pct:d {TID_SPEC}",
       f"""SELECT *, {TID} FROM (SELECT *, row_number() OVER (PARTITION BY source, category, bucket ORDER BY season DESC, week DESC, tid) AS pos FROM v_wins) WHERE pos <= 6""")
def comparables(spark, sf):
    return with_tid(mk.latest(keyed_wins(spark, sf), ["source", "category", "bucket"], 6))


VIEWS["v_pairs"] = """
    SELECT w.category, w.pct AS actual, m.target AS pred FROM v_wins w JOIN (
      SELECT season, week, entity, avg(pct) AS target FROM v_full WHERE kind = 'WAIVER' GROUP BY season, week, entity) m USING (season, week, entity)"""


@b.written_once
def pairs(spark, sf):
    rows = b.budgeted_bids(spark, sf)
    pred = rows.where(F.col("kind") == "WAIVER").groupBy("season", "week", "entity").agg(F.avg("pct").alias("pred"))
    won = rows.where(mk.contested_win()).select("season", "week", "entity", "category", F.col("pct").alias("actual"))
    return won.join(pred, ["season", "week", "entity"])


@query("a47_prediction_error", "category:s n:i mae:d within:d med_pred:d med_actual:d bias:d",
       """SELECT coalesce(category, 'All') AS category, count(*) AS n, avg(abs(actual - pred)) AS mae, avg(CAST(abs(actual - pred) <= 0.03 AS INT)) AS within,
            quantile_cont(pred, 0.5) AS med_pred, quantile_cont(actual, 0.5) AS med_actual, quantile_cont(actual - pred, 0.5) AS bias
          FROM v_pairs GROUP BY ROLLUP (category)""")
def prediction_error(spark, sf):
    return mk.miss_stats(pairs(spark, sf))


@query("a48_calibration", "bin:i n:i predicted:d actual:d",
       """SELECT bin, count(*) AS n, avg(p) AS predicted, avg(y) AS actual FROM (
            SELECT p, y, CASE WHEN p < 0 THEN NULL WHEN p < 0.05 THEN 0 WHEN p < 0.1 THEN 1 WHEN p < 0.2 THEN 2 WHEN p < 0.35 THEN 3 WHEN p < 0.5 THEN 4 WHEN p < 1.0001 THEN 5 END AS bin
            FROM (SELECT bid / 105.0 AS p, CAST(signal = 'won' AS DOUBLE) AS y FROM v_bids)) WHERE bin IS NOT NULL GROUP BY bin""")
def calibration(spark, sf):
    points = b.bids(spark, sf).select((F.col("bid") / 105.0).alias("p"), (F.col("signal") == "won").cast("double").alias("y"))
    return mk.calibration(points)


@query("m16_value_clusters", "category:s cluster:i n:i low:d high:d",
       """SELECT category, cluster, count(*) AS n, min(v) AS low, max(v) AS high FROM (
            SELECT category, v, sum(CAST(gap IS NULL OR gap > 0.05 AS INT)) OVER (PARTITION BY category ORDER BY v, rn) AS cluster FROM (
              SELECT category, v, row_number() OVER (PARTITION BY category ORDER BY v) AS rn, v - lag(v) OVER (PARTITION BY category ORDER BY v) AS gap
              FROM (SELECT event_type AS category, value AS v FROM events))) GROUP BY category, cluster""")
def clusters(spark, sf):
    rows = b.table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("value").alias("v"))
    return mk.cluster_values(rows, ["category"], "v", 0.05).withColumnRenamed("_x", "x")


@query("w25_weighted_percentiles", "source:i w25:d w50:d w90:d",
       """SELECT source, min(pct) FILTER (WHERE cum >= 0.25 * total * (1 - 1e-12)) AS w25, min(pct) FILTER (WHERE cum >= 0.5 * total * (1 - 1e-12)) AS w50,
            min(pct) FILTER (WHERE cum >= 0.9 * total * (1 - 1e-12)) AS w90 FROM (
            SELECT source, pct, sum(w) OVER (PARTITION BY source ORDER BY pct) AS cum, sum(w) OVER (PARTITION BY source) AS total
            FROM (SELECT source, pct, sum(cast(n_bids AS DOUBLE)) AS w FROM v_wins GROUP BY source, pct)) GROUP BY source""")
def weighted(spark, sf):
    rows = wins(spark, sf).withColumn("w", F.col("n_bids").cast("double"))
    return weighted_percentiles_any_size(rows, ["source"], "pct", "w", {"w25": 0.25, "w50": 0.5, "w90": 0.9})


@query("s28_backtest_pairs", "source:i season:i week:i entity:i actual:d pred:d",
       """SELECT w.source, w.season, w.week, w.entity, max(w.pct) AS actual, max(m.m) AS pred FROM v_wins w JOIN
            (SELECT season, week, entity, quantile_cont(pct, 0.5) AS m FROM v_wins GROUP BY season, week, entity) m USING (season, week, entity)
          GROUP BY w.source, w.season, w.week, w.entity""")
def backtest_pairs(spark, sf):
    won = wins(spark, sf)
    med = percentiles_any_size(won, ["season", "week", "entity"], "pct", {"pred": 0.5})
    actual = won.groupBy("source", "season", "week", "entity").agg(F.max("pct").alias("actual"))
    return actual.join(med, ["season", "week", "entity"])
