"""Schedule, conceded points, index and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.functions.expected import weekly_stat_rows
from rivalgrid.functions.scoring import score
from rivalgrid.operators import allowed as al
from rivalgrid.operators import curves as cv
from rivalgrid.operators import grids as gr
from rivalgrid.operators.ranking import leave_one_out, rank_by_category, row_numbers, trailing
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS

CURRENT = 2001
INDEX_BOUNDS = (0.5, 1.5)
WINDOWS = {"faced": (1, 5), "reg": (6, 9), "playoffs": (10, 12)}

VIEWS.update({
    "v_loo0": "SELECT * EXCLUDE (usual), coalesce(usual, 0.0) AS usual FROM v_loo",
    "v_allowed0": """
        SELECT d.season, d.week, d.grp, d.opp, d.category, d.pts, o.pts AS allowed, o.usual AS opp_usual,
               row_number() OVER (PARTITION BY d.season, d.grp, d.category ORDER BY d.week DESC) AS back
        FROM v_grid d JOIN v_loo0 o ON o.season = d.season AND o.week = d.week AND o.grp = d.opp AND o.category = d.category""",
    "v_facts": """
        SELECT a.*, league_avg FROM (
          SELECT season, grp, category, avg(allowed) AS allowed, avg(allowed) FILTER (WHERE back <= 5) AS last_allowed,
                 avg(opp_usual) AS opp_avg FROM v_allowed0 GROUP BY season, grp, category) a
        JOIN (SELECT season, category, avg(pts) AS league_avg FROM v_grid GROUP BY season, category) l
          ON a.season = l.season AND a.category = l.category""",
    "v_complete": """
        SELECT season, coalesce(max(week) FILTER (WHERE ok), 0) AS weeks_complete FROM (
          SELECT season, week, bool_and(done) OVER (PARTITION BY season ORDER BY week) AS ok FROM (
            SELECT season, week, bool_and(final) AS done FROM v_final GROUP BY season, week)) GROUP BY season""",
    "v_index": """
        SELECT coalesce(c.grp, p.grp) AS grp, coalesce(c.category, p.category) AS category, c.allowed, c.last_allowed,
               CASE WHEN c.opp_avg > 0 THEN c.league_avg / c.opp_avg ELSE 1.0 END AS factor,
               greatest(0.5, least(1.5, w * CASE WHEN c.opp_avg > 0 THEN (0.4 * c.last_allowed + 0.6 * c.allowed) / c.opp_avg ELSE 1.0 END
                 + (1 - w) * CASE WHEN p.opp_avg > 0 THEN p.allowed / p.opp_avg ELSE 1.0 END)) AS idx,
               CASE WHEN w >= 1 THEN 2001 ELSE 2000 END AS season_used
        FROM (SELECT * FROM v_facts WHERE season = 2001) c
        FULL JOIN (SELECT * FROM v_facts WHERE season = 2000) p ON c.grp = p.grp AND c.category = p.category
        CROSS JOIN (SELECT least(weeks_complete / 4.0, 1.0) AS w FROM v_complete WHERE season = 2001)""",
    "v_ranked": """
        SELECT *, row_number() OVER (PARTITION BY season, category ORDER BY ppg DESC, entity) AS rank
        FROM v_avg WHERE n >= 6""",
    "v_curve": """
        SELECT category, rank, sd, min(raw) OVER (PARTITION BY category ORDER BY rank) AS ppg FROM (
          SELECT category, rank, avg(ppg) AS raw, avg(sd) AS sd FROM v_ranked WHERE season < 2001 GROUP BY category, rank)""",
    "v_curve_now": """
        SELECT category, rank, sd, min(raw) OVER (PARTITION BY category ORDER BY rank) AS ppg FROM (
          SELECT category, rank, avg(ppg) AS raw, avg(sd) AS sd FROM v_ranked WHERE season = 2001 GROUP BY category, rank)""",
    "v_project": """
        SELECT e.entity, e.grp, e.category, s.week, s.opp, i.idx, coalesce(c.sd, 0.0) AS sd,
          CASE WHEN s.opp IS NULL THEN 0.0 ELSE coalesce(c.ppg, 0.0) * (1 + 0.5 * (coalesce(i.idx, 1.0) - 1)) END AS own_projected,
          CASE WHEN s.opp IS NULL OR (s.week = 6 AND e.status = 'OUT') OR (s.week < e.return_week) THEN 0.0
               WHEN e.entity % 7 = 0 AND s.week % 2 = 0 THEN CAST(e.entity % 40 AS DOUBLE)
               ELSE coalesce(c.ppg, 0.0) * (1 + 0.5 * (coalesce(i.idx, 1.0) - 1)) END AS projected,
          CASE WHEN s.opp IS NULL THEN NULL WHEN s.week = 6 AND e.status = 'OUT' THEN 'injury:OUT'
               WHEN s.week = 6 AND s.week < e.return_week THEN 'return_week:' || e.return_week END AS zero_reason
        FROM (SELECT s_suppkey AS entity, s_nationkey AS grp,
                CASE s_suppkey % 5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'K' END AS category,
                r.rank, CASE WHEN s_acctbal < 500 THEN 'OUT' ELSE 'ACTIVE' END AS status,
                CASE WHEN s_acctbal > 9000 THEN 8 END AS return_week
              FROM supplier LEFT JOIN (SELECT * FROM v_ranked WHERE season = 2000) r ON s_suppkey = r.entity) e
        JOIN (SELECT * FROM v_sched WHERE season = 2001 AND week >= 6) s ON s.grp = e.grp
        LEFT JOIN (SELECT category, max(rank) AS top FROM v_curve GROUP BY category) m ON m.category = e.category
        LEFT JOIN v_curve c ON c.category = e.category AND c.rank = least(e.rank, m.top)
        LEFT JOIN v_index i ON i.grp = s.opp AND i.category = e.category""",
})


@query("j03_schedule_edges", "season:i week:i grp:i opp:n home:n", "SELECT * FROM v_sched")
def schedule_edges(spark, sf):
    """Both perspectives of each game, completed with bye rows."""
    sched = b.schedule(spark, sf)
    home = sched.where("home").select(
        "season", "week", F.col("grp").alias("home_grp"), F.col("opp").alias("away_grp"),
        F.lit(None).alias("home_score"), F.lit(None).alias("away_score"))
    edges = gr.both_sides(home).drop("own_score", "opp_score")
    return gr.with_byes(edges)


@query("s15_team_games", "season:i week:i manager:i opp:i pf:d pa:d home:b result:s",
       """SELECT a.season, a.week, a.grp AS manager, a.opp, a.pf, b.pf AS pa, a.home,
          CASE WHEN a.pf > b.pf THEN 'W' WHEN a.pf < b.pf THEN 'L' ELSE 'T' END AS result
          FROM v_score a JOIN v_score b ON a.season = b.season AND a.week = b.week AND a.opp = b.grp""")
def team_games(spark, sf):
    """Match rows exploded to one row per side."""
    s = b.scores(spark, sf)
    away = s.where(~F.col("home")).select("season", "week", F.col("opp").alias("grp"), F.col("pf").alias("away_score"))
    matches = s.where("home").join(away, ["season", "week", "grp"]).select(
        "season", "week", F.col("grp").alias("home_grp"), F.col("opp").alias("away_grp"),
        F.col("pf").alias("home_score"), "away_score")
    rows = gr.both_sides(matches)
    result = F.when(F.col("own_score") > F.col("opp_score"), "W").when(F.col("own_score") < F.col("opp_score"), "L").otherwise("T")
    return rows.withColumn("result", result).withColumnsRenamed({"grp": "manager", "own_score": "pf", "opp_score": "pa"})


@query("a14_weeks_complete", "season:i weeks_complete:i", "SELECT * FROM v_complete")
def complete(spark, sf):
    return gr.weeks_complete(b.games(spark, sf))


@query("a15_weeks_played_byes", "season:i grp:i weeks_played:i bye_week:i",
       """SELECT s.season, grp, weeks_played, bye_week
          FROM (SELECT season, grp, min(week) FILTER (WHERE opp IS NULL) AS bye_week FROM v_sched GROUP BY season, grp) s
          JOIN (SELECT season, coalesce(max(week) FILTER (WHERE final), 0) AS weeks_played FROM v_final GROUP BY season) p
            ON s.season = p.season WHERE bye_week IS NOT NULL""")
def played_and_byes(spark, sf):
    return gr.bye_weeks(b.schedule(spark, sf)).join(gr.weeks_played(b.games(spark, sf)), "season")


@query("a16_final_flags", "season:i week:i grp:i final:b home:b own:d other:d kickoff:s",
       """SELECT f.season, f.week, f.grp, f.final, f.home, s.pf AS own, o.pf AS other,
            strftime(timezone('UTC', timezone('America/New_York', make_timestamp(f.season, f.week, 1 + f.grp, 13, 0, 0))), '%Y-%m-%d %H:%M') AS kickoff
          FROM v_final f LEFT JOIN v_score s ON s.season = f.season AND s.week = f.week AND s.grp = f.grp
          LEFT JOIN v_score o ON o.season = f.season AND o.week = f.week AND o.grp = f.opp""")
def final_flags(spark, sf):
    s = b.scores(spark, sf).select("season", "week", "grp", F.col("pf").alias("own"))
    o = s.select("season", "week", F.col("grp").alias("opp"), F.col("own").alias("other"))
    local = F.make_timestamp("season", "week", F.col("grp") + 1, F.lit(13), F.lit(0), F.lit(0))
    g = b.games(spark, sf).withColumn("kickoff", F.date_format(F.to_utc_timestamp(local, "America/New_York"), "yyyy-MM-dd HH:mm"))
    return g.join(s, ["season", "week", "grp"], "left").join(o, ["season", "week", "opp"], "left")


@query("s23_complete_periods_only", "season:i week:i n:i pts:d",
       """SELECT p.season, p.week, count(*) AS n, sum(pts) AS pts FROM v_perf p JOIN v_complete c ON p.season = c.season
          WHERE p.week <= c.weeks_complete GROUP BY p.season, p.week""")
def complete_only(spark, sf):
    rows = gr.complete_periods_only(b.perf(spark, sf), b.games(spark, sf))
    return rows.groupBy("season", "week").agg(F.count(F.lit(1)).alias("n"), F.sum("pts").alias("pts"))


@query("p14_score_rows", "season:i week:i entity:i grp:i category:s pts:d",
       "SELECT season, week, entity, grp, category, pts FROM v_perf")
def score_rows(spark, sf):
    return b.perf(spark, sf)


@query("p15_score_unit_rows", "season:i week:i grp:i points_allowed:d yards_allowed:d unit_pts:d",
       """WITH u AS (SELECT season, week, grp, opp, floor(pf / 64) AS own, pf AS yards FROM v_score)
          SELECT season, week, grp, points_allowed, yards_allowed,
            1.0 * floor(own / 4) + 2.0 * (own % 3)
            + 5.0 * CAST(points_allowed = 0 AS INT) + 4.0 * CAST(points_allowed BETWEEN 1 AND 6 AS INT)
            + 3.0 * CAST(points_allowed BETWEEN 7 AND 13 AS INT) + 1.0 * CAST(points_allowed BETWEEN 14 AND 17 AS INT)
            - 1.0 * CAST(points_allowed BETWEEN 28 AND 34 AS INT) - 3.0 * CAST(points_allowed BETWEEN 35 AND 45 AS INT)
            - 5.0 * CAST(points_allowed >= 46 AS INT) + 2.0 * CAST(yards_allowed BETWEEN 200 AND 299 AS INT)
            - 7.0 * CAST(yards_allowed >= 550 AS INT) AS unit_pts
          FROM (SELECT a.*, o.own AS points_allowed, o.yards AS yards_allowed FROM u a JOIN u o
                ON a.season = o.season AND a.week = o.week AND a.opp = o.grp)""")
def score_unit_rows(spark, sf):
    return unit_table(spark, sf)


UNIT_RULES = [("SK", 1.0), ("INT", 2.0), ("PA0", 5.0), ("PA1", 4.0), ("PA7", 3.0), ("PA14", 1.0), ("PA28", -1.0),
              ("PA35", -3.0), ("PA46", -5.0), ("YA299", 2.0), ("YA550", -7.0), ("REC", 1.0), ("PY", 0.0)]


def unit_table(spark, sf):
    own = F.floor(F.col("pf") / 64).cast("double")
    rows = b.scores(spark, sf).select(
        "season", "week", "grp", "opp", "home", own.alias("own_score"), F.col("pf").alias("yards"),
        F.floor(own / 4).cast("double").alias("def_sacks"), (own % 3).alias("def_interceptions"))
    return al.unit_rows(rows, UNIT_RULES)


@query("j01_opponent_rows", "season:i week:i grp:i opp:i own:d other:d",
       """SELECT a.season, a.week, a.grp, a.opp, a.pf AS own, b.pf AS other FROM v_score a JOIN v_score b
          ON a.season = b.season AND a.week = b.week AND a.opp = b.grp""")
def opponent_rows(spark, sf):
    rows = gr.with_opponent(b.scores(spark, sf), ["season", "week"], {"pf": "other"})
    return rows.withColumnRenamed("pf", "own")


@query("a01_points_by_group", "season:i week:i grp:i category:s pts:d", "SELECT * FROM v_points")
def points(spark, sf):
    return al.points_by_group(b.perf(spark, sf))


@query("a02_expected_points_by_group", "season:i week:i grp:i category:s pts:d",
       """SELECT season, week, grp, category, sum(0.5 * (receptions * 0.75) + 0.0625 * (receiving_yards * 0.5)
            + floor((rushing_yards * 0.5) / 10.0) + 0.25 * carries) AS pts
          FROM v_perf GROUP BY season, week, grp, category""")
def expected_points(spark, sf):
    exp = b.perf(spark, sf).select(
        F.col("season").cast("string").alias("season"), "week", "grp", "category", "entity",
        (F.col("receptions") * 0.75).alias("receptions_exp"), (F.col("receiving_yards") * 0.5).alias("rec_yards_gained_exp"),
        (F.col("rushing_yards") * 0.5).alias("rush_yards_gained_exp"), F.col("carries").alias("rush_attempt"))
    # the expected source carries its season as text
    rows = weekly_stat_rows(exp, ["season", "week", "grp", "category", "entity"]).withColumn("season", F.col("season").cast("int"))
    return al.points_by_group(score(rows, b.RULES))


@query("j02_conceded", "season:i week:i grp:i opp:i category:s pts:d allowed:d",
       "SELECT season, week, grp, opp, category, pts, allowed FROM v_allowed")
def conceded(spark, sf):
    return al.conceded(b.dense(spark, sf))


@query("w03_leave_one_out", "season:i week:i grp:i category:s pts:d usual:d usual0:d",
       "SELECT season, week, grp, category, pts, usual, coalesce(usual, 0.0) AS usual0 FROM v_loo")
def leave_out(spark, sf):
    d = leave_one_out(b.dense(spark, sf), al.UNIT, "pts", "usual")
    return leave_one_out(d, al.UNIT, "pts", "usual0", alone=0.0)


@query("w04_trailing_periods", "season:i week:i grp:i category:s allowed:d",
       "SELECT season, week, grp, category, allowed FROM v_allowed0 WHERE back <= 5")
def trailing_periods(spark, sf):
    return trailing(al.conceded(b.dense(spark, sf)), al.UNIT, "week", 5)


@query("a07_league_average", "season:i category:s league_avg:d",
       "SELECT season, category, avg(pts) AS league_avg FROM v_grid GROUP BY season, category")
def league_average(spark, sf):
    return al.league_average(b.dense(spark, sf))


@query("a08_opponents_usual", "season:i grp:i category:s opp_avg:d", "SELECT season, grp, category, opp_avg FROM v_facts")
def opponents_usual(spark, sf):
    return al.opponents_usual(b.dense(spark, sf))


@query("a09_mean_ratio_index", "basis:s season:i grp:i category:s mean_ratio:d allowed_avg:d",
       """SELECT 'all' AS basis, season, grp, category, coalesce(avg(CASE WHEN opp_usual > 0 THEN allowed / opp_usual END), 1.0) AS mean_ratio,
            avg(allowed) AS allowed_avg FROM v_allowed0 GROUP BY season, grp, category
          UNION ALL
          SELECT 'last' AS basis, season, grp, category, coalesce(avg(CASE WHEN opp_usual > 0 THEN allowed / opp_usual END), 1.0),
            avg(allowed) FROM v_allowed0 WHERE back <= 5 GROUP BY season, grp, category""")
def mean_ratio(spark, sf):
    """The basis is a parameter, not a callback."""
    d = b.dense(spark, sf)
    return al.mean_ratio_index(d).withColumn("basis", F.lit("all")).unionByName(
        al.mean_ratio_index(d, last=5).withColumn("basis", F.lit("last")))


def current_index(spark, sf):
    return al.matchup_index(
        b.dense(spark, sf), CURRENT, gr.weeks_complete(b.games(spark, sf)), bounds=INDEX_BOUNDS)


@query("a10_matchup_index",
       "grp:i category:s idx:d allowed:d last_allowed:d factor:d adjusted:d season_used:i rank:i",
       """SELECT *, allowed * factor AS adjusted, row_number() OVER (PARTITION BY category ORDER BY idx DESC, grp) AS rank FROM v_index""")
def index(spark, sf):
    return current_index(spark, sf)


@query("a11_schedule_strength", "win:s category:s grp:i avg_idx:d n_games:i rank:i",
       """SELECT *, row_number() OVER (PARTITION BY win, category ORDER BY round(avg_idx, 9) DESC, grp) AS rank FROM (
            SELECT w.win, i.category, s.grp, avg(i.idx) AS avg_idx, count(*) AS n_games
            FROM v_sched s JOIN (VALUES ('faced', 1, 5), ('reg', 6, 9), ('playoffs', 10, 12)) w(win, lo, hi) ON s.week BETWEEN lo AND hi
            JOIN v_index i ON i.grp = s.opp WHERE s.season = 2001 GROUP BY w.win, i.category, s.grp)""")
def strength(spark, sf):
    sched = b.schedule(spark, sf).where(F.col("season") == CURRENT)
    out = al.schedule_strength(current_index(spark, sf), sched, WINDOWS)
    # ranks on rounded averages: the order of summing must not decide a tie
    return rank_by_category(out.withColumn("_r", F.round("avg_idx", 9)), ["win", "category"], "_r", ["grp"])


@query("a12_allowed_detail",
       "season:i week:i grp:i opp:i category:s allowed:d receiving_yards:d carries:d n_members:i top_entity:i",
       """SELECT f.season, f.week, f.grp, f.opp, t.* EXCLUDE (season, week, grp) FROM (SELECT * FROM v_final WHERE final) f JOIN (
            SELECT season, week, grp, category, sum(pts) AS allowed, sum(receiving_yards) AS receiving_yards, sum(carries) AS carries,
              count(*) AS n_members, first(entity ORDER BY pts DESC, entity) AS top_entity
            FROM v_perf GROUP BY season, week, grp, category) t ON t.season = f.season AND t.week = f.week AND t.grp = f.opp""")
def detail(spark, sf):
    return al.allowed_detail(b.perf(spark, sf), b.played(spark, sf), ["receiving_yards", "carries"])


@query("a12_allowed_members", "season:i week:i grp:i opp:i category:s pos:i entity:i pts:d carries:d",
       """SELECT f.season, f.week, f.grp, f.opp, p.category, p.pos, p.entity, p.pts, p.carries FROM v_final f JOIN (
            SELECT *, row_number() OVER (PARTITION BY season, week, grp, category ORDER BY pts DESC, entity) AS pos FROM v_perf) p
          ON p.season = f.season AND p.week = f.week AND p.grp = f.opp WHERE f.final""")
def members(spark, sf):
    return al.allowed_members(b.perf(spark, sf), b.played(spark, sf), ["carries"])


@query("a13_allowed_detail_units", "season:i week:i grp:i opp:i home:b allowed:d",
       """SELECT season, week, grp, opp, home, other AS allowed FROM (
            SELECT a.season, a.week, a.grp, a.opp, a.home, floor(b.pf / 64) AS other FROM v_score a JOIN v_score b
            ON a.season = b.season AND a.week = b.week AND a.opp = b.grp)""")
def detail_units(spark, sf):
    return unit_table(spark, sf).withColumnRenamed("points_allowed", "allowed")


@query("j04_remaining_schedule", "season:i week:i grp:i opp:n home:n allowed:d",
       """SELECT s.season, s.week, s.grp, s.opp, s.home, a.allowed FROM v_sched s LEFT JOIN
          (SELECT season, week, grp, sum(allowed) AS allowed FROM v_allowed GROUP BY season, week, grp) a
          ON s.season = a.season AND s.week = a.week AND s.grp = a.grp""")
def remaining(spark, sf):
    detail = al.conceded(b.dense(spark, sf)).groupBy("season", "week", "grp").agg(F.sum("allowed").alias("allowed"))
    return gr.remaining_schedule(detail, b.schedule(spark, sf))


ALLOWED_SQL = """
    SELECT *, row_number() OVER (PARTITION BY season, category ORDER BY per_game DESC NULLS LAST, grp) AS rank,
           CASE WHEN diff IS NOT NULL THEN row_number() OVER (PARTITION BY season, category ORDER BY diff DESC NULLS LAST, grp) END AS diff_rank,
           CASE WHEN last_diff IS NOT NULL THEN row_number() OVER (PARTITION BY season, category ORDER BY last_diff DESC NULLS LAST, grp) END AS last_diff_rank
    FROM (SELECT season, category, grp, count(*) AS games, sum(allowed) AS total, avg(allowed) AS per_game,
                 avg(allowed - opp_usual) AS diff, avg(opp_usual) AS opp_avg,
                 avg(allowed) FILTER (WHERE back <= 5) AS last_n, avg(opp_usual) FILTER (WHERE back <= 5) AS last_opp_avg,
                 avg(allowed - opp_usual) FILTER (WHERE back <= 5) AS last_diff
          FROM (SELECT *, row_number() OVER (PARTITION BY season, grp, category ORDER BY week DESC) AS back FROM v_allowed)
          GROUP BY season, category, grp)"""


@query("a60_allowed_table",
       "season:i category:s grp:i games:i total:d per_game:d diff:d opp_avg:d last_n:d last_opp_avg:d last_diff:d rank:n diff_rank:n last_diff_rank:n",
       ALLOWED_SQL)
def allowed_table(spark, sf):
    return al.allowed_table(b.dense(spark, sf))


@query("a61_schedule_strength_raw_diff", "win:s category:s grp:i n_games:i avg_raw:d avg_diff:d rank_raw:n rank_diff:n",
       f"""WITH t AS ({ALLOWED_SQL})
           SELECT *, row_number() OVER (PARTITION BY win, category ORDER BY round(avg_raw, 9) DESC NULLS LAST, grp) AS rank_raw,
             CASE WHEN avg_diff IS NOT NULL THEN row_number() OVER (PARTITION BY win, category ORDER BY round(avg_diff, 9) DESC NULLS LAST, grp) END AS rank_diff
           FROM (SELECT w.win, t.category, s.grp, count(*) AS n_games, avg(t.per_game) AS avg_raw, avg(t.diff) AS avg_diff
             FROM v_sched s JOIN (VALUES ('faced', 1, 5), ('reg', 6, 9), ('playoffs', 10, 12)) w(win, lo, hi) ON s.week BETWEEN lo AND hi
             JOIN t ON t.season = 2001 AND t.grp = s.opp WHERE s.season = 2001 GROUP BY w.win, t.category, s.grp)""")
def strength_raw_diff(spark, sf):
    sched = b.schedule(spark, sf).where(F.col("season") == CURRENT)
    table = al.allowed_table(b.dense(spark, sf)).where(F.col("season") == CURRENT)
    keys = ["win", "category", "grp"]
    raw, diff = (
        al.schedule_strength(table, sched, WINDOWS, value=v, bounds=None, default=None)
        .withColumn("_r", F.round("avg_idx", 9)).drop("rank") for v in ("per_game", "diff"))
    raw = rank_by_category(raw, ["win", "category"], "_r", ["grp"], "rank_raw").withColumnRenamed("avg_idx", "avg_raw")
    diff = rank_by_category(diff, ["win", "category"], "_r", ["grp"], "rank_diff").withColumnRenamed("avg_idx", "avg_diff")
    return raw.drop("_r").join(diff.select(*keys, "avg_diff", "rank_diff"), keys)


@query("a62_chart_series", "season:i week:i grp:i category:s allowed:d opp_usual:d league:d",
       """SELECT a.season, a.week, a.grp, a.category, allowed, opp_usual, league_avg AS league FROM v_allowed a
          JOIN (SELECT season, category, avg(pts) AS league_avg FROM v_grid GROUP BY season, category) l
          ON a.season = l.season AND a.category = l.category""")
def chart(spark, sf):
    return al.chart_series(b.dense(spark, sf))


@query("a72_expected_opponent_average", "grp:i category:s expected:d",
       "SELECT grp, category, avg(allowed) OVER (PARTITION BY category) / factor AS expected FROM v_index")
def expected_opponent(spark, sf):
    from pyspark.sql import Window
    idx = current_index(spark, sf)
    return idx.withColumn("expected", F.avg("allowed").over(Window.partitionBy("category")) / F.col("factor"))


@query("a70_pivot_categories", "season:i grp:i QB:d RB:d WR:d TE:d K:d total:d",
       """SELECT season, grp, max(v) FILTER (WHERE category = 'QB') AS QB, max(v) FILTER (WHERE category = 'RB') AS RB,
            max(v) FILTER (WHERE category = 'WR') AS WR, max(v) FILTER (WHERE category = 'TE') AS TE,
            max(v) FILTER (WHERE category = 'K') AS K, sum(v) AS total
          FROM (SELECT season, grp, category, avg(allowed) AS v FROM v_allowed GROUP BY season, grp, category) GROUP BY season, grp""")
def pivot_categories(spark, sf):
    t = al.allowed_table(b.dense(spark, sf))
    return al.pivot_categories(t, ["season", "grp"], b.CATEGORIES, "per_game")


@query("a71_pivot_weeks", "season:i grp:i category:s w1:d w2:d w3:d w4:d w5:d w6:d w7:d w8:d w9:d w10:d w11:d w12:d average:d",
       "SELECT season, grp, category, " + ", ".join(f"max(allowed) FILTER (WHERE week = {w}) AS w{w}" for w in range(1, 13))
       + ", avg(allowed) AS average FROM v_allowed GROUP BY season, grp, category")
def pivot_weeks(spark, sf):
    cells = al.conceded(b.dense(spark, sf)).withColumn("wk", F.concat(F.lit("w"), F.col("week").cast("string")))
    wide = cells.groupBy(*al.UNIT).pivot("wk", [f"w{w}" for w in range(1, 13)]).agg(F.first("allowed"))
    return wide.join(cells.groupBy(*al.UNIT).agg(F.avg("allowed").alias("average")), al.UNIT)


@query("a59_all_categories_or_null", "season:i week:i grp:i allowed:d pts:d",
       """SELECT season, week, grp, CASE WHEN count(v) = 5 THEN sum(v) END AS allowed, CASE WHEN count(pts) = 5 THEN sum(pts) END AS pts
          FROM (SELECT *, CASE WHEN allowed > 0 THEN allowed END AS v FROM v_allowed) GROUP BY season, week, grp""")
def all_categories(spark, sf):
    cells = al.conceded(b.dense(spark, sf)).withColumn("allowed", F.when(F.col("allowed") > 0, F.col("allowed")))
    return al.all_or_null(cells, ["season", "week", "grp"], 5, ["allowed", "pts"])


@query("a77_allowed_two_seasons", "season:i grp:i category:s allowed:d scored:d",
       "SELECT season, grp, category, sum(allowed) AS allowed, sum(pts) AS scored FROM v_allowed WHERE season >= 2000 GROUP BY season, grp, category")
def two_seasons(spark, sf):
    cells = al.conceded(b.dense(spark, sf).where(F.col("season").isin(CURRENT, CURRENT - 1)))
    return cells.groupBy(*al.UNIT).agg(F.sum("allowed").alias("allowed"), F.sum("pts").alias("scored"))


@query("p24_implied_totals", "season:i week:i grp:i opp:i implied_total:d opponent_implied_total:d",
       """SELECT a.season, a.week, a.grp, a.opp, a.t AS implied_total, b.t AS opponent_implied_total FROM (
            SELECT season, week, grp, opp, CASE WHEN home THEN (total + spread) / 2 ELSE (total - spread) / 2 END AS t
            FROM (SELECT h.season, h.week, x.grp, x.opp, x.home, h.pf + w.pf AS total,
                   CASE WHEN (h.pf + w.pf) > 100 THEN h.pf - w.pf END AS spread
                  FROM v_score x JOIN v_score h ON h.season = x.season AND h.week = x.week AND h.home AND (h.grp = x.grp OR h.grp = x.opp)
                  JOIN v_score w ON w.season = h.season AND w.week = h.week AND w.grp = h.opp)) a JOIN (
            SELECT season, week, grp, opp, CASE WHEN home THEN (total + spread) / 2 ELSE (total - spread) / 2 END AS t
            FROM (SELECT h.season, h.week, x.grp, x.opp, x.home, h.pf + w.pf AS total,
                   CASE WHEN (h.pf + w.pf) > 100 THEN h.pf - w.pf END AS spread
                  FROM v_score x JOIN v_score h ON h.season = x.season AND h.week = x.week AND h.home AND (h.grp = x.grp OR h.grp = x.opp)
                  JOIN v_score w ON w.season = h.season AND w.week = h.week AND w.grp = h.opp)) b
          ON a.season = b.season AND a.week = b.week AND a.opp = b.grp""")
def implied(spark, sf):
    rows = gr.with_opponent(b.scores(spark, sf), ["season", "week"], {"pf": "away_pf"}).where("home")
    total = F.col("pf") + F.col("away_pf")
    lines = rows.select(
        "season", "week", F.col("grp").alias("home_grp"), F.col("opp").alias("away_grp"), total.alias("total_line"),
        F.when(total > 100, F.col("pf") - F.col("away_pf")).alias("spread_line"))
    return gr.implied_totals(lines)


def ranked_entities(spark, sf):
    return cv.ranked_averages(cv.season_averages(b.perf(spark, sf), 6))


@query("a03_season_averages", "season:i category:s entity:i ppg:d sd:d games:i",
       "SELECT season, category, entity, ppg, sd, n AS games FROM v_avg WHERE n >= 6")
def averages(spark, sf):
    return cv.season_averages(b.perf(spark, sf), 6)


@query("a04_unit_season_averages", "season:i grp:i ppg:d sd:d games:i",
       """WITH u AS (SELECT season, week, grp, opp, floor(pf / 64) AS own, pf AS yards FROM v_score)
          SELECT season, grp, avg(p) AS ppg, stddev_pop(p) AS sd, count(*) AS games FROM (
            SELECT a.season, a.grp, floor(a.own / 4) + 2 * (a.own % 3) + CASE WHEN o.own = 0 THEN 5 WHEN o.own <= 6 THEN 4 WHEN o.own <= 13 THEN 3
              WHEN o.own <= 17 THEN 1 WHEN o.own <= 27 THEN 0 WHEN o.own <= 34 THEN -1 WHEN o.own <= 45 THEN -3 ELSE -5 END
              + CASE WHEN o.yards BETWEEN 200 AND 299 THEN 2 WHEN o.yards >= 550 THEN -7 ELSE 0 END AS p
            FROM u a JOIN u o ON a.season = o.season AND a.week = o.week AND a.opp = o.grp) GROUP BY season, grp HAVING count(*) >= 4""")
def unit_averages(spark, sf):
    rows = unit_table(spark, sf).withColumns({"category": F.lit("UNIT"), "entity": F.col("grp")})
    return cv.season_averages(rows, 4, "unit_pts").withColumnRenamed("entity", "grp")


@query("w01_rank_entities", "season:i category:s entity:i ppg:d rank:i", "SELECT season, category, entity, ppg, rank FROM v_ranked")
def rank_entities(spark, sf):
    return ranked_entities(spark, sf)


def history_curve(spark, sf):
    return cv.build_curve(ranked_entities(spark, sf).where(F.col("season") < CURRENT))


@query("a05_rank_curve", "category:s rank:i ppg:d sd:d starter_avg:d",
       """SELECT c.*, s.starter_avg FROM v_curve c JOIN (SELECT category, avg(ppg) AS starter_avg FROM v_curve WHERE rank <= 12 GROUP BY category) s
          ON c.category = s.category""")
def curve(spark, sf):
    c = history_curve(spark, sf)
    return c.join(cv.starter_average(c, 12), "category")


@query("w02_non_increasing", "category:s rank:i ppg:d", "SELECT category, rank, ppg FROM v_curve_now")
def monotone(spark, sf):
    return cv.build_curve(ranked_entities(spark, sf).where(F.col("season") == CURRENT))


@query("a06_blended_curve", "category:s rank:i ppg:d sd:d",
       """SELECT h.category, h.rank, CASE WHEN n.ppg IS NULL THEN h.ppg ELSE (1 - w) * h.ppg + w * n.ppg END AS ppg,
            CASE WHEN n.sd IS NULL THEN h.sd ELSE (1 - w) * h.sd + w * n.sd END AS sd
          FROM v_curve h LEFT JOIN v_curve_now n ON h.category = n.category AND h.rank = n.rank
          CROSS JOIN (SELECT least(weeks_complete / 8.0, 1.0) * 0.5 AS w FROM v_complete WHERE season = 2001)""")
def blended(spark, sf):
    ranked = ranked_entities(spark, sf)
    done = gr.weeks_complete(b.games(spark, sf))
    now = cv.build_curve(ranked.where(F.col("season") == CURRENT).join(done, "season"), keep=["weeks_complete"])
    return cv.blend_curves(cv.build_curve(ranked.where(F.col("season") < CURRENT)), now)


def projection_weeks(spark, sf):
    ranks = ranked_entities(spark, sf).where(F.col("season") == 2000).select("entity", "rank")
    ent = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"), b.category_of(F.col("s_suppkey")).alias("category"),
        F.when(F.col("s_acctbal") < 500, "OUT").otherwise("ACTIVE").alias("status"),
        F.when(F.col("s_acctbal") > 9000, 8).alias("return_week")).join(ranks, "entity", "left")
    sched = b.schedule(spark, sf).where(F.col("season") == CURRENT)
    external = ent.where(F.col("entity") % 7 == 0).select(
        "entity", F.explode(F.array(*[F.lit(w) for w in (6, 8, 10, 12)])).alias("week"),
        (F.col("entity") % 40).cast("double").alias("external"))
    return cv.project(ent, sched, history_curve(spark, sf), current_index(spark, sf), 6, 12, external=external, bounds=INDEX_BOUNDS)


@query("p25_project_entities", "entity:i grp:i category:s week:i opp:n idx:d own_projected:d projected:d sd:d zero_reason:s",
       "SELECT * FROM v_project")
def project(spark, sf):
    """Adjusted projection, zeroed by status or return week."""
    return projection_weeks(spark, sf)


TOTALS = """SELECT entity, grp, category, sum(projected) AS rest_total, coalesce(sum(projected) FILTER (WHERE week <= 10), 0) AS regular_total,
            coalesce(sum(projected) FILTER (WHERE week > 10), 0) AS playoff_total, coalesce(sum(projected) FILTER (WHERE week = 6), 0) AS this_week,
            max(zero_reason) AS zero_reason FROM v_project GROUP BY entity, grp, category"""


@query("a57_projection_totals",
       "entity:i grp:i category:s rest_total:d regular_total:d playoff_total:d this_week:d zero_reason:s", TOTALS)
def totals(spark, sf):
    return cv.projection_totals(projection_weeks(spark, sf), 6, 10)


@query("a73_weekly_arrays", "entity:i n_weeks:i first_week:i last_projected:d",
       """SELECT entity, count(*) AS n_weeks, min(week) AS first_week, last(projected ORDER BY week) AS last_projected FROM v_project GROUP BY entity""")
def arrays(spark, sf):
    w = cv.weekly_arrays(projection_weeks(spark, sf), ["entity"], ["projected", "opp"])
    return w.select("entity", F.size("weekly").alias("n_weeks"), F.col("weekly")[0]["week"].alias("first_week"),
                    F.element_at("weekly", -1)["projected"].alias("last_projected"))


@query("a63_category_sd", "category:s category_sd:d", "SELECT category, avg(sd) AS category_sd FROM v_avg WHERE n >= 6 GROUP BY category")
def category_sd(spark, sf):
    return cv.category_sd(cv.season_averages(b.perf(spark, sf), 6))


@query("w26_running_total_rank", "season:i category:s entity:i total:d rank:i",
       "SELECT season, category, entity, total, row_number() OVER (PARTITION BY season, category ORDER BY total DESC, entity) AS rank FROM v_avg")
def total_rank(spark, sf):
    return cv.running_total_rank(b.perf(spark, sf))


@query("w27_overall_rank", "season:i entity:i total:d overall_rank:i",
       """SELECT season, entity, total, coalesce(g.rank, own) AS overall_rank FROM (
            SELECT season, entity, total, row_number() OVER (PARTITION BY season ORDER BY total DESC, entity) AS own FROM v_avg) a
          LEFT JOIN (SELECT s_suppkey, CAST(floor(s_acctbal / 100) AS INT) AS rank FROM supplier WHERE s_acctbal > 8000) g ON a.entity = g.s_suppkey""")
def overall(spark, sf):
    t = b.perf(spark, sf).groupBy("season", "entity").agg(F.sum("pts").alias("total"))
    given = b.table(spark, sf, "supplier").where(F.col("s_acctbal") > 8000).select(
        F.col("s_suppkey").alias("entity"), F.floor(F.col("s_acctbal") / 100).cast("int").alias("rank"))
    return cv.overall_rank(t, given)


@query("w12_trailing_averages", "season:i week:i entity:i trailing_avg:d to_date_avg:d",
       """SELECT season, week, entity, avg(pts) OVER (PARTITION BY season, entity ORDER BY week RANGE BETWEEN 3 PRECEDING AND 2 PRECEDING) AS trailing_avg,
            avg(pts) OVER (PARTITION BY season, entity ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS to_date_avg FROM v_perf""")
def trailing_avgs(spark, sf):
    return cv.trailing_averages(b.perf(spark, sf))


@query("p30_actual_or_missing", "season:i week:i entity:i final:b actual:d missed:b",
       """SELECT season, week, entity, final, CASE WHEN final THEN coalesce(pts, CASE WHEN active THEN 0.0 END) END AS actual,
            final AND pts IS NULL AND NOT active AS missed
          FROM (SELECT f.season, f.week, s_suppkey AS entity, f.final, p.pts, (s_suppkey + f.week) % 3 = 0 AS active
            FROM supplier JOIN v_final f ON f.grp = s_nationkey LEFT JOIN v_perf p ON p.season = f.season AND p.week = f.week AND p.entity = s_suppkey)""")
def actual(spark, sf):
    """A real zero is not a missing value; missed periods are marked."""
    ent = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"))
    grid = ent.join(b.games(spark, sf), "grp")
    active = grid.where((F.col("entity") + F.col("week")) % 3 == 0)
    return cv.actual_or_missing(grid, b.perf(spark, sf), active)


@query("a65_detail_total_check", "season:i week:i grp:i header:d detail:d",
       """SELECT * FROM (SELECT s.season, s.week, s.grp, s.pf AS header, d.pts AS detail FROM v_score s JOIN
            (SELECT season, week, grp, sum(pts) AS pts FROM v_perf WHERE category <> 'K' GROUP BY season, week, grp) d
            ON s.season = d.season AND s.week = d.week AND s.grp = d.grp) WHERE abs(header - detail) > 0.01""")
def detail_check(spark, sf):
    """Group-weeks whose member detail does not add up to the header (here: a category left out)."""
    detail = b.perf(spark, sf).where(F.col("category") != "K").groupBy("season", "week", "grp").agg(F.sum("pts").alias("detail"))
    rows = b.scores(spark, sf).withColumnRenamed("pf", "header").join(detail, ["season", "week", "grp"])
    return rows.where(F.abs(F.col("header") - F.col("detail")) > 0.01)


@query("a64_category_strength", "season:i grp:i category:s avg_pts:d vs_average:d rank:i",
       """SELECT season, grp, category, avg_pts, avg_pts - avg(avg_pts) OVER (PARTITION BY season, category) AS vs_average,
            row_number() OVER (PARTITION BY season, category ORDER BY avg_pts DESC, grp) AS rank
          FROM (SELECT season, grp, category, avg(pts) AS avg_pts FROM v_grid GROUP BY season, grp, category)""")
def category_strength(spark, sf):
    from pyspark.sql import Window
    t = b.dense(spark, sf).groupBy(*al.UNIT).agg(F.avg("pts").alias("avg_pts"))
    t = t.withColumn("vs_average", F.col("avg_pts") - F.avg("avg_pts").over(Window.partitionBy("season", "category")))
    return rank_by_category(t, ["season", "category"], "avg_pts", ["grp"])


@query("a66_weakest_strongest", "season:i grp:i weakest:s strongest:s",
       """SELECT season, grp, arg_min(category, (rank, category)) AS weakest, arg_min(category, (-rank, category)) AS strongest FROM (
            SELECT season, grp, category, row_number() OVER (PARTITION BY season, category ORDER BY a, grp) AS rank
            FROM (SELECT season, grp, category, avg(pts) AS a FROM v_grid GROUP BY season, grp, category)) GROUP BY season, grp""")
def weakest_strongest(spark, sf):
    t = b.dense(spark, sf).groupBy(*al.UNIT).agg(F.avg("pts").alias("a"))
    t = row_numbers(t, ["season", "category"], [F.col("a").asc(), F.col("grp").asc()])
    return t.groupBy("season", "grp").agg(
        F.min_by("category", F.struct("rank", "category")).alias("weakest"),
        F.min_by("category", F.struct(-F.col("rank"), F.col("category"))).alias("strongest"))


@query("j08_period_for_date", "event_id:i period:n",
       """SELECT event_id, (SELECT max(p) FROM (VALUES (1, DATE '2024-01-08'), (2, DATE '2024-01-15'), (3, DATE '2024-01-22'), (4, DATE '2024-01-29')) s(p, d)
          WHERE d <= CAST(ts AS DATE)) AS period FROM events""")
def period_for_date(spark, sf):
    starts = spark.createDataFrame([(1, 1, "2024-01-08"), (1, 2, "2024-01-15"), (1, 3, "2024-01-22"), (1, 4, "2024-01-29")], "k int, period int, s string")
    ev = b.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("d"), F.lit(1).alias("k"))
    return gr.period_for_instant(ev, starts.withColumn("s", F.to_date("s")), ["k"], "d", "s", "period")
