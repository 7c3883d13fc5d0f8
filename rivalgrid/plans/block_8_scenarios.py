"""Scenario tables and standings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.functions.numeric import bracket_byes
from rivalgrid.operators import scenarios as sc
from rivalgrid.operators.ranking import top_n_any_size
from rivalgrid.operators.swaps import odds_score
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS
from rivalgrid.session import cut_lineage

PLACES, BYES, ORDERS_PER_SCENARIO = 3, 1, 30
PICKS = [(1, "home"), (4, "away")]
GAP = "CASE WHEN {s} >= 0.01 THEN CASE WHEN with_home > with_away THEN 'home' ELSE 'away' END END"


def tier_sql(baseline: str) -> str:
    return f"""*, coalesce(abs(with_home - with_away), 0) AS swing, CASE WHEN abs(with_home - with_away) >= 0.01 THEN CASE WHEN with_home > with_away THEN 'home' ELSE 'away' END END AS best,
      CASE WHEN abs(with_home - with_away) >= 0.01 THEN least(with_home, with_away) END AS worst_odds,
      CASE WHEN coalesce(abs(with_home - with_away), 0) < 0.01 OR n_home < 30 OR n_away < 30 THEN 'flat'
           WHEN abs(with_home - with_away) >= 0.15 AND least(with_home, with_away) <= greatest(0.1, 0.5 * coalesce({baseline}, 0)) THEN 'must'
           WHEN abs(with_home - with_away) >= 0.15 THEN 'big' ELSE 'minor' END AS tier"""


SPLIT = "avg(hit) FILTER (WHERE home_won) AS with_home, avg(hit) FILTER (WHERE NOT home_won) AS with_away, count(*) FILTER (WHERE home_won) AS n_home, count(*) FILTER (WHERE NOT home_won) AS n_away"
VIEWS.update({
    "v_sgame": """SELECT l_orderkey // 30 AS scenario, l_linenumber AS game, l_linenumber AS home, l_linenumber % 7 + 1 AS away, avg(l_quantity) > 25 AS home_won
        FROM lineitem GROUP BY l_orderkey // 30, l_linenumber""",
    "v_sres": "SELECT scenario, game, home AS grp, home_won AS won FROM v_sgame UNION ALL SELECT scenario, game, away, NOT home_won FROM v_sgame",
    "v_sgroup": """SELECT w.scenario, w.grp, w.wins, w.grp % 2 AS division, coalesce(p.pf, 0) AS pf FROM (SELECT scenario, grp, sum(CAST(won AS DOUBLE)) AS wins FROM v_sres GROUP BY scenario, grp) w
        LEFT JOIN (SELECT l_orderkey // 30 AS scenario, l_linenumber AS grp, sum(floor(l_extendedprice / 1000)) AS pf FROM lineitem GROUP BY 1, 2) p USING (scenario, grp)""",
    "v_seed": """SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY winner DESC, wins DESC, pf DESC, grp) AS seed FROM (
        SELECT *, row_number() OVER (PARTITION BY scenario, division ORDER BY wins DESC, pf DESC, grp) = 1 AS winner FROM v_sgroup)""",
    "v_hit": "SELECT scenario, grp, CAST(seed <= 3 AS DOUBLE) AS hit FROM v_seed",
    "v_missed": """SELECT scenario, count(*) FILTER (WHERE (game = 1 AND NOT home_won) OR (game = 4 AND home_won)) AS n_missed,
        max(game) FILTER (WHERE (game = 1 AND NOT home_won) OR (game = 4 AND home_won)) AS missed_game FROM v_sgame GROUP BY scenario""",
    "v_leverage": f"""SELECT {tier_sql('baseline')}, home = grp OR away = grp AS own, game IN (1, 4) AS picked FROM (
        SELECT s.*, baseline FROM (SELECT h.grp, g.game, g.home, g.away, {SPLIT} FROM v_hit h JOIN v_missed m USING (scenario) JOIN v_sgame g USING (scenario)
          WHERE n_missed = 0 OR (n_missed = 1 AND missed_game = g.game) GROUP BY h.grp, g.game, g.home, g.away) s
        JOIN (SELECT grp, avg(hit) AS baseline FROM v_hit JOIN v_missed USING (scenario) WHERE n_missed = 0 GROUP BY grp) b USING (grp))""",
    "v_race": """SELECT *, bar - pf AS gap, CAST(seed = 3 AS DOUBLE) AS via_last FROM (
        SELECT o.*, (SELECT max(x.pf) FROM v_seed x WHERE x.scenario = o.scenario AND x.seed >= 3 AND x.grp <> o.grp) AS bar,
          (SELECT arg_min(x.grp, (-x.pf, x.grp)) FROM v_seed x WHERE x.scenario = o.scenario AND x.seed >= 3 AND x.grp <> o.grp) AS rival
        FROM v_seed o WHERE seed >= 3)""",
})


def scenario_games(spark, sf):
    items = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = F.floor(F.col("l_orderkey") / ORDERS_PER_SCENARIO).cast("long")
    g = items.groupBy(key.alias("scenario"), F.col("l_linenumber").alias("game")).agg((F.avg("l_quantity") > 25).alias("home_won"))
    return g.select("scenario", "game", F.col("game").alias("home"), (F.col("game") % 7 + 1).alias("away"), "home_won")


def scenario_groups(spark, sf):
    items = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    key = F.floor(F.col("l_orderkey") / ORDERS_PER_SCENARIO).cast("long")
    pf = items.groupBy(key.alias("scenario"), F.col("l_linenumber").alias("grp")).agg(F.sum(F.floor(F.col("l_extendedprice") / 1000)).cast("double").alias("pf"))
    wins = sc.final_wins(scenario_games(spark, sf))
    return wins.join(pf, ["scenario", "grp"], "left").withColumns({
        "pf": F.coalesce("pf", F.lit(0.0)), "division": F.col("grp") % 2})


def seeded(spark, sf):
    return cut_lineage(sc.seeds(scenario_groups(spark, sf)))


@query("x01_scenario_seeds", "scenario:i grp:i wins:d pf:d division_winner:b seed:i", "SELECT *, winner AS division_winner FROM v_seed")
def seeds(spark, sf):
    return sc.seeds(scenario_groups(spark, sf))


@query("x02_odds", "grp:i mean_wins:d playoff:d bye:d division:d seed_1:d seed_2:d seed_3:d",
       """SELECT grp, avg(wins) AS mean_wins, avg(CAST(seed <= 3 AS INT)) AS playoff, avg(CAST(seed <= 1 AS INT)) AS bye, avg(CAST(winner AS INT)) AS division,
            avg(CAST(seed = 1 AS INT)) AS seed_1, avg(CAST(seed = 2 AS INT)) AS seed_2, avg(CAST(seed = 3 AS INT)) AS seed_3 FROM v_seed GROUP BY grp""")
def odds(spark, sf):
    return sc.odds(sc.seeds(scenario_groups(spark, sf)), PLACES, BYES)


@query("x03_final_wins", "scenario:i grp:i wins:d",
       "SELECT scenario, grp, sum(CAST(won AS DOUBLE)) + any_value(grp % 3) AS wins FROM v_sres GROUP BY scenario, grp")
def final_wins(spark, sf):
    games = scenario_games(spark, sf)
    base = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("grp"), (F.col("n_nationkey") % 3).cast("double").alias("base_wins"))
    return sc.final_wins(games, base)


@query("x04_consistent_scenarios", "scenario:i", "SELECT scenario FROM v_missed WHERE n_missed = 0")
def consistent(spark, sf):
    return sc.consistent(scenario_games(spark, sf), PICKS)


@query("x05_home_share", "game:i home_share:d", "SELECT game, avg(CAST(home_won AS INT)) AS home_share FROM v_sgame GROUP BY game")
def home_share(spark, sf):
    return sc.home_share(scenario_games(spark, sf))


@query("x06_game_splits", "grp:i game:i with_home:d with_away:d n_home:i n_away:i",
       f"SELECT grp, game, {SPLIT} FROM v_hit JOIN v_sgame USING (scenario) GROUP BY grp, game")
def splits(spark, sf):
    return sc.game_splits(seeded(spark, sf), scenario_games(spark, sf), PLACES)


@query("x07_leverage", "grp:i game:i with_home:d with_away:d baseline:d swing:d best:s tier:s own:b picked:b", "SELECT * FROM v_leverage")
def leverage(spark, sf):
    return sc.leverage(seeded(spark, sf), cut_lineage(scenario_games(spark, sf)), PICKS, PLACES)


@query("t09_must_haves", "grp:i pos:i game:i best:s worst_odds:d",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(worst_odds, 9), game) AS pos FROM v_leverage WHERE tier = 'must' AND NOT picked) WHERE pos <= 4""")
def must_haves(spark, sf):
    return sc.must_haves(leverage(spark, sf), ["grp"])


@query("x08_slip_branches", "grp:i lost_game:i before:d after:d n:i game:n best:s worst_odds:d",
       f"""WITH held AS (SELECT scenario FROM v_sgame WHERE game = 1 AND home_won),
             branch AS (SELECT r.scenario, r.grp, r.game AS lost_game, h.hit FROM v_sres r JOIN held USING (scenario) JOIN v_hit h ON h.scenario = r.scenario AND h.grp = r.grp
                        WHERE NOT won AND r.game <> 1),
             facts AS (SELECT f.*, before FROM (SELECT grp, lost_game, avg(hit) AS after, count(*) AS n FROM branch GROUP BY grp, lost_game) f
                       JOIN (SELECT grp, avg(hit) AS before FROM v_hit JOIN held USING (scenario) GROUP BY grp) USING (grp) WHERE n >= 100 AND before - after >= 0.05),
             rows_ AS (SELECT {tier_sql('after')}, game = lost_game OR game = 1 AS picked FROM (
                        SELECT s.*, f.after FROM (SELECT b.grp, b.lost_game, g.game, {SPLIT} FROM branch b JOIN v_sgame g USING (scenario) GROUP BY b.grp, b.lost_game, g.game) s JOIN facts f USING (grp, lost_game))),
             needs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, lost_game ORDER BY round(worst_odds, 9), game) AS pos FROM rows_ WHERE tier = 'must' AND NOT picked) WHERE pos <= 4)
           SELECT f.grp, f.lost_game, before, f.after, n, game, best, worst_odds FROM facts f LEFT JOIN (SELECT grp, lost_game, game, best, worst_odds FROM needs) USING (grp, lost_game)""")
def slips(spark, sf):
    return sc.slip_branches(seeded(spark, sf), cut_lineage(scenario_games(spark, sf)), PICKS[:1], PLACES)


@query("x09_wins_ladder", "grp:i wins:d n:i share:d playoff:d bye:d",
       """SELECT grp, wins, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY grp) AS share, avg(CAST(seed <= 3 AS INT)) AS playoff, avg(CAST(seed <= 1 AS INT)) AS bye FROM v_seed GROUP BY grp, wins""")
def ladder(spark, sf):
    return sc.wins_ladder(sc.seeds(scenario_groups(spark, sf)), PLACES, BYES)


@query("x10_last_place_race", "grp:i n:i safe:d outside:n made_when_outside:d bar_p25:d bar_p50:d bar_p75:d gap_p25:d gap_p50:d gap_p75:d",
       """SELECT t.*, outside, made_when_outside, bar_p25, bar_p50, bar_p75, gap_p25, gap_p50, gap_p75 FROM (SELECT grp, count(*) AS n, avg(CAST(seed < 3 AS INT)) AS safe FROM v_seed GROUP BY grp) t LEFT JOIN (
            SELECT grp, count(*) AS outside, avg(via_last) AS made_when_outside, quantile_cont(bar, 0.25) AS bar_p25, quantile_cont(bar, 0.5) AS bar_p50, quantile_cont(bar, 0.75) AS bar_p75,
              quantile_cont(gap, 0.25) AS gap_p25, quantile_cont(gap, 0.5) AS gap_p50, quantile_cont(gap, 0.75) AS gap_p75 FROM v_race GROUP BY grp) USING (grp)""")
def race(spark, sf):
    return sc.race(seeded(spark, sf), PLACES)


@query("x10_race_rivals", "grp:i rival:i n:i share:d gap_p50:d",
       """SELECT grp, rival, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY grp) AS share, quantile_cont(gap, 0.5) AS gap_p50 FROM v_race WHERE rival IS NOT NULL GROUP BY grp, rival""")
def rivals(spark, sf):
    return sc.rivals(seeded(spark, sf), PLACES)


@query("m18_bracket_byes", "source:i n:i byes:i",
       """SELECT source, n, CAST(pow(2, ceil(log2(n))) AS BIGINT) - n AS byes FROM (SELECT c_nationkey AS source, count(*) AS n FROM customer GROUP BY c_nationkey)""")
def byes(spark, sf):
    n = b.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("byes", bracket_byes("n"))


ERF_SQL = "sign({x}) * (1 - (((((1.061405429 * t + -1.453152027) * t) + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-({x}) * ({x})))"
VIEWS.update({
    "v_form": "SELECT season, grp, avg(pf) AS mean, stddev_pop(pf) AS sd FROM v_score GROUP BY season, grp",
    "v_match_odds": f"""
        SELECT *, CASE WHEN spread > 0 THEN 0.5 * (1 + {ERF_SQL.format(x='x')}) WHEN m1 > m2 THEN 1.0 WHEN m1 < m2 THEN 0.0 ELSE 0.5 END AS p_home FROM (
          SELECT *, 1 / (1 + 0.3275911 * abs(x)) AS t FROM (
            SELECT f.season, f.week, f.grp, f.opp, f.final, a.mean AS m1, o.mean AS m2, sqrt(a.sd * a.sd + o.sd * o.sd) AS spread,
              CASE WHEN sqrt(a.sd * a.sd + o.sd * o.sd) > 0 THEN (a.mean - o.mean) / (sqrt(a.sd * a.sd + o.sd * o.sd) * sqrt(2.0)) END AS x
            FROM v_final f JOIN v_form a ON a.season = f.season AND a.grp = f.grp JOIN v_form o ON o.season = f.season AND o.grp = f.opp WHERE f.home))""",
})


def match_odds_rows(spark, sf):
    form = b.scores(spark, sf).groupBy("season", "grp").agg(F.avg("pf").alias("mean"), F.stddev_pop("pf").alias("sd"))
    return sc.match_odds(b.games(spark, sf).where("home"), form)


@query("x11_match_odds", "season:i week:i grp:i opp:i final:b home_mean:d away_mean:d p_home:d",
       "SELECT season, week, grp, opp, final, m1 AS home_mean, m2 AS away_mean, p_home FROM v_match_odds")
def match_odds(spark, sf):
    """Win probability and final flag of every match."""
    return match_odds_rows(spark, sf)


@query("a58_rest_of_season", "season:i grp:i exp_wins:d exp_losses:d exp_points:d",
       """SELECT season, g AS grp, sum(p) AS exp_wins, sum(1 - p) AS exp_losses, sum(m) AS exp_points FROM (
            SELECT season, grp AS g, p_home AS p, m1 AS m FROM v_match_odds WHERE NOT final UNION ALL SELECT season, opp, 1 - p_home, m2 FROM v_match_odds WHERE NOT final) GROUP BY season, g""")
def rest(spark, sf):
    return sc.rest_of_season(match_odds_rows(spark, sf).where(~F.col("final")))


VIEWS["v_h2h"] = """SELECT season, manager % 3 AS division, manager, avg(CASE result WHEN 'W' THEN 1.0 WHEN 'T' THEN 0.5 ELSE 0 END) AS h2h, count(*) AS h2h_games
    FROM v_hist WHERE manager % 3 = opp % 3 GROUP BY season, manager"""


def with_division(spark, sf):
    return b.history(spark, sf).withColumns({"division": F.col("manager") % 3, "opp_division": F.col("opp") % 3})


@query("j22_head_to_head", "season:i division:i manager:i h2h:d h2h_games:i", "SELECT * FROM v_h2h")
def h2h(spark, sf):
    return sc.head_to_head(with_division(spark, sf), "division")


def standing_rows(games, pool):
    table = games.groupBy("season", "manager", "division").agg(
        F.avg(F.when(F.col("result") == "W", 1.0).when(F.col("result") == "T", 0.5).otherwise(0.0)).alias("win_pct"), F.sum("pf").alias("pf"))
    return table.join(pool.select("season", "manager", "h2h"), ["season", "manager"], "left")


STANDING = """SELECT *, row_number() OVER (PARTITION BY season ORDER BY winner DESC, round(win_pct, 9) DESC NULLS LAST, round(h2h, 9) DESC NULLS LAST, round(pf, 9) DESC NULLS LAST, manager) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY season, division ORDER BY round(win_pct, 9) DESC NULLS LAST, round(h2h, 9) DESC NULLS LAST, round(pf, 9) DESC NULLS LAST, manager) = 1 AS winner FROM (
      SELECT g.season, g.manager, g.manager % 3 AS division, avg(CASE result WHEN 'W' THEN 1.0 WHEN 'T' THEN 0.5 ELSE 0 END) AS win_pct, sum(pf) AS pf, any_value(h.h2h) AS h2h
      FROM {games} g LEFT JOIN v_h2h h ON h.season = g.season AND h.manager = g.manager GROUP BY g.season, g.manager))"""
STANDING_SPEC = "season:i manager:i win_pct:d h2h:d pf:d division_winner:b rank:i"


@query("w22_standings", STANDING_SPEC, f"SELECT *, winner AS division_winner FROM ({STANDING.format(games='v_hist')})")
def standings(spark, sf):
    games = with_division(spark, sf)
    return sc.standings(standing_rows(games, sc.head_to_head(games, "division")), ["season"], "division", ["win_pct", "h2h", "pf"])


@query("w23_week_out_standings", STANDING_SPEC,
       f"""WITH g AS (SELECT season, manager, pf, result FROM v_hist UNION ALL
             SELECT m.season, m.grp, m1, CASE WHEN p_home > 0.5 THEN 'W' WHEN p_home < 0.5 THEN 'L' ELSE 'T' END FROM v_match_odds m WHERE NOT final
             UNION ALL SELECT m.season, m.opp, m2, CASE WHEN p_home < 0.5 THEN 'W' WHEN p_home > 0.5 THEN 'L' ELSE 'T' END FROM v_match_odds m WHERE NOT final)
           SELECT *, winner AS division_winner FROM ({STANDING.format(games='g')})""")
def week_out(spark, sf):
    """Standings with the projected results of the unplayed matches added."""
    open_ = match_odds_rows(spark, sf).where(~F.col("final"))
    p = F.col("p_home")
    projected = open_.withColumn("_s", F.explode(F.array(
        F.struct(F.col("grp").alias("manager"), F.col("home_mean").alias("pf"), F.when(p > 0.5, "W").when(p < 0.5, "L").otherwise("T").alias("result")),
        F.struct(F.col("opp").alias("manager"), F.col("away_mean").alias("pf"), F.when(p < 0.5, "W").when(p > 0.5, "L").otherwise("T").alias("result"))))).select("season", "_s.*")
    games = with_division(spark, sf)
    every = games.select("season", "manager", "pf", "result").unionByName(projected).withColumn("division", F.col("manager") % 3)
    return sc.standings(standing_rows(every, sc.head_to_head(games, "division")), ["season"], "division", ["win_pct", "h2h", "pf"])


@query("m24_odds_change", "grp_a:i grp_b:i delta_a:d delta_b:d score:d mutual:b rank:d rival:i rival_delta:d",
       """WITH o AS (SELECT a.grp, a.playoff AS before, c.playoff AS after FROM (SELECT grp, avg(CAST(seed <= 3 AS INT)) AS playoff FROM v_seed GROUP BY grp) a
            JOIN (SELECT grp, avg(hit) AS playoff FROM v_hit JOIN v_missed USING (scenario) WHERE n_missed = 0 GROUP BY grp) c USING (grp)),
          p AS (SELECT a.grp AS grp_a, b.grp AS grp_b, a.before AS ba, a.after AS aa, b.before AS bb, b.after AS ab, a.after - a.before AS delta_a, b.after - b.before AS delta_b, a.grp - 3.0 AS ga, 4.0 - b.grp AS gb
                FROM o a JOIN o b ON a.grp < b.grp),
          q AS (SELECT *, (ba < 0.01 AND aa < 0.01) OR (ba > 0.99 AND aa > 0.99) AS sa, (bb < 0.01 AND ab < 0.01) OR (bb > 0.99 AND ab > 0.99) AS sb FROM p),
          r AS (SELECT *, CASE WHEN sa AND sb THEN NULL WHEN sa THEN delta_b WHEN sb THEN delta_a ELSE least(delta_a, delta_b) END AS score,
                  CASE WHEN sa AND sb THEN NULL WHEN sa THEN delta_b WHEN sb THEN delta_a ELSE greatest(delta_a, delta_b) END AS best, (NOT sa OR ga >= 0) AND (NOT sb OR gb >= 0) AS ok FROM q)
          SELECT r.grp_a, r.grp_b, delta_a, delta_b, score, coalesce(score >= -0.005 AND best >= 0.005 AND ok, FALSE) AS mutual,
            CASE WHEN coalesce(score >= -0.005 AND best >= 0.005 AND ok, FALSE) THEN 10 ELSE 0 END + score + 0.01 * (delta_a + delta_b) - CASE WHEN ok THEN 0 ELSE 0.5 END AS rank,
            (SELECT arg_min(o.grp, (round(o.after - o.before, 9), o.grp)) FROM o WHERE o.grp NOT IN (r.grp_a, r.grp_b)) AS rival,
            (SELECT min(o.after - o.before) FROM o WHERE o.grp NOT IN (r.grp_a, r.grp_b)) AS rival_delta FROM r""")
def odds_change(spark, sf):
    """Trades scored on before/after odds of both sides, with the third group hurt most.

    The table has one row per group of a league; pairs of groups are the answer.
    """
    s = seeded(spark, sf)
    held = sc.consistent(scenario_games(spark, sf), PICKS)
    place = F.avg((F.col("seed") <= PLACES).cast("double"))
    before = s.groupBy("grp").agg(place.alias("before"))
    after = s.join(held, "scenario", "left_semi").groupBy("grp").agg(place.alias("after"))
    table = cut_lineage(before.join(after, "grp").withColumn("t", F.lit(0)))
    # the three largest losses of the field are enough to find one outside any pair
    losses = table.withColumn("d", F.round(F.col("after") - F.col("before"), 9))
    few = top_n_any_size(losses, ["t"], [F.col("d").asc(), F.col("grp").asc()], "grp", 3)
    worst = few.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("d", "grp", (F.col("after") - F.col("before")).alias("delta")))).alias("_w"))
    def side(x):
        return table.select("t", F.col("grp").alias(f"grp_{x}"), F.col("before").alias(f"before_{x}"), F.col("after").alias(f"after_{x}"))
    pairs = side("a").join(side("b"), "t").where(F.col("grp_a") < F.col("grp_b")).withColumns({
        "gain_a": F.col("grp_a") - 3.0, "gain_b": F.lit(4.0) - F.col("grp_b")})
    rows = odds_score(pairs).join(worst, "t")
    third = F.filter("_w", lambda w: (w["grp"] != F.col("grp_a")) & (w["grp"] != F.col("grp_b")))[0]
    return rows.withColumns({"rival": third["grp"], "rival_delta": third["delta"]})
