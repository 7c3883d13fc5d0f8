"""Season history."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.operators import history as hs
from rivalgrid.operators.asof import era_of
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS
from rivalgrid.session import cut_lineage

ERAS = [("early", None, 1997), ("middle", 1998, 1999), ("late", 2000, None)]
ERA_SQL = "CASE WHEN season <= 1997 THEN 'early' WHEN season BETWEEN 1998 AND 1999 THEN 'middle' ELSE 'late' END"
VIEWS.update({
    "v_era_hist": f"SELECT *, {ERA_SQL} AS era FROM v_hist",
    "v_conf_value": """
        SELECT era, pf, CASE WHEN n > 1 THEN (below + 0.5 * (equal - 1)) / (n - 1) ELSE 0.5 END AS conf, below, equal, n FROM (
          SELECT era, pf, count(*) AS equal, sum(count(*)) OVER (PARTITION BY era ORDER BY pf) - count(*) AS below, sum(count(*)) OVER (PARTITION BY era) AS n
          FROM v_era_hist GROUP BY era, pf)""",
    "v_conf_hist": """
        SELECT h.*, a.conf AS conf_pf, o.conf AS conf_pa FROM v_era_hist h JOIN v_conf_value a ON a.era = h.era AND a.pf = h.pf
        JOIN v_conf_value o ON o.era = h.era AND o.pf = h.pa""",
    "v_power": """
        SELECT *, rank() OVER (PARTITION BY season, week ORDER BY pf DESC) AS pf_rank, rank() OVER (PARTITION BY season, week ORDER BY pa) AS pa_rank,
          (rank() OVER (PARTITION BY season, week ORDER BY pf) - 1 + 0.5 * (count(*) OVER (PARTITION BY season, week, pf) - 1)) / (count(*) OVER (PARTITION BY season, week) - 1) AS all_play
        FROM v_hist""",
    "v_swap": """
        SELECT season, manager, schedule, count(*) FILTER (WHERE d > 0) AS w, count(*) FILTER (WHERE d < 0) AS l, count(*) FILTER (WHERE d = 0) AS t, count(*) FILTER (WHERE met) AS subbed
        FROM (SELECT a.season, a.manager, x.manager AS schedule, x.manager <> a.manager AND x.opp = a.manager AS met,
                a.pf - CASE WHEN x.manager <> a.manager AND x.opp = a.manager
                       THEN (SELECT avg(r.pf) FROM v_hist r WHERE r.season = a.season AND r.week = a.week AND r.manager <> a.manager) ELSE x.pa END AS d
              FROM v_hist a JOIN v_hist x ON x.season = a.season AND x.week = a.week) GROUP BY season, manager, schedule""",
    "v_swap_sum": """
        SELECT season, manager, max(w + 0.5 * t) FILTER (WHERE schedule = manager) AS actual, max(w + 0.5 * t) AS best, min(w + 0.5 * t) AS worst, avg(w + 0.5 * t) AS average
        FROM v_swap GROUP BY season, manager""",
})


def era_history(spark, sf):
    return b.history(spark, sf).withColumn("era", era_of(F.col("season"), ERAS))


def confident(spark, sf):
    games = cut_lineage(era_history(spark, sf))
    table = hs.value_positions(games, ["era"], "pf").select("era", "pf", hs.in_sample_confidence().alias("conf"))
    pf = table.withColumnRenamed("conf", "conf_pf")
    pa = table.select("era", F.col("pf").alias("pa"), F.col("conf").alias("conf_pa"))
    return games.join(pf, ["era", "pf"]).join(pa, ["era", "pa"], "left")


@query("w08_confidence", "season:i week:i manager:i era:s conf_pf:d conf_pa:d", "SELECT * FROM v_conf_hist")
def confidence(spark, sf):
    """Empirical confidence within the season's era."""
    return confident(spark, sf)


@query("w08_confidence_out_of_sample", "season:i week:i manager:i confidence:d",
       """SELECT season, week, manager, (SELECT (count(*) FILTER (WHERE s.pf < h.pf) + 0.5 * count(*) FILTER (WHERE s.pf = h.pf)) / count(*) FROM v_hist s WHERE s.season < 2000) AS confidence
          FROM v_hist h WHERE season >= 2000""")
def confidence_out(spark, sf):
    """Seasons from 2000 measured against the seasons before them."""
    games = b.history(spark, sf).withColumn("pool", F.lit("old"))
    key = F.struct("season", "week", "manager")
    probes = games.where(F.col("season") >= 2000).withColumn("k", key)
    out = hs.confidence_of_probes(games.where(F.col("season") < 2000), probes, ["pool"], "pf", "k")
    return out.select("k.*", "confidence")


CURVE = """
    SELECT era, pf, conf FROM v_conf_value v WHERE pf < (SELECT max(pf) FROM v_conf_value m WHERE m.era = v.era)
      AND ceil(below / greatest(1, floor(n / 40))) * greatest(1, floor(n / 40)) < below + equal
    UNION ALL SELECT era, max(pf), 1.0 FROM v_conf_value GROUP BY era"""


@query("w08_confidence_curve", "era:s pf:d confidence:d", f"SELECT era, pf, conf AS confidence FROM ({CURVE})")
def curve(spark, sf):
    return hs.confidence_curve(era_history(spark, sf), ["era"], "pf", 40)


@query("w28_read_off_curve", "season:i week:i manager:i read:d",
       f"""WITH c AS ({CURVE}), seg AS (SELECT era, pf AS x1, conf AS y1, lag(pf) OVER (PARTITION BY era ORDER BY pf) AS x0, lag(conf) OVER (PARTITION BY era ORDER BY pf) AS y0 FROM c)
           SELECT season, week, manager, CASE WHEN x1 IS NULL THEN 1.0 WHEN x0 IS NULL THEN y1 * CASE WHEN x1 <> 0 THEN pf / x1 ELSE 1 END ELSE y0 + (y1 - y0) * (pf - x0) / (x1 - x0) END AS read
           FROM v_era_hist h LEFT JOIN seg ON seg.era = h.era AND h.pf <= x1 AND (x0 IS NULL OR h.pf > x0)""")
def read_curve(spark, sf):
    games = cut_lineage(era_history(spark, sf))
    return hs.read_off_curve(games, hs.confidence_curve(games, ["era"], "pf", 40), ["era"], "pf", "read")


@query("w09_power_weeks", "season:i week:i manager:i pf_rank:i pa_rank:i all_play:d", "SELECT * FROM v_power")
def power_weeks(spark, sf):
    return hs.power_weeks(b.history(spark, sf))


@query("a53_power_table", "season:i manager:i avg_pf_rank:d avg_pa_rank:d exp_wins:d",
       "SELECT season, manager, avg(pf_rank) AS avg_pf_rank, avg(pa_rank) AS avg_pa_rank, sum(all_play) AS exp_wins FROM v_power GROUP BY season, manager")
def power_table(spark, sf):
    return hs.power_table(b.history(spark, sf))


@query("j17_schedule_swap", "season:i manager:i schedule:i w:i l:i t:i subbed:i", "SELECT * FROM v_swap")
def swap(spark, sf):
    return hs.schedule_swap(b.history(spark, sf))


@query("w10_schedule_luck", "season:i manager:i actual:d best:d worst:d average:d luck:d", "SELECT *, actual - average AS luck FROM v_swap_sum")
def luck(spark, sf):
    return hs.swap_summary(hs.schedule_swap(b.history(spark, sf)))


@query("a75_all_season_rollup", "manager:i actual:d average:d luck:d seasons:i",
       "SELECT manager, sum(actual) AS actual, sum(average) AS average, sum(actual - average) AS luck, count(*) AS seasons FROM v_swap_sum GROUP BY manager")
def rollup(spark, sf):
    s = hs.swap_summary(hs.schedule_swap(b.history(spark, sf)))
    return s.groupBy("manager").agg(F.sum("actual").alias("actual"), F.sum("average").alias("average"), F.sum("luck").alias("luck"), F.count(F.lit(1)).alias("seasons"))


BANDS = ", ".join(f"avg(CAST({c} >= {lo} AND ({c} < {hi} OR ({hi} = 1.0 AND {c} = 1.0)) AS INT)) AS {t}_band{i}"
                  for c, t in (("conf_pf", "pf"), ("conf_pa", "pa")) for i, (lo, hi) in enumerate(((0, .25), (.25, .5), (.5, .75), (.75, 1.0)), 1))
ALL_TIME = f"""
    SELECT manager, bool_or(season = 2001) AS active, count(*) AS games, count(*) FILTER (WHERE result = 'W') AS w, count(*) FILTER (WHERE result = 'L') AS l,
      count(*) FILTER (WHERE result = 'T') AS t, avg(conf_pf) AS avg_conf_pf, avg(conf_pa) AS avg_conf_pa, avg(pf) AS pf_avg, stddev_pop(pf) AS pf_sd, min(pf) AS pf_min, max(pf) AS pf_max,
      avg(pa) AS pa_avg, min(pa) AS pa_min, max(pa) AS pa_max, stddev_pop(pf) / avg(pf) AS pf_cov, median(pf) AS pf_median, median(pa) AS pa_median,
      min(pf) FILTER (WHERE result = 'W') AS lowest_win, max(pf) FILTER (WHERE result = 'L') AS highest_loss,
      (count(*) FILTER (WHERE result = 'W') + 0.5 * count(*) FILTER (WHERE result = 'T')) / count(*) AS win_pct, {BANDS}
    FROM v_conf_hist GROUP BY manager"""
BAND_SPEC = " ".join(f"{t}_band{i}:d" for t in ("pf", "pa") for i in range(1, 5))


@query("a50_all_time",
       "manager:i active:b games:i w:i l:i t:i avg_conf_pf:d avg_conf_pa:d pf_avg:d pf_sd:d pf_min:d pf_max:d pa_avg:d pa_min:d pa_max:d pf_cov:d pf_median:d pa_median:d lowest_win:d highest_loss:d win_pct:d " + BAND_SPEC,
       ALL_TIME)
def all_time(spark, sf):
    return hs.all_time(cut_lineage(confident(spark, sf)))


@query("u07_pools_with_and_without_playoffs", "pool:s manager:i games:i pf:d",
       """SELECT 'all' AS pool, manager, count(*) AS games, sum(pf) AS pf FROM v_hist GROUP BY manager
          UNION ALL SELECT 'regular', manager, count(*), sum(pf) FROM v_hist WHERE NOT playoff GROUP BY manager""")
def pools(spark, sf):
    return hs.with_and_without_playoffs(b.history(spark, sf)).groupBy("pool", "manager").agg(
        F.count(F.lit(1)).alias("games"), F.sum("pf").alias("pf"))


@query("a51_season_scoring", "season:i era:s teams:i mean:d median:d sd:d low:d high:d",
       f"SELECT season, {ERA_SQL} AS era, count(DISTINCT manager) AS teams, avg(pf) AS mean, median(pf) AS median, stddev_pop(pf) AS sd, min(pf) AS low, max(pf) AS high FROM v_hist WHERE NOT playoff GROUP BY season")
def season_scoring(spark, sf):
    out = hs.season_scoring(cut_lineage(b.history(spark, sf).where(~F.col("playoff"))))
    return out.withColumn("era", era_of(F.col("season"), ERAS))


@query("a51_score_histogram", "era:s bin:i n:i",
       "SELECT era, floor(pf / 10) AS bin, count(*) AS n FROM v_era_hist WHERE NOT playoff GROUP BY era, floor(pf / 10)")
def histogram(spark, sf):
    return hs.histogram(era_history(spark, sf).where(~F.col("playoff")), ["era"], "pf", 10)


@query("p36_stored_result_wins", "season:i week:i manager:i res:s",
       """SELECT season, week, manager, CASE WHEN stored IN ('W', 'L', 'T') THEN stored WHEN pf > pa THEN 'W' WHEN pf < pa THEN 'L' ELSE 'T' END AS res
          FROM (SELECT *, CASE WHEN (manager + week) % 5 = 0 THEN 'W' WHEN week % 2 = 0 THEN '?' END AS stored FROM v_hist)""")
def stored_result(spark, sf):
    rows = b.history(spark, sf).withColumn("stored", F.when((F.col("manager") + F.col("week")) % 5 == 0, "W").when(F.col("week") % 2 == 0, "?"))
    return rows.withColumn("res", hs.result_of("stored"))


@query("w11_detect_eras", "source:i season:i era:i",
       """SELECT source, season, sum(CAST(change AS INT)) OVER (PARTITION BY source ORDER BY season) AS era FROM (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY season) = 1 OR (sig IS NOT NULL AND sig IS DISTINCT FROM prev) AS change FROM (
              SELECT *, last_value(sig IGNORE NULLS) OVER (PARTITION BY source ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
                SELECT DISTINCT source, season, CASE WHEN (season + source) % 4 <> 0 THEN 'S' || (season // 3) END AS sig FROM v_raw_bid)))""")
def eras(spark, sf):
    seasons = b.raw_bids(spark, sf).select("source", "season").distinct()
    sig = F.when((F.col("season") + F.col("source")) % 4 != 0, F.concat(F.lit("S"), F.floor(F.col("season") / 3).cast("string")))
    return hs.detect_eras(seasons.withColumn("signature", sig), ["source"])


@query("a69_name_spans", "name:s first_season:i last_season:i n:i",
       """SELECT CASE n_name WHEN 'NATION_1' THEN 'NATION_2' ELSE n_name END AS name, min(season) AS first_season, max(season) AS last_season, count(*) AS n
          FROM v_hist JOIN nation ON manager = n_nationkey GROUP BY 1""")
def name_spans(spark, sf):
    """Spans per name with aliases applied."""
    names = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("manager"), F.col("n_name").alias("name"))
    return hs.name_spans(b.history(spark, sf).join(names, "manager"), "name", {"NATION_1": "NATION_2"})
