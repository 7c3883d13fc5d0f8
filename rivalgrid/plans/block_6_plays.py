"""Play-level rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.functions.expected import expected_pass_yards, pass_and_rush_stat_rows
from rivalgrid.functions.scoring import score
from rivalgrid.operators import plays as pl
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS

PLAY_RULES = [("PY", 0.0625), ("PTD", 4.0), ("INTT", -2.0), ("2PC", 2.0), ("RY", 0.125), ("RTD", 6.0), ("2PR", 2.0), ("REC", 0.5),
              ("REY", 0.125), ("RETD", 6.0), ("2PRE", 2.0), ("FUML", -2.0), ("FG0", 3.0), ("FG40", 4.0), ("FG50P", 5.0), ("PAT", 1.0)]
SECONDS = "CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INT)"
VIEWS.update({
    "v_play": f"""
        SELECT CAST(ts AS DATE) AS game_id, event_id AS play_id, CASE WHEN event_id % 7 = 0 THEN 'POST' ELSE 'REG' END AS season_type,
          CASE WHEN event_type IN ('click', 'view') THEN user_id END AS passer_id, CASE WHEN event_type IN ('click', 'view') THEN (user_id * 3 + 1) % 50 END AS receiver_id,
          CASE WHEN event_type IN ('error', 'signup') THEN user_id END AS rusher_id, CASE WHEN event_type = 'purchase' THEN user_id END AS kicker_id,
          floor(value / 4) AS yards, event_id % 3 <> 0 AS complete_pass, event_id % 11 = 0 AS pass_touchdown, event_id % 13 = 0 AND event_id % 3 = 0 AS interception,
          floor(value / 8) AS rushing_yards, event_id % 9 = 0 AS rush_touchdown, event_id % 17 = 0 AS fumble_lost, user_id AS fumbled_id, event_id % 29 = 0 AS two,
          event_id % 2 = 0 AND event_id % 4 = 0 AS goal, event_id % 2 = 1 AND event_id % 3 = 0 AS extra, floor(value / 5) + 18 AS kick_distance, event_id % 100 AS yardline_100,
          1 + hour(ts) // 5 AS qtr, 3600.0 - floor({SECONDS} / 24) AS gsr, CASE WHEN event_id % 5 <> 0 THEN 600.0 - floor(({SECONDS} % 18000) / 30) END AS qsr
        FROM events""",
    "v_elapsed": """
        SELECT *, round(CASE WHEN qtr > 4 THEN 3600 + (qtr - 5) * len + (len - greatest(0, least(len, coalesce(qsr, gsr)))) ELSE 3600 - greatest(0, least(3600, gsr)) END / 60, 2) AS elapsed_min,
          CASE WHEN yardline_100 <= 5 THEN yardline_100 END AS short_yardline
        FROM (SELECT *, CASE WHEN season_type = 'POST' THEN 900.0 ELSE 600.0 END AS len FROM v_play)""",
    "v_role": """
        SELECT game_id, play_id, elapsed_min, short_yardline, passer_id AS entity, 'pass' AS role, pass_touchdown AS is_td, FALSE AS is_catch,
          concat_ws(', ', 'pass', CASE WHEN two THEN 'conversion good' END, CASE WHEN interception THEN 'ball lost' END, CASE WHEN NOT two AND NOT interception THEN CAST(yards AS BIGINT) || ' yards' END,
            'with r' || receiver_id, CASE WHEN pass_touchdown THEN 'touchdown' END) AS label,
          0.0625 * yards + 4.0 * CAST(pass_touchdown AS INT) - 2.0 * CAST(interception AS INT) + 2.0 * CAST(two AS INT) AS pts
        FROM v_elapsed WHERE passer_id IS NOT NULL
        UNION ALL
        SELECT game_id, play_id, elapsed_min, short_yardline, rusher_id, 'rush', rush_touchdown, FALSE,
          concat_ws(', ', 'rush', CASE WHEN two THEN 'conversion good' END, CASE WHEN fumble_lost THEN 'ball lost' END, CASE WHEN NOT two AND NOT fumble_lost THEN CAST(rushing_yards AS BIGINT) || ' yards' END,
            CASE WHEN rush_touchdown THEN 'touchdown' END),
          0.125 * rushing_yards + 6.0 * CAST(rush_touchdown AS INT) - 2.0 * CAST(fumble_lost AS INT) + 2.0 * CAST(two AS INT)
        FROM v_elapsed WHERE rusher_id IS NOT NULL
        UNION ALL
        SELECT game_id, play_id, elapsed_min, short_yardline, receiver_id, 'reception', complete_pass AND pass_touchdown, complete_pass,
          concat_ws(', ', 'reception', CASE WHEN two AND complete_pass THEN 'conversion good' END, CASE WHEN complete_pass AND fumble_lost AND fumbled_id = receiver_id THEN 'ball lost' END,
            CASE WHEN NOT complete_pass THEN 'not caught' WHEN NOT two AND NOT (fumble_lost AND fumbled_id = receiver_id) THEN CAST(yards AS BIGINT) || ' yards' END, 'with p' || passer_id,
            CASE WHEN complete_pass AND pass_touchdown THEN 'touchdown' END),
          CASE WHEN complete_pass THEN 0.5 + 0.125 * yards + 6.0 * CAST(pass_touchdown AS INT) + 2.0 * CAST(two AS INT) - 2.0 * CAST(fumble_lost AND fumbled_id = receiver_id AS INT) ELSE 0 END
        FROM v_elapsed WHERE receiver_id IS NOT NULL AND receiver_id <> passer_id
        UNION ALL
        SELECT game_id, play_id, elapsed_min, short_yardline, kicker_id, 'kick', FALSE, FALSE,
          concat_ws(', ', 'kick', CASE WHEN goal THEN CAST(kick_distance AS BIGINT) || ' yards' ELSE 'extra point' END),
          CASE WHEN goal THEN CASE WHEN kick_distance < 40 THEN 3.0 WHEN kick_distance < 50 THEN 4.0 ELSE 5.0 END ELSE 1.0 END
        FROM v_elapsed WHERE kicker_id IS NOT NULL AND (goal OR extra)""",
    "v_scored": """
        SELECT *, CASE WHEN pts <> 0 THEN 'scoring' WHEN role = 'reception' AND NOT is_catch THEN 'incomplete' WHEN role IN ('rush', 'reception') THEN 'zero' ELSE 'none' END AS kind FROM v_role""",
    "v_centroid": """
        SELECT s.game_id, s.entity, s.pt / s.weight AS centroid_min, s.pt / s.weight / d.duration AS centroid_pct, s.weight FROM (
          SELECT game_id, entity, sum(pts * elapsed_min) AS pt, sum(pts) AS weight FROM v_role WHERE pts > 0 GROUP BY game_id, entity HAVING count(*) >= 2) s
        JOIN (SELECT game_id, max(elapsed_min) AS duration FROM v_elapsed GROUP BY game_id) d USING (game_id)""",
})


def play_rows(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    i, t = F.col("event_id"), F.col("event_type")
    air, ground = t.isin("click", "view"), t.isin("error", "signup")
    secs = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    receiver = F.when(air, (F.col("user_id") * 3 + 1) % 50)
    return ev.select(
        F.to_date("ts").alias("game_id"), i.alias("play_id"), F.when(i % 7 == 0, "POST").otherwise("REG").alias("season_type"),
        F.when(air, F.col("user_id")).alias("passer_id"), receiver.alias("receiver_id"), F.when(ground, F.col("user_id")).alias("rusher_id"),
        F.when(t == "purchase", F.col("user_id")).alias("kicker_id"),
        F.when(air, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("passer_name"), F.concat(F.lit("r"), receiver.cast("string")).alias("receiver_name"),
        F.floor(F.col("value") / 4).alias("passing_yards"), F.floor(F.col("value") / 4).alias("receiving_yards"), (i % 3 != 0).alias("complete_pass"),
        (i % 11 == 0).alias("pass_touchdown"), ((i % 13 == 0) & (i % 3 == 0)).alias("interception"), F.floor(F.col("value") / 8).alias("rushing_yards"),
        (i % 9 == 0).alias("rush_touchdown"), (i % 17 == 0).alias("fumble_lost"), F.col("user_id").alias("fumbled_id"),
        F.when(i % 29 == 0, "success").alias("two_point_conv_result"), (i % 2 == 0).alias("field_goal_attempt"),
        F.when(i % 4 == 0, "made").otherwise("missed").alias("field_goal_result"), (i % 2 == 1).alias("extra_point_attempt"),
        F.when(i % 3 == 0, "good").otherwise("failed").alias("extra_point_result"), (F.floor(F.col("value") / 5) + 18).alias("kick_distance"),
        (i % 100).alias("yardline_100"), (1 + F.floor(F.hour("ts") / 5)).alias("qtr"), (F.lit(3600.0) - F.floor(secs / 24)).alias("game_seconds_remaining"),
        F.when(i % 5 != 0, F.lit(600.0) - F.floor((secs % 18000) / 30)).alias("quarter_seconds_remaining"))


@query("p20_elapsed_minutes", "game_id:s play_id:i elapsed_min:d short_yardline:n",
       "SELECT game_id, play_id, elapsed_min, short_yardline FROM v_elapsed")
def elapsed(spark, sf):
    """P20, P23."""
    return play_rows(spark, sf).select("game_id", "play_id", pl.elapsed_minutes().alias("elapsed_min"), pl.short_field().alias("short_yardline"))


@query("p22_role_rows", "game_id:s play_id:i entity:i role:s label:s is_td:b",
       "SELECT game_id, play_id, entity, role, label, is_td FROM v_role")
def role_rows(spark, sf):
    """Every role of every play, labelled."""
    return pl.role_rows(play_rows(spark, sf))


@query("a25_game_lengths", "game_id:s duration:d", "SELECT game_id, max(elapsed_min) AS duration FROM v_elapsed GROUP BY game_id")
def lengths(spark, sf):
    return pl.game_lengths(play_rows(spark, sf))


@query("a27_scored_plays", "game_id:s play_id:i entity:i role:s kind:s pts:d elapsed_min:d",
       "SELECT game_id, play_id, entity, role, kind, pts, elapsed_min FROM v_scored")
def scored(spark, sf):
    return pl.scored_plays(play_rows(spark, sf), PLAY_RULES)


@query("a23_scoring_time", "game_id:s entity:i centroid_min:d centroid_pct:d weight:d", "SELECT * FROM v_centroid")
def scoring_time(spark, sf):
    rows = play_rows(spark, sf)
    return pl.scoring_time(pl.scored_plays(rows, PLAY_RULES), pl.game_lengths(rows))


@query("a24_scoring_time_rollup", "entity:i centroid_pct:d games:i",
       "SELECT entity, sum(centroid_pct * weight) / sum(weight) AS centroid_pct, count(*) AS games FROM v_centroid GROUP BY entity")
def rollup(spark, sf):
    return pl.centroid_rollup(scoring_time(spark, sf))


VIEWS["v_exp_play"] = """
    SELECT CAST(ts AS DATE) AS game_id, event_id AS play_id, event_type, user_id, (user_id * 3 + 1) % 50 AS receiver_id,
      (event_id % 8) / 8.0 AS comp, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 24 AS DOUBLE) END AS air, 4.5 AS yac, (event_id % 16) / 64.0 AS td, floor(value / 8) / 2.0 AS ry
    FROM events"""


def expected_rows(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    i = F.col("event_id")
    base = ev.select(
        F.to_date("ts").alias("game_id"), i.alias("play_id"), "event_type", "user_id", ((F.col("user_id") * 3 + 1) % 50).alias("receiver_id"),
        ((i % 8) / 8.0).alias("pass_completion_exp"), F.when(i % 10 != 0, (i % 24).cast("double")).alias("air_yards"), F.lit(4.5).alias("yards_after_catch_exp"),
        ((i % 16) / 64.0).alias("pass_touchdown_exp"), (F.floor(F.col("value") / 8) / 2.0).alias("rush_yards_exp"), ((i % 16) / 64.0).alias("rush_touchdown_exp"),
        F.lit(0.0).alias("pass_interception_exp"), F.lit(0.0).alias("two_point_conv_exp"))
    passes = base.where(F.col("event_type").isin("click", "view")).withColumnsRenamed({"user_id": "passer_id"}).withColumns({
        "passer_name": F.concat(F.lit("p"), F.col("passer_id").cast("string")), "receiver_name": F.concat(F.lit("r"), F.col("receiver_id").cast("string"))})
    rushes = base.where(F.col("event_type").isin("error", "signup")).withColumnRenamed("user_id", "rusher_id")
    return passes, rushes


@query("p09_expected_pass_yards", "game_id:s play_id:i yards:d",
       "SELECT game_id, play_id, coalesce(comp * (yac + air), 0) AS yards FROM v_exp_play WHERE event_type IN ('click', 'view')")
def exp_yards(spark, sf):
    return expected_rows(spark, sf)[0].withColumn("yards", expected_pass_yards())


EXPECTED = """
    SELECT game_id, play_id, user_id AS entity, 'pass' AS role, 0.0625 * coalesce(comp * (yac + air), 0) + 4 * td AS pts FROM v_exp_play WHERE event_type IN ('click', 'view')
    UNION ALL SELECT game_id, play_id, receiver_id, 'reception', 0.5 * comp + 0.125 * coalesce(comp * (yac + air), 0) + 6 * td FROM v_exp_play WHERE event_type IN ('click', 'view')
    UNION ALL SELECT game_id, play_id, user_id, 'rush', 0.125 * ry + 6 * td FROM v_exp_play WHERE event_type IN ('error', 'signup')"""


def expected_plays(spark, sf):
    passes, rushes = expected_rows(spark, sf)
    keep = [F.col("game_id"), F.col("play_id")]
    return score(pass_and_rush_stat_rows(passes, rushes, keep), PLAY_RULES)


@query("a28_expected_plays", "game_id:s play_id:i entity:i role:s pts:d", EXPECTED)
def exp_plays(spark, sf):
    """Expected points of every pass, target and rush."""
    return expected_plays(spark, sf)


@query("j24_expected_vs_actual", "game_id:s play_id:i entity:i role:s expected:d actual:d",
       f"SELECT e.game_id, e.play_id, e.entity, e.role, e.pts AS expected, a.pts AS actual FROM ({EXPECTED}) e JOIN v_role a USING (game_id, play_id, entity, role)")
def exp_vs_actual(spark, sf):
    keys = ["game_id", "play_id", "entity", "role"]
    e = expected_plays(spark, sf).select(*keys, F.col("pts").alias("expected"))
    return e.join(pl.scored_plays(play_rows(spark, sf), PLAY_RULES).select(*keys, F.col("pts").alias("actual")), keys)


@query("j14_kick_buckets", "bucket:s n:i",
       """SELECT CASE WHEN kick_distance < 20 THEN 'fg_made_0_19' WHEN kick_distance < 30 THEN 'fg_made_20_29' WHEN kick_distance < 40 THEN 'fg_made_30_39' WHEN kick_distance < 50 THEN 'fg_made_40_49'
            WHEN kick_distance < 60 THEN 'fg_made_50_59' ELSE 'fg_made_60_' END AS bucket, count(*) AS n FROM v_play WHERE goal GROUP BY 1""")
def kick_buckets(spark, sf):
    kicks = play_rows(spark, sf).where(F.col("field_goal_attempt") & (F.col("field_goal_result") == "made"))
    return kicks.groupBy(pl.kick_bucket(F.col("kick_distance")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("p21_remaining_fraction", "event_id:i frac:d",
       """SELECT event_id, CASE WHEN p > 4 THEN 0.05 ELSE greatest(0, least(1, 1 - (greatest(0, p - 1) * 900 + 900 - s) / 3600.0)) END AS frac FROM (
            SELECT event_id, hour(ts) // 4 AS p, CASE WHEN event_id % 9 = 0 THEN 0 ELSE (minute(ts) % 16) * 60 + floor(second(ts)) END AS s FROM events)""")
def remaining(spark, sf):
    clock = F.when(F.col("event_id") % 9 == 0, "late").otherwise(F.format_string("%d:%02d", F.minute("ts") % 16, F.second("ts")))
    rows = b.table(spark, sf, "events").select("event_id", F.floor(F.hour("ts") / 4).cast("int").alias("period"), clock.alias("clock"))
    return rows.select("event_id", pl.remaining_fraction().alias("frac"))
