"""Live tier: the events table read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.operators import events as ev
from rivalgrid.operators.plays import board_fraction, remaining_fraction
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS
from rivalgrid.sources import documents as docs
from rivalgrid.sources.tables import scratch
from rivalgrid.streaming import landing as ld
from rivalgrid.streaming import live as lv

NOW = "2024-01-20 12:00:00"
VIEWS.update({
    "v_status": """SELECT user_id AS entity, arg_max(value, (ts, event_id)) AS points, arg_max(event_type = 'purchase', (ts, event_id)) AS finished FROM events GROUP BY user_id""",
    "v_fraction": """SELECT grp, CASE WHEN p > 4 THEN 0.05 ELSE greatest(0, least(1, 1 - (greatest(0, p - 1) * 900 + 900 - s) / 3600.0)) END AS fraction FROM (
        SELECT user_id % 10 AS grp, arg_max(hour(ts) // 4, (ts, event_id)) AS p, arg_max((minute(ts) % 16) * 60 + floor(second(ts)), (ts, event_id)) AS s FROM events WHERE user_id % 10 <> 3 GROUP BY user_id % 10)""",
    "v_starter": """SELECT DISTINCT user_id AS entity, user_id % 10 AS grp, user_id % 12 AS team, CASE user_id % 5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'K' END AS category FROM events""",
    "v_blend": """SELECT *, points + remaining * mean AS projected, sd * sd * remaining AS variance FROM (
        SELECT s.*, u.entity % 7 = 2 AS stub, CASE WHEN u.entity % 7 = 2 THEN 0.0 ELSE 10.0 + u.entity % 7 END AS mean,
          CASE WHEN u.entity % 7 = 2 OR u.entity % 4 = 0 THEN CASE s.category WHEN 'QB' THEN 6.0 WHEN 'RB' THEN 5.0 WHEN 'WR' THEN 4.0 ELSE 3.0 END ELSE 2.0 + u.entity % 3 END AS sd,
          coalesce(u.points, 0) AS points, coalesce(f.fraction, CASE WHEN u.finished THEN 0 ELSE 1 END) AS remaining
        FROM v_starter s JOIN v_status u USING (entity) LEFT JOIN v_fraction f ON f.grp = s.grp)""",
})


FILES_PER_BATCH = 4


def event_stream(spark, sf):
    """events.parquet as a file stream under the table's own schema, a few files a batch."""
    schema = b.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(sf)


def status_updates(rows):
    return rows.select(F.col("user_id").alias("entity"), "ts", "event_id", F.col("value").alias("points"), (F.col("event_type") == "purchase").alias("finished"))


def streamed_status(spark, sf):
    return ld.land_stream(status_updates(event_stream(spark, sf)), ld.newest(["entity"], ["ts", "event_id"]), "status")


@query("k02_status_stream", "entity:i points:d finished:b", "SELECT * FROM v_status")
def status_stream(spark, sf):
    """The latest status per entity, batch by batch."""
    return streamed_status(spark, sf)


def fractions_stream(spark, sf):
    rows = event_stream(spark, sf).where(F.col("user_id") % 10 != 3).select(
        (F.col("user_id") % 10).alias("grp"), "ts", "event_id", F.floor(F.hour("ts") / 4).cast("int").alias("period"),
        F.format_string("%d:%02d", F.minute("ts") % 16, F.second("ts")).alias("clock"))
    return ld.land_stream(rows, ld.newest(["grp"], ["ts", "event_id"]), "clock").withColumn("fraction", remaining_fraction())


def scoreboard_bodies(spark, sf):
    """Scoreboard documents as they are polled: one JSON body per game and poll. Some are cut short, some name
    no teams, some have a clock that is none."""
    e = b.table(spark, sf, "events").where(F.col("event_type").isNotNull())
    state = F.when(F.col("event_type") == "purchase", "post").when(F.col("event_type") == "signup", "pre").otherwise("in")
    clock = F.when(F.col("event_id") % 31 == 4, "half").otherwise(F.format_string("%d:%02d", F.minute("ts") % 16, F.second("ts")))
    teams = [F.when(F.col("event_id") % 23 != 3, (F.col("user_id") % 40 + i * 40).cast("string")).alias(n) for i, n in enumerate(("home", "away"))]
    body = F.to_json(F.struct(state.alias("state"), F.floor(F.hour("ts") / 4).cast("int").alias("period"), clock.alias("clock"), *teams, F.col("event_id").alias("sent")))
    return e.select(F.when(F.col("event_id") % 17 == 5, F.substring(body, 1, 30)).otherwise(body).alias("value"))


VIEWS["v_board"] = """SELECT *, CASE state WHEN 'pre' THEN 1.0 WHEN 'post' THEN 0.0 ELSE
      CASE WHEN p > 4 THEN 0.05 ELSE greatest(0, least(1, 1 - (greatest(0, p - 1) * 900 + 900 - s) / 3600.0)) END END AS fraction FROM (
    SELECT unnest([user_id % 40, user_id % 40 + 40]) AS grp, event_id, hour(ts) // 4 AS p, CASE WHEN event_id % 31 = 4 THEN 0 ELSE (minute(ts) % 16) * 60 + floor(second(ts)) END AS s,
           CASE event_type WHEN 'purchase' THEN 'post' WHEN 'signup' THEN 'pre' ELSE 'in' END AS state
    FROM events WHERE event_type IS NOT NULL AND event_id % 17 <> 5 AND event_id % 23 <> 3)"""


@query("s21_scoreboard_stream", "grp:i fraction:d sent:i", "SELECT grp, arg_max(fraction, event_id) AS fraction, max(event_id) AS sent FROM v_board GROUP BY grp")
def scoreboard_stream(spark, sf):
    """Documents landed as text, read as a stream, parsed with the bad ones set aside, newest per team."""
    folder = scratch(spark, "scoreboards")
    scoreboard_bodies(spark, sf).repartition(16).write.text(folder)
    polled = spark.readStream.option("maxFilesPerTrigger", FILES_PER_BATCH).text(folder).withColumnRenamed("value", "body")
    boards, _ = docs.scoreboards(polled)
    newest = ld.land_stream(boards, ld.newest(["grp"], ["sent"]), "boards")
    return newest.withColumn("fraction", board_fraction())


@query("s21_quarantined_scoreboards", "reason:s n:i",
       """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 17 = 5 THEN 'not a scoreboard' WHEN event_id % 23 = 3 THEN 'no teams' END AS reason FROM events WHERE event_type IS NOT NULL)
          WHERE reason IS NOT NULL GROUP BY reason""")
def quarantined(spark, sf):
    """The documents set aside, by what is wrong with them."""
    _, bad = docs.scoreboards(scoreboard_bodies(spark, sf).withColumnRenamed("value", "body"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def blended(spark, sf):
    starters = b.table(spark, sf, "events").select(F.col("user_id").alias("entity")).distinct().select(
        "entity", (F.col("entity") % 10).alias("grp"), (F.col("entity") % 12).alias("team"), b.category_of(F.col("entity")).alias("category"))
    known = starters.where(F.col("entity") % 7 != 2).select(
        "entity", (F.lit(10.0) + F.col("entity") % 7).alias("mean"), F.when(F.col("entity") % 4 != 0, F.lit(2.0) + F.col("entity") % 3).alias("sd"))
    sd = spark.createDataFrame([("QB", 6.0), ("RB", 5.0), ("WR", 4.0), ("TE", 3.0), ("K", 3.0)], "category string, category_sd double")
    return lv.blend(lv.with_fallback_sd(starters, known, sd), streamed_status(spark, sf), fractions_stream(spark, sf))


@query("k01_live_blend", "entity:i team:i points:d remaining:d projected:d variance:d", "SELECT * FROM v_blend")
def live_blend(spark, sf):
    return blended(spark, sf).withColumnRenamed("left", "remaining")


@query("k01_live_team_totals", "team:i mean:d sd:d points:d", "SELECT team, sum(projected) AS mean, sqrt(sum(variance)) AS sd, sum(points) AS points FROM v_blend GROUP BY team")
def live_totals(spark, sf):
    return lv.team_totals(blended(spark, sf))


@query("k06_stub_unknown", "entity:i stub:b mean:d sd:d", "SELECT entity, stub, mean, sd FROM v_blend")
def stubs(spark, sf):
    return blended(spark, sf)


@query("k03_live_gate", "tenant:i should_run:b",
       f"""SELECT user_id % 40 AS tenant, bool_or(coalesce(state = 'in' OR (state = 'post' AND epoch(TIMESTAMP '{NOW}') - epoch(ts) < 270 * 60), FALSE)) AS should_run FROM (
             SELECT *, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 2000 = 7 THEN 'in' ELSE 'post' END AS state FROM events WHERE ts <= TIMESTAMP '{NOW}') GROUP BY user_id % 40""")
def live_gate(spark, sf):
    """K03, D05; rows without a state are skipped."""
    rows = b.table(spark, sf, "events").where(F.col("ts") <= F.lit(NOW).cast("timestamp")).select(
        (F.col("user_id") % 40).alias("tenant"), F.date_trunc("second", "ts").alias("start"),
        F.when(F.col("event_type") == "error", None).when(F.col("event_id") % 2000 == 7, "in").otherwise("post").alias("state"))
    return lv.gate(rows, F.lit(NOW).cast("timestamp"))


@query("k04_baseline_overlay", "entity:i period:i points:d projected:d live:b",
       """SELECT s.entity, p AS period, CASE WHEN e.entity % 6 <> 0 THEN e.points ELSE 0 END AS points, 10.0 AS projected, e.entity % 6 <> 0 AS live
          FROM (SELECT entity, 4 AS p FROM v_starter) s JOIN v_status e USING (entity)""")
def overlay(spark, sf):
    """A tick replaces its own columns, and only for the baseline's period."""
    tick = streamed_status(spark, sf).withColumn("period", F.when(F.col("entity") % 6 == 0, 5).otherwise(4))
    base = b.table(spark, sf, "events").select(F.col("user_id").alias("entity")).distinct().select(
        "entity", F.lit(4).alias("period"), F.lit(0.0).alias("points"), F.lit(10.0).alias("projected"))
    return lv.overlay(base, tick, ["entity"], ["points"], "period")


@query("k07_frozen_estimates", "entity:i value:d frozen:b",
       """SELECT entity, arg_max(value, (us, event_id)) AS value, bool_or(f IS NOT NULL) AS frozen FROM (
            SELECT user_id AS entity, event_id, value, epoch_us(ts) AS us, event_type, min(CASE WHEN event_type = 'purchase' AND ts > TIMESTAMP '2024-01-20' THEN epoch_us(ts) END) OVER (PARTITION BY user_id) AS f FROM events)
          WHERE NOT (event_type = 'purchase' AND us > epoch_us(TIMESTAMP '2024-01-20')) AND (f IS NULL OR us < f) GROUP BY entity""")
def frozen(spark, sf):
    """Estimates rewritten until the processed mark, frozen from then on: landed and folded, no keyed state."""
    mark = (F.col("event_type") == "purchase") & (F.col("ts") > F.lit("2024-01-20").cast("timestamp"))
    rows = event_stream(spark, sf).select(
        F.col("user_id").alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"), "value", mark.alias("is_mark"))
    return ld.logged(ld.land_stream(rows, ld.log_until_mark("entity"), "log"), "entity")


@query("k08_final_games_only", "season:i week:i grp:i pts:d",
       "SELECT p.season, p.week, p.grp, sum(p.pts) AS pts FROM v_perf p JOIN v_final f ON f.season = p.season AND f.week = p.week AND f.grp = p.grp WHERE f.final GROUP BY p.season, p.week, p.grp")
def final_only(spark, sf):
    rows = lv.final_games_only(b.perf(spark, sf), b.games(spark, sf), ["season", "week", "grp"])
    return rows.groupBy("season", "week", "grp").agg(F.sum("pts").alias("pts"))


@query("k09_drop_stale_outputs", "source:i week:i n:i",
       """SELECT source, week, count(*) AS n FROM v_raw_bid JOIN (SELECT source, max(week) AS now FROM v_raw_bid WHERE season = 2001 GROUP BY source) USING (source)
          WHERE season = 2001 AND week = now GROUP BY source, week""")
def stale(spark, sf):
    rows = b.raw_bids(spark, sf, [2001])
    now = rows.groupBy("source").agg(F.max("week").alias("week"))
    return lv.drop_stale(rows, now, ["source"], "week").groupBy("source", "week").agg(F.count(F.lit(1)).alias("n"))


@query("k10_incremental_pull", "source:i season:i", "SELECT DISTINCT source, season FROM v_raw_bid EXCEPT SELECT DISTINCT source, season FROM v_raw_bid WHERE (source + season) % 2 = 0")
def incremental(spark, sf):
    rows = b.raw_bids(spark, sf)
    return lv.not_yet_landed(rows, rows.where((F.col("source") + F.col("season")) % 2 == 0), ["source", "season"])


@query("k11_partial_week_view", "source:i entity:i signal:s n:i cost:d",
       "SELECT source, entity, signal, count(*) AS n, sum(cost) AS cost FROM v_bids WHERE season = 2001 AND week = 6 GROUP BY source, entity, signal")
def partial_week(spark, sf):
    rows = b.raw_bids(spark, sf, [2001]).where(F.col("week") == 6)
    flat = F.when(F.col("source") == b.NAMED_SOURCE, b.FLAT_COST).otherwise(0.0)
    bids = ev.classify(ev.collapse_variants(rows), flat)
    return bids.groupBy("source", "entity", "signal").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
