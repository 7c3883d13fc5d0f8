"""Operators with a query of their own beside the larger ones they are part of."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.functions import text as tx
from rivalgrid.functions.numeric import credibility, win_probability
from rivalgrid.functions.scoring import score
from rivalgrid.operators import comps, usage
from rivalgrid.operators import events as ev
from rivalgrid.operators import grids as gr
from rivalgrid.operators import models as md
from rivalgrid.operators import plays as pl
from rivalgrid.operators.allowed import allowed_cells, mean_ratio_index
from rivalgrid.operators.asof import asof_before, blackout, era_of
from rivalgrid.operators.ranking import rank_by_category
from rivalgrid.plans import bindings as b
from rivalgrid.plans import block_1_matchups as b1
from rivalgrid.plans import block_2_events as b2
from rivalgrid.plans import block_4_comps as b4
from rivalgrid.plans import block_5_history as b5
from rivalgrid.plans import block_6_plays as b6
from rivalgrid.plans import block_7_lineup as b7
from rivalgrid.plans import block_9_live as b9
from rivalgrid.plans import block_10_sources as b10
from rivalgrid.plans.block_8_scenarios import ERF_SQL
from rivalgrid.plans.registry import query
from rivalgrid.sources import tables as tb


# ---- scans --------------------------------------------------------------------------------------

@query("s02_read_group_stats", "custkey:i n:i total:d pace:d", "SELECT o_custkey AS custkey, count(*) AS n, sum(o_totalprice) AS total, 0.0 AS pace FROM orders GROUP BY o_custkey")
def read_group_stats(spark, sf):
    rows = tb.read_seasons(spark, f"{sf}/orders.parquet", b10.schema("o_custkey bigint, o_totalprice double, pace double"), [])
    return rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.sum("pace").alias("pace"))


@query("s04_read_plays", "role:s n:i value:d yardline:d", "SELECT event_type AS role, count(*) AS n, sum(value) AS value, 0.0 AS yardline FROM events GROUP BY event_type")
def read_plays(spark, sf):
    rows = tb.read_seasons(spark, f"{sf}/events.parquet", b10.schema("event_type string, value double, yardline_100 double"), [])
    return rows.groupBy(F.col("event_type").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum("yardline_100").alias("yardline"))


@query("s05_read_expected_rows", "season:i qtr:i n:i", "SELECT CAST(year(ts) AS INT) AS season, CAST(1 + hour(ts) // 6 AS INT) AS qtr, count(*) AS n FROM events GROUP BY 1, 2")
def read_expected(spark, sf):
    """A source whose season and quarter arrive as text."""
    raw = b.table(spark, sf, "events").select(F.year("ts").cast("string").alias("season"), F.floor(1 + F.hour("ts") / 6).cast("string").alias("qtr"))
    return tb.conform(raw, b10.schema("season int, qtr int")).groupBy("season", "qtr").agg(F.count(F.lit(1)).alias("n"))


@query("s06_read_snap_counts", "entity:i snaps:d share:d", "SELECT l_suppkey AS entity, sum(l_quantity) AS snaps, avg(l_discount) AS share FROM lineitem GROUP BY l_suppkey")
def read_snaps(spark, sf):
    rows = tb.read_seasons(spark, f"{sf}/lineitem.parquet", b10.schema("l_suppkey bigint, l_quantity double, l_discount double"), [])
    return rows.groupBy(F.col("l_suppkey").alias("entity")).agg(F.sum("l_quantity").alias("snaps"), F.avg("l_discount").alias("share"))


@query("s07_read_status_reports", "status:s n:i", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def read_status(spark, sf):
    rows = tb.read_seasons(spark, f"{sf}/orders.parquet", b10.schema("o_orderstatus string, practice string"), [])
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("s08_read_entity_master", "entity:i name:s grp:s missing_id:n", "SELECT s_suppkey AS entity, s_name AS name, CASE n_name WHEN 'NATION_3' THEN 'NATION_4' ELSE n_name END AS grp, NULL AS missing_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def read_master(spark, sf):
    rows = b.table(spark, sf, "supplier").join(b.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    shaped = tb.conform(rows.withColumnsRenamed({"s_suppkey": "entity", "s_name": "name", "n_name": "grp"}), b10.schema("entity bigint, name string, grp string, missing_id string"))
    return tb.normalize_groups(shaped, ["grp"], {"NATION_3": "NATION_4"})


# ---- projections --------------------------------------------------------------------------------

@query("p10_expected_role_rows", "game_id:s play_id:i entity:i role:s receptions:d passing_yards:d rushing_yards:d",
       """SELECT game_id, play_id, user_id AS entity, 'pass' AS role, 0.0 AS receptions, coalesce(comp * (yac + air), 0) AS passing_yards, 0.0 AS rushing_yards FROM v_exp_play WHERE event_type IN ('click', 'view')
          UNION ALL SELECT game_id, play_id, receiver_id, 'reception', comp, 0, 0 FROM v_exp_play WHERE event_type IN ('click', 'view')
          UNION ALL SELECT game_id, play_id, user_id, 'rush', 0, 0, ry FROM v_exp_play WHERE event_type IN ('error', 'signup')""")
def expected_roles(spark, sf):
    return b6.expected_plays(spark, sf).fillna(0.0, subset=["receptions", "passing_yards", "rushing_yards"])


@query("p16_compiled_rule_set", "season:i week:i entity:i pts:d", "SELECT season, week, entity, 2.0 * carries + 1.0 * floor(receiving_yards / 10) + 0.5 * receptions AS pts FROM v_perf")
def compiled(spark, sf):
    """Other-domain and zero items fall away, one of the two items over one column is kept."""
    rules = [("RA", 2.0), ("REY10", 1.0), ("REC", 0.5), ("SK", 9.0), ("PY", 0.0), ("KRTD", 6.0), ("PRTD", 6.0)]
    return score(b.perf(spark, sf).drop("pts"), rules)


@query("p23_short_field_plays", "game_id:s plays:i nearest:i", "SELECT game_id, count(*) AS plays, min(short_yardline) AS nearest FROM v_elapsed WHERE short_yardline IS NOT NULL GROUP BY game_id")
def short_fields(spark, sf):
    rows = b6.play_rows(spark, sf).withColumn("short", pl.short_field()).where(F.col("short").isNotNull())
    return rows.groupBy("game_id").agg(F.count(F.lit(1)).alias("plays"), F.min("short").alias("nearest"))


@query("p26_zeroed_weeks", "entity:i week:i projected:d zero_reason:s", "SELECT entity, week, projected, zero_reason FROM v_project WHERE opp IS NOT NULL AND projected = 0")
def zeroed(spark, sf):
    return b1.projection_weeks(spark, sf).where(F.col("opp").isNotNull() & (F.col("projected") == 0))


@query("p29_reserve_statuses", "status:s reserve:b n:i", "SELECT CASE c_custkey % 3 WHEN 0 THEN 'OUT' WHEN 1 THEN 'ACTIVE' END AS status, c_custkey % 3 = 0 AS reserve, count(*) AS n FROM customer GROUP BY 1, 2")
def reserve(spark, sf):
    k = F.col("c_custkey") % 3
    rows = b.table(spark, sf, "customer").select(F.when(k == 0, "OUT").when(k == 1, "ACTIVE").alias("status"))
    return rows.withColumn("reserve", tx.reserve_eligible(F.col("status"))).groupBy("status", "reserve").agg(F.count(F.lit(1)).alias("n"))


@query("p31_missed_periods", "season:i entity:i missed:i",
       """SELECT f.season, s_suppkey AS entity, count(*) AS missed FROM supplier JOIN v_final f ON f.grp = s_nationkey LEFT JOIN v_perf p ON p.season = f.season AND p.week = f.week AND p.entity = s_suppkey
          WHERE f.final AND p.pts IS NULL AND (s_suppkey + f.week) % 3 <> 0 GROUP BY f.season, s_suppkey""")
def missed(spark, sf):
    return b1.actual(spark, sf).where("missed").groupBy("season", "entity").agg(F.count(F.lit(1)).alias("missed"))


@query("p37_slot_labels", "slot:s n:i", "SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'FLEX' WHEN 'BUILDING' THEN 'D/ST' ELSE c_mktsegment END AS slot, count(*) AS n FROM customer GROUP BY 1")
def slot_labels(spark, sf):
    label = tx.slot_label(F.col("c_mktsegment"), {"MACHINERY": "FLEX", "BUILDING": "D/ST"})
    return b.table(spark, sf, "customer").groupBy(label.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins --------------------------------------------------------------------------------------

@query("j15_season_eras", "season:i era:s n:i", f"SELECT season, {b5.ERA_SQL} AS era, count(*) AS n FROM v_order_item GROUP BY 1, 2")
def eras(spark, sf):
    rows = b.order_items(spark, sf, "l_linenumber").groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("era", era_of(F.col("season"), b5.ERAS))


@query("j20_enriched_bids", f"source:i season:i week:i entity:i signal:s n_bidders:n prior_points:d team_left:d source_spend:d {b2.TID_SPEC}",
       f"""SELECT b.source, b.season, b.week, b.entity, signal, n_bidders, p.pts AS prior_points, CASE WHEN u.budget > 0 THEN greatest(0, least(1, 1 - spent / u.budget)) END AS team_left, source_spend, {b2.TID.replace('tid.', 'b.tid.')}
           FROM (SELECT *, coalesce(sum(cost) OVER (PARTITION BY source, season, team ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(cost) OVER (PARTITION BY source, season) AS source_spend FROM v_bids) b
           LEFT JOIN (SELECT source, season, week, entity, count(DISTINCT team) AS n_bidders FROM v_bids WHERE kind = 'WAIVER' GROUP BY ALL) c USING (source, season, week, entity)
           LEFT JOIN v_budget u USING (source, season)
           LEFT JOIN (SELECT season, week + 1 AS week, entity, pts FROM v_part_perf) p ON p.season = b.season AND p.week = b.week AND p.entity = b.entity""")
def enriched(spark, sf):
    """The fact table: bids with bidders, previous points, budget left and spend denominators."""
    rows = b.bids(spark, sf)
    prior = b.part_perf(spark, sf).select("season", (F.col("week") + 1).alias("week"), "entity", F.col("pts").alias("prior_points"))
    left = ev.budget_remaining(rows, b.budgets(spark, sf, rows), b.WEEKS).select("source", "season", "team", "week", "team_left")
    spend = rows.groupBy("source", "season").agg(F.sum("cost").alias("source_spend"))
    out = rows.join(ev.competing_bidders(rows), ev.EVENT, "left").join(prior, ev.POOLED, "left")
    return b2.with_tid(out.join(left, ["source", "season", "team", "week"], "left").join(spend, ["source", "season"], "left"))


@query("j32_rank_index", "page:s id:i cutoff:i ecr:d blackout:b",
       """SELECT g.page, g.id, g.cutoff, arg_max(r.ecr, (r.day, r.event_id)) AS ecr, g.d <= g.first AS blackout
          FROM (SELECT page, id, first, cutoff, d FROM (SELECT page, id, min(day) AS first FROM v_rank GROUP BY page, id) CROSS JOIN v_cutoff) g
          LEFT JOIN v_rank r ON r.page = g.page AND r.id = g.id AND r.day < g.d GROUP BY g.page, g.id, g.cutoff, g.d, g.first""")
def rank_index(spark, sf):
    """Snapshots, cutoffs and blackouts as one keyed table."""
    snaps = b4.snapshots(spark, sf)
    known = asof_before(snaps, ["page", "id"], "day", "ecr", b4.CUTOFFS, tie=["event_id"])
    return blackout(snaps, ["page", "id"], "day", b4.CUTOFFS).join(known, ["page", "id", "cutoff"], "left")


# ---- aggregates, windows, sets ------------------------------------------------------------------

@query("a26_plays_per_entity", "game_id:s entity:i plays:i", "SELECT game_id, entity, count(*) AS plays FROM v_role GROUP BY game_id, entity")
def plays_per_entity(spark, sf):
    return pl.role_rows(b6.play_rows(spark, sf)).groupBy("game_id", "entity").agg(F.count(F.lit(1)).alias("plays"))


@query("w05_rank_keeps_null", "season:i week:i grp:i category:s opp_usual:d rank:n",
       """SELECT season, week, grp, category, u AS opp_usual, CASE WHEN u IS NOT NULL THEN row_number() OVER (PARTITION BY season, week, category ORDER BY u DESC NULLS LAST, grp) END AS rank
          FROM (SELECT *, CASE WHEN allowed > 0 THEN opp_usual END AS u FROM v_allowed)""")
def rank_keeps_null(spark, sf):
    cells = allowed_cells(b.dense(spark, sf)).withColumn("opp_usual", F.when(F.col("allowed") > 0, F.col("opp_usual")))
    return rank_by_category(cells, ["season", "week", "category"], "opp_usual", ["grp"])


@query("w07_cumulative_spend", "source:i season:i team:i week:i spent_before:d", f"SELECT source, season, team, week, spent_before FROM ({b2.LEFT_SQL})")
def cumulative_spend(spark, sf):
    rows = b.bids(spark, sf)
    return ev.budget_remaining(rows, b.budgets(spark, sf, rows), b.WEEKS)


@query("u01_real_and_synthetic", "source:i season:i synthetic:b n:i cost:d", "SELECT source, season, synthetic, count(*) AS n, sum(cost) AS cost FROM v_promoted GROUP BY source, season, synthetic")
def real_and_synthetic(spark, sf):
    return b2.promoted(spark, sf).groupBy("source", "season", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query("u03_universe_minus_owned", "season:i week:i entity:i sources:i",
       """WITH k AS (SELECT DISTINCT season, week, source FROM v_bids), e AS (SELECT DISTINCT season, week, entity FROM v_rostered)
          SELECT e.season, e.week, e.entity, count(*) AS sources FROM e JOIN k ON k.season = e.season AND k.week = e.week
          WHERE NOT EXISTS (SELECT 1 FROM v_rostered r WHERE r.season = e.season AND r.week = e.week AND r.entity = e.entity AND r.source = k.source) GROUP BY 1, 2, 3""")
def universe_minus_owned(spark, sf):
    """Sources reporting a week minus those that own the entity, by counts."""
    rows = b.bids(spark, sf)
    reporting = rows.select("season", "week", "source").distinct().withColumn("_r", F.lit(1))
    totals = reporting.groupBy("season", "week").agg(F.count(F.lit(1)).alias("_all"))
    owned = b.rostered(rows).join(reporting, ["season", "week", "source"], "left").groupBy(*ev.POOLED).agg(F.coalesce(F.sum("_r"), F.lit(0)).alias("_own"))
    return owned.join(totals, ["season", "week"]).withColumn("sources", F.col("_all") - F.col("_own")).where(F.col("sources") > 0)


@query("u04_distinct_keys", "source:i season:i week:i entity:i", "SELECT DISTINCT source, season, week, entity FROM v_train")
def distinct_keys(spark, sf):
    return ev.trainable(b.bids(spark, sf), b.CATEGORIES, b.BAD_IDS).select(*ev.EVENT).distinct()


@query("u06_home_and_away_union", "season:i week:i grp:i opp:i home:b", "SELECT season, week, grp, opp, home FROM v_final")
def perspectives(spark, sf):
    none = F.lit(None).cast("double")
    g = b.games(spark, sf).where("home").select("season", "week", F.col("grp").alias("home_grp"), F.col("opp").alias("away_grp"), none.alias("home_score"), none.alias("away_score"))
    return gr.both_sides(g)


# ---- models -------------------------------------------------------------------------------------

@query("m04_credibility_weights", "season:i week:i entity:i weight:d", "SELECT season, week, entity, n_sources / (n_sources + 15.0) AS weight FROM v_prices")
def credibility_weights(spark, sf):
    won = b2.promoted(spark, sf).where(F.col("signal") == "won")
    return won.groupBy(*ev.POOLED).agg(F.count_distinct("source").alias("n")).withColumn("weight", credibility("n"))


@query("m08_confidence_samples", "qid:i value:d weight:d",
       """SELECT c.qid, v.value, sum(c.w_capped / v.wins) AS weight FROM v_price_w c JOIN (
            SELECT season, week, entity, cost / budget AS value, count(*) OVER (PARTITION BY season, week, entity) AS wins FROM v_promoted WHERE signal = 'won' AND budget > 0) v USING (season, week, entity) GROUP BY c.qid, v.value""")
def samples(spark, sf):
    rows = comps.confidence_samples(comps.price_weights(b4.price_comps(spark, sf)), b4.event_wins(spark, sf))
    return rows.groupBy("qid", "value").agg(F.sum("weight").alias("weight"))


@query("m09_price_regression", "intercept:d slope:d",
       """SELECT regr_intercept(ln(1 + target), prior_points) AS intercept, regr_slope(ln(1 + target), prior_points) AS slope FROM v_feat JOIN v_prices USING (season, week, entity)""")
def price_regression(spark, sf):
    rows = b4.model_rows(spark, sf).where(F.col("target").isNotNull())
    model = md.fit_price(rows, ["prior_points"])
    return spark.createDataFrame([(float(model.intercept), float(model.coefficients[0]))], "intercept double, slope double")


@query("m10_interest_regression", "feature:s weight:d")
def interest_regression(spark, sf):
    """No SQL twin; the gradient at the solution is checked in tests."""
    names = [*b4.MODEL_FEATURES, "phase_decline", "phase_final"]
    model, _ = md.fit_interest(b4.model_rows(spark, sf), names)
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, model.coefficients)] + [("intercept", float(model.intercept))], "feature string, weight double")


_INTEREST = [*b4.MODEL_FEATURES, "phase_decline", "phase_final"]


@query("m10_zero_gradient", "feature:s gradient:d n:i",
       f"SELECT unnest({[*_INTEREST, 'intercept']}) AS feature, 0.0 AS gradient, (SELECT count(*) FROM v_feat) AS n")
def interest_certificate(spark, sf):
    """The fit minimises a convex loss, so it is right if the gradient there is zero (per row, to three digits)."""
    rows = b4.model_rows(spark, sf)
    model, st = md.fit_interest(rows, _INTEREST)
    return md.interest_gradient(rows, _INTEREST, model, st)


@query("m11_normal_equations", "feature:s residual:d n:i negative:i",
       f"""SELECT unnest({[*b4.MODEL_FEATURES, 'intercept', 'interest']}) AS feature, 0.0 AS residual,
            (SELECT count(*) FROM v_feat JOIN v_prices USING (season, week, entity)) AS n, 0 AS negative""")
def price_certificate(spark, sf):
    """Residuals of the predicted log price are orthogonal to every feature, predicted interest has the
    mean of the labels, and no predicted price is below zero."""
    rows = b4.model_rows(spark, sf)
    known = rows.where(F.col("target").isNotNull())
    price = md.fit_price(known, b4.MODEL_FEATURES)
    interest, st = md.fit_interest(rows, _INTEREST)
    return md.prediction_residuals(rows, b4.MODEL_FEATURES, price, _INTEREST, interest, st)


@query("m14_group_interest", "category:s level:s handcuffs:i n:i",
       """SELECT category, CASE WHEN p >= 0.85 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS level, count(*) FILTER (WHERE peer_out > 0) AS handcuffs, count(*) AS n FROM (
            SELECT *, cume_dist() OVER (PARTITION BY category ORDER BY prior_points) AS p FROM v_feat) GROUP BY 1, 2""")
def group_interest(spark, sf):
    rows = b4.interest_level(spark, sf)
    return rows.groupBy("category", "level").agg(F.sum(F.col("handcuff").cast("int")).alias("handcuffs"), F.count(F.lit(1)).alias("n"))


@query("m17_normal_win_probability", "suppkey:i p:d",
       f"""SELECT s_suppkey AS suppkey, CASE WHEN spread > 0 THEN 0.5 * (1 + {ERF_SQL.format(x='x')}) WHEN gap > 0 THEN 1.0 WHEN gap < 0 THEN 0.0 ELSE 0.5 END AS p FROM (SELECT *, 1 / (1 + 0.3275911 * abs(x)) AS t FROM (
             SELECT s_suppkey, s_acctbal - 5000 AS gap, sqrt(2 * sd * sd) AS spread, CASE WHEN sd > 0 THEN (s_acctbal - 5000) / (sqrt(2 * sd * sd) * sqrt(2.0)) END AS x FROM (SELECT *, (s_suppkey % 4) * 900.0 AS sd FROM supplier)))""")
def normal_win(spark, sf):
    sd = (F.col("s_suppkey") % 4) * 900.0
    return b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), win_probability(F.col("s_acctbal"), sd, F.lit(5000.0), sd).alias("p"))


# ---- text, time, live, extension points ---------------------------------------------------------

@query("f02_play_labels", "label:s n:i", "SELECT label, count(*) AS n FROM v_role GROUP BY label")
def play_labels(spark, sf):
    return pl.role_rows(b6.play_rows(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("f05_key_families", "family:s n:i",
       "SELECT CASE WHEN key LIKE 'seed_%_division_priority' THEN 'division_priority' WHEN key LIKE 'seed_%_tiebreak_%' THEN 'tiebreak' ELSE 'other' END AS family, count(*) AS n FROM v_setting GROUP BY 1")
def key_families(spark, sf):
    part = F.regexp_extract("key", r"^seed_\d+_(division_priority|tiebreak)(_[1-4])?$", 1)
    return b10.setting_rows(spark, sf).groupBy(F.when(part == "", "other").otherwise(part).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("f06_alias_both_sides", "name:s opponent:s games:i",
       """SELECT CASE a.n_name WHEN 'NATION_5' THEN 'NATION_6' ELSE a.n_name END AS name, CASE o.n_name WHEN 'NATION_5' THEN 'NATION_6' ELSE o.n_name END AS opponent, count(*) AS games
          FROM v_hist JOIN nation a ON manager = a.n_nationkey JOIN nation o ON opp = o.n_nationkey GROUP BY 1, 2""")
def alias_both(spark, sf):
    names = b.table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = b.history(spark, sf).join(names.withColumnsRenamed({"n_nationkey": "manager", "n_name": "name"}), "manager").join(
        names.withColumnsRenamed({"n_nationkey": "opp", "n_name": "opponent"}), "opp")
    return rows.replace({"NATION_5": "NATION_6"}, subset=["name", "opponent"]).groupBy("name", "opponent").agg(F.count(F.lit(1)).alias("games"))


@query("d02_month_day_year", "event_id:i day:s",
       "SELECT event_id, CAST(TRY_CAST(printf('%d-%02d-%02d', CASE WHEN 1 + event_id % 12 >= 8 THEN 2023 ELSE 2024 END, 1 + event_id % 12, day(ts)) AS DATE) AS VARCHAR) AS day FROM events")
def month_day(spark, sf):
    month = F.element_at(F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]), (1 + F.col("event_id") % 12).cast("int"))
    """All days of the month; one that the month has not is NULL."""
    rows = b.table(spark, sf, "events")
    return rows.select("event_id", tx.month_day_in_season(F.concat_ws(" ", month, F.dayofmonth("ts").cast("string")), F.lit(2023)).alias("day"))


@query("d05_live_window", "event_id:i live:b",
       f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 6 = 0 WHEN 1 THEN epoch(TIMESTAMP '{b9.NOW}') - epoch(date_trunc('second', ts)) < 16200 ELSE FALSE END AS live FROM events")
def live_window(spark, sf):
    k = F.col("event_id") % 3
    state = F.when(k == 0, F.when(F.col("event_id") % 6 == 0, "in").otherwise("pre")).when(k == 1, "post")
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return b.table(spark, sf, "events").select("event_id", tx.in_live_window(state, start, F.lit(b9.NOW).cast("timestamp")).alias("live"))


@query("k05_skip_other_periods", "entity:i live:b", "SELECT entity, entity % 6 <> 0 AS live FROM v_status")
def skip_other_periods(spark, sf):
    return b9.overlay(spark, sf)


@query("z01_expression_registry", "season:i item:s total:d",
       """SELECT season, 'REY25' AS item, sum(floor(receiving_yards / 25)) AS total FROM v_perf GROUP BY season UNION ALL SELECT season, 'RA10', sum(floor(carries / 10)) FROM v_perf GROUP BY season
          UNION ALL SELECT season, 'RY100', sum(CASE WHEN rushing_yards >= 100 AND rushing_yards < 200 THEN 1.0 ELSE 0 END) FROM v_perf GROUP BY season""")
def registry(spark, sf):
    rows = b.perf(spark, sf)
    items = ("REY25", "RA10", "RY100")
    for item in items:
        rows = score(rows, [(item, 1.0)], name=f"i_{item}")
    metrics = {i: (f"i_{i}", None) for i in items}
    return usage.unpivot_metrics(rows, ["season"], metrics).groupBy("season", F.col("metric").alias("item")).agg(F.sum("value").alias("total"))


@query("z02_groups_without_callbacks", "season:i week:i entity:i n_sources:i target:d", "SELECT season, week, entity, n_sources, target FROM v_prices WHERE n_sources > 1")
def no_callbacks(spark, sf):
    """Groups of varying shape through one native aggregate; an absent field is a NULL."""
    return b2.prices(spark, sf).where(F.col("n_sources") > 1)


@query("z04_basis_parameter", "basis:s season:i grp:i category:s allowed_avg:d",
       "SELECT 'last3' AS basis, season, grp, category, avg(allowed) AS allowed_avg FROM v_allowed0 WHERE back <= 3 GROUP BY season, grp, category")
def basis(spark, sf):
    return mean_ratio_index(b.dense(spark, sf), last=3).withColumn("basis", F.lit("last3"))


@query("z05_candidate_predicate", "grp_a:i give_a:s grp_b:i give_b:s kind:s",
       "SELECT * REPLACE (array_to_string(give_a, '+') AS give_a, array_to_string(give_b, '+') AS give_b) FROM v_swap_cand WHERE len(list_filter(give_b, lambda e: e % 2 = 1)) = len(give_b) AND len(give_a) <= len(give_b)")
def predicate(spark, sf):
    """A candidate filter is a Column, so it runs inside the plan."""
    wanted = F.forall("give_b", lambda e: e % 2 == 1) & (F.size("give_a") <= F.size("give_b"))
    return b7.shown(b7.candidates(b7.sides(spark, sf)[0]).where(wanted))
