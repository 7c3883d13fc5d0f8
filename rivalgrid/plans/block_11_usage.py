"""Usage shares, trends, presentation tables and source profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivalgrid.functions import stats as fs
from rivalgrid.functions.numeric import clamp
from rivalgrid.functions.scoring import compile_rules, default_rules, known_items, needed_columns, rules_by_source, rules_in_words, scored_categories, with_stat_columns
from rivalgrid.operators import usage as us
from rivalgrid.operators.ranking import top_n_any_size
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS

NOW = 9


@query("a17_group_totals", "season:i week:i grp:i category:s total:d", "SELECT season, week, grp, category, sum(carries) AS total FROM v_part_perf GROUP BY season, week, grp, category")
def group_totals(spark, sf):
    return us.group_totals(b.part_perf(spark, sf), "carries")


VIEWS["v_share"] = "SELECT *, snaps / sum(snaps) OVER (PARTITION BY season, week, grp) AS share FROM v_part_perf"


@query("a18_total_from_top_share", "season:i week:i grp:i top_share:d total:d",
       "SELECT season, week, grp, max(share) AS top_share, round(arg_max(snaps, (share, snaps)) / max(share)) AS total FROM v_share GROUP BY season, week, grp")
def total_from_share(spark, sf):
    return us.total_from_top_share(us.shares(b.part_perf(spark, sf), "snaps", "share"), "snaps", "share")


@query("a19_entity_shares", "season:i week:i entity:i share:d", "SELECT season, week, entity, share FROM v_share")
def entity_shares(spark, sf):
    return us.shares(b.part_perf(spark, sf), "snaps", "share")


@query("a19_last_write_wins", "entity:i yards:d", "SELECT entity, arg_max(yards, season * 100 + week) AS yards FROM v_part_perf GROUP BY entity")
def last_write(spark, sf):
    return us.last_write(b.part_perf(spark, sf).withColumn("o", F.col("season") * 100 + F.col("week")), ["entity"], "o", "yards")


@query("p44_usage_fractions", "season:i week:i entity:i num:n den:n",
       """SELECT season, week, entity, CASE WHEN season < 2001 OR week <= 6 THEN carries END AS num, CASE WHEN season < 2001 OR week <= 6 THEN sum(carries) OVER (PARTITION BY season, week, grp) END AS den FROM v_part_perf""")
def usage_fractions(spark, sf):
    return fractions(spark, sf)


def fractions(spark, sf):
    rows = b.part_perf(spark, sf)
    totals = us.group_totals(rows, "carries", by_category=False)
    done = (F.col("season") < b.PARTIAL_SEASON) | (F.col("week") <= b.PARTIAL_WEEK)
    return rows.join(totals, ["season", "week", "grp"]).withColumns({"num": F.when(done, F.col("carries")), "den": F.when(done, F.col("total"))})


@query("a20_ratio_of_sums", "season:i entity:i share:d",
       """SELECT season, entity, CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) END AS share FROM (
            SELECT season, week, entity, carries AS num, sum(carries) OVER (PARTITION BY season, week, grp) AS den FROM v_part_perf) WHERE season < 2001 OR week <= 6 GROUP BY season, entity
          UNION ALL SELECT season, entity, NULL FROM v_part_perf WHERE season = 2001 GROUP BY season, entity HAVING min(week) > 6""")
def ratio_of_sums(spark, sf):
    return us.ratio_of_sums(fractions(spark, sf), ["season", "entity"], "num", "den", "share")


@query("a21_season_summary", "season:i entity:i avg_pts:d total_pts:d ago_1:d ago_2:d",
       f"""SELECT season, entity, avg(pts) FILTER (WHERE week < {NOW}) AS avg_pts, sum(pts) FILTER (WHERE week < {NOW}) AS total_pts, max(pts) FILTER (WHERE week = {NOW - 1}) AS ago_1, max(pts) FILTER (WHERE week = {NOW - 2}) AS ago_2
           FROM v_perf GROUP BY season, entity""")
def season_summary(spark, sf):
    return us.summary_stats(b.perf(spark, sf), ["season", "entity"], NOW)


@query("a22_range_stats", "season:i entity:i carries:d receptions:d receiving_yards:d games:i",
       "SELECT season, entity, sum(carries) AS carries, sum(receptions) AS receptions, sum(receiving_yards) AS receiving_yards, count(DISTINCT week) AS games FROM v_perf WHERE week BETWEEN 3 AND 8 GROUP BY season, entity")
def range_stats(spark, sf):
    return us.range_stats(b.perf(spark, sf), ["season", "entity"], ["carries", "receptions", "receiving_yards"], 3, 8)


METRICS = {"points": ("pts", None), "carries": ("carries", ("RB", "QB")), "receptions": ("receptions", ("WR", "TE", "RB"))}


@query("z03_metric_series", "season:i week:i entity:i metric:s value:d",
       """SELECT season, week, entity, 'points' AS metric, pts AS value FROM v_perf UNION ALL SELECT season, week, entity, 'carries', carries FROM v_perf WHERE category IN ('RB', 'QB')
          UNION ALL SELECT season, week, entity, 'receptions', receptions FROM v_perf WHERE category IN ('WR', 'TE', 'RB')""")
def metric_series(spark, sf):
    return us.unpivot_metrics(b.perf(spark, sf), ["season", "week", "entity"], METRICS)


@query("p39_stat_blocks", "category:s stat:s total:d",
       """SELECT category, 'carries' AS stat, sum(carries) AS total FROM v_perf WHERE category = 'RB' GROUP BY category UNION ALL SELECT category, 'receptions', sum(receptions) FROM v_perf WHERE category IN ('RB', 'WR', 'TE') GROUP BY category
          UNION ALL SELECT category, 'rushing_yards', sum(rushing_yards) FROM v_perf WHERE category IN ('QB', 'RB') GROUP BY category UNION ALL SELECT category, 'receiving_yards', sum(receiving_yards) FROM v_perf WHERE category IN ('RB', 'WR', 'TE') GROUP BY category""")
def stat_blocks(spark, sf):
    names = ("carries", "receptions", "rushing_yards", "receiving_yards")
    metrics = {n: (n, tuple(c for c, cols in fs.STAT_BLOCKS.items() if n in cols)) for n in names}
    return us.unpivot_metrics(b.perf(spark, sf), ["category"], metrics).groupBy("category", F.col("metric").alias("stat")).agg(F.sum("value").alias("total"))


@query("p13_kick_attempts", "suppkey:i short:n long:n",
       """SELECT s_suppkey AS suppkey, CASE WHEN NOT (made IS NULL AND missed IS NULL AND list IS NULL) THEN coalesce(made, 0) + coalesce(missed, 0) + coalesce(len(list_filter(list_transform(string_split(list, ';'), lambda x: TRY_CAST(x AS DOUBLE)), lambda d: d BETWEEN 0 AND 39)), 0) END AS short,
            CASE WHEN list IS NOT NULL THEN len(list_filter(list_transform(string_split(list, ';'), lambda x: TRY_CAST(x AS DOUBLE)), lambda d: d >= 40)) END AS long
          FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 4 END AS made, CASE WHEN s_suppkey % 6 <> 0 THEN 1 END AS missed,
                  CASE WHEN s_suppkey % 2 = 1 THEN (20 + s_suppkey % 15) || ';' || (35 + s_suppkey % 20) || ';bad' END AS list FROM supplier)""")
def kick_attempts(spark, sf):
    k = F.col("s_suppkey")
    text = F.when(k % 2 == 1, F.concat((20 + k % 15).cast("string"), F.lit(";"), (35 + k % 20).cast("string"), F.lit(";bad")))
    rows = b.table(spark, sf, "supplier").select(k.alias("suppkey"), F.when(k % 3 != 0, k % 4).alias("made"), F.when(k % 6 != 0, 1).alias("missed"), text.alias("list"))
    none = F.lit(None).cast("int")
    return rows.select("suppkey", fs.attempts(F.col("made"), F.col("missed"), fs.blocked_in(F.col("list"), 0, 39)).alias("short"),
                       fs.attempts(none, none, fs.blocked_in(F.col("list"), 40, None)).alias("long"))


@query("p12_two_point_conversions", "season:i entity:i two:d", "SELECT season, entity, sum(receptions + carries) AS two FROM v_perf GROUP BY season, entity")
def two_points(spark, sf):
    rows = b.perf(spark, sf).withColumns({"passing_2pt_conversions": F.col("receptions"), "rushing_2pt_conversions": F.col("carries"), "receiving_2pt_conversions": F.lit(None).cast("double")})
    return rows.withColumn("two", fs.two_point_conversions()).groupBy("season", "entity").agg(F.sum("two").alias("two"))


@query("p32_next_period", "source:i week:i market_week:i",
       "SELECT source, week, CASE WHEN source % 2 = 0 THEN week + 1 ELSE week END AS market_week FROM (SELECT source, max(week) AS week FROM v_raw_bid WHERE season = 2001 GROUP BY source)")
def next_period(spark, sf):
    now = b.raw_bids(spark, sf, [b.PARTIAL_SEASON]).groupBy("source").agg(F.max("week").alias("week"))
    started = F.when(F.col("source") % 2 == 0, F.col("week")).otherwise(F.col("week") - 1)
    return now.withColumn("market_week", fs.next_period(F.col("week"), started))


@query("p34_sticky_value", "entity:i value:d",
       """WITH run AS (SELECT season, week, row_number() OVER (ORDER BY season DESC, week DESC) AS back FROM (SELECT DISTINCT season, week FROM v_perf))
          SELECT entity, coalesce(max(pts) FILTER (WHERE back = 1), max(pts) FILTER (WHERE back = 2)) AS value FROM v_perf JOIN run USING (season, week) GROUP BY entity""")
def sticky(spark, sf):
    """The value of the last run, or else of the run before it."""
    rows = b.perf(spark, sf)
    runs = rows.select("season", "week").distinct().orderBy(F.col("season").desc(), F.col("week").desc()).limit(2)
    back = runs.withColumn("back", F.row_number().over(Window.orderBy(F.col("season").desc(), F.col("week").desc())))
    return rows.join(back, ["season", "week"], "left").groupBy("entity").agg(F.coalesce(
        F.max(F.when(F.col("back") == 1, F.col("pts"))), F.max(F.when(F.col("back") == 2, F.col("pts")))).alias("value"))


@query("p40_score_or_projection", "season:i week:i grp:i score:d",
       """SELECT season, week, grp, CASE WHEN week < 6 THEN pf WHEN week = 6 THEN coalesce(CASE WHEN grp % 2 = 0 THEN pf / 2 END, 100.0) ELSE 100.0 END AS score FROM v_score""")
def score_or_projection(spark, sf):
    s = b.scores(spark, sf)
    live = F.when(F.col("grp") % 2 == 0, F.col("pf") / 2)
    return s.withColumn("score", fs.score_of(F.col("week"), F.lit(6), F.col("pf"), live, F.lit(100.0)))


@query("a76_actual_and_projected", "season:i grp:i actual:d projected:d",
       "SELECT season, grp, sum(CASE WHEN week <= 6 THEN pts END) AS actual, sum(CASE WHEN week > 6 THEN pts * 0.5 ELSE pts END) AS projected FROM v_perf GROUP BY season, grp")
def actual_projected(spark, sf):
    past = F.col("week") <= 6
    return b.perf(spark, sf).groupBy("season", "grp").agg(
        F.sum(F.when(past, F.col("pts"))).alias("actual"), F.sum(F.when(past, F.col("pts")).otherwise(F.col("pts") * 0.5)).alias("projected"))


@query("p43_rank_ratio", "suppkey:i ratio:d band:d",
       "SELECT s_suppkey AS suppkey, 1 - (1 + s_suppkey % 32 - 1) / 31.0 AS ratio, greatest(-1, least(1, ((s_acctbal / 5000) - 0.5) * 2)) AS band FROM supplier")
def rank_ratio(spark, sf):
    return b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), fs.rank_ratio(1 + F.col("s_suppkey") % 32).alias("ratio"), fs.probability_band(F.col("s_acctbal") / 5000).alias("band"))


@query("p11_clamp", "custkey:i v:d", "SELECT c_custkey AS custkey, CASE WHEN c_custkey % 7 <> 0 THEN greatest(0.5, least(1.5, c_acctbal / 3000)) END AS v FROM customer")
def clamped(spark, sf):
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), clamp(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 3000), 0.5, 1.5).alias("v"))


@query("p28_row_search", "entity:i owner:n category:s",
       """SELECT s_suppkey AS entity, o AS owner, c AS category FROM (SELECT *, CASE WHEN s_nationkey < 20 THEN s_nationkey END AS o, CASE s_suppkey % 5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'K' END AS c FROM supplier)
          WHERE contains(lower(s_name), 'er#0') AND (o IS NULL OR o = 3) AND c IN ('RB', 'WR', 'TE')""")
def row_search(spark, sf):
    rows = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity"), F.when(F.col("s_nationkey") < 20, F.col("s_nationkey")).alias("owner"), b.category_of(F.col("s_suppkey")).alias("category"), F.col("s_name").alias("name"))
    return rows.where(fs.row_filter(F.col("name"), F.col("owner"), F.col("category"), text=" ER#0 ", ownership="available", mine=3, group="FLEX", on_waivers=F.lit(None).cast("boolean")))


@query("j28_free_status", "entity:i label:s",
       "SELECT s_suppkey AS entity, CASE WHEN s_nationkey >= 20 AND s_acctbal > 2000 THEN 'waivers' END AS label FROM supplier")
def free_status(spark, sf):
    """Waiver status attached to entities nobody owns."""
    s = b.table(spark, sf, "supplier")
    status = s.where(F.col("s_acctbal") > 2000).select("s_suppkey", F.lit("waivers").alias("status"))
    return s.join(status, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("entity"), F.when((F.col("s_nationkey") >= 20) & F.col("status").isNotNull(), F.col("status")).alias("label"))


@query("t06_nulls_last_sort", "brand:s pos:i partkey:i",
       """SELECT * FROM (SELECT p_brand AS brand, p_partkey AS partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END DESC NULLS LAST, p_partkey) AS pos FROM part) WHERE pos <= 12""")
def nulls_last(spark, sf):
    rows = b.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("v"))
    return top_n_any_size(rows, ["brand"], [F.col("v").desc_nulls_last(), F.col("partkey").asc()], "partkey", 12)


@query("t07_category_order", "category:s place:i n:i", "SELECT category, CASE category WHEN 'QB' THEN 1 WHEN 'RB' THEN 2 WHEN 'WR' THEN 3 WHEN 'TE' THEN 4 ELSE 5 END AS place, count(*) AS n FROM v_perf GROUP BY category")
def ordered(spark, sf):
    rows = b.perf(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("place", fs.category_order(F.col("category")))
    return rows.orderBy("place")


PROFILE = """SELECT c_nationkey AS source, count(*) AS size, CASE c_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0 END AS rec, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS a,
    count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS f FROM customer GROUP BY c_nationkey"""


def profiles(spark, sf):
    rec = F.when(F.col("source") % 4 == 0, 1.0).when(F.col("source") % 4 == 1, 0.5).when(F.col("source") % 4 == 2, 0.25).otherwise(0.0)
    seg = b.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("source"), "c_mktsegment").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return seg.groupBy("source").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("slots")).withColumn("rec", rec)


@query("p41_source_profile", "source:i size:i label:s slots_am:i superflex:b",
       f"SELECT source, size, CASE WHEN rec >= 0.9 THEN 'PPR' WHEN rec >= 0.4 THEN 'Half PPR' WHEN rec > 0 THEN '0.25 PPR' ELSE 'Standard' END AS label, a + m AS slots_am, f > 15 AS superflex FROM ({PROFILE})")
def source_profile(spark, sf):
    p = profiles(spark, sf)
    return p.select("source", "size", fs.reception_label(F.col("rec")).alias("label"), fs.slot_group(F.col("slots"), ["BUILDING", "MACHINERY"]).alias("slots_am"),
                    (fs.slot_group(F.col("slots"), ["FURNITURE"]) > 15).alias("superflex"))


@query("a67_compatibility", "source:i compatible:b reasons:s",
       f"""SELECT source, size = 60 AND f <= 12 AND a BETWEEN 5 AND 20 AS compatible, concat_ws(',', CASE WHEN size <> 60 THEN 'size' END, CASE WHEN f > 12 THEN 'superflex' END, CASE WHEN NOT a BETWEEN 5 AND 20 THEN 'slots' END,
             CASE WHEN rec < 0.4 OR rec >= 0.9 THEN 'label' END) AS reasons FROM ({PROFILE})""")
def compatibility(spark, sf):
    """Hard reasons decide; a different scoring label is only noted."""
    p = profiles(spark, sf)
    a, f = fs.slot_group(F.col("slots"), ["BUILDING"]), fs.slot_group(F.col("slots"), ["FURNITURE"])
    hard = {"size": F.col("size") != 60, "superflex": f > 12, "slots": ~a.between(5, 20)}
    soft = {"label": fs.reception_label(F.col("rec")) != "Half PPR"}
    return p.select("source", (F.size(fs.reasons(hard)) == 0).alias("compatible"), F.array_join(F.concat(fs.reasons(hard), fs.reasons(soft)), ",").alias("reasons"))


@query("a68_usable_seasons", "source:i seasons:s",
       "SELECT source, string_agg(CAST(season AS VARCHAR), ',' ORDER BY season) AS seasons FROM (SELECT DISTINCT source, season FROM v_raw_bid WHERE status = 'EXECUTED' AND (source + season) % 3 <> 0) GROUP BY source")
def usable_seasons(spark, sf):
    rows = b.raw_bids(spark, sf).where((F.col("status") == "EXECUTED") & ((F.col("source") + F.col("season")) % 3 != 0))
    return rows.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("season")).cast("array<string>"), ",").alias("seasons"))


@query("p17_rule_templates", "season:i week:i entity:i category:s pts:d half:d",
       """WITH r AS (SELECT season, week, entity, category, CASE WHEN category = 'K' THEN 0 ELSE 0.1 * rushing_yards + 1.0 * receptions + 0.1 * receiving_yards END AS pts,
            CASE WHEN category = 'K' THEN 0 ELSE 0.1 * rushing_yards + 0.5 * receptions + floor(receiving_yards / 25) END AS half FROM v_perf)
          SELECT * FROM r WHERE category IN (SELECT category FROM r GROUP BY category HAVING max(abs(pts)) > 0)""")
def rule_templates(spark, sf):
    """Two rule sets from the default template, compiled over the same rows. Kickers' rows hold
    kicking stats only, of which there are none, so their category is not scored and is left out."""
    full = default_rules(1.0)
    half = default_rules(0.5, {"REY": 0.0, "REY25": 1.0})
    stats = ("rushing_yards", "receptions", "receiving_yards")
    rows = b.perf(spark, sf).withColumns({c: F.when(F.col("category") != "K", F.col(c)).otherwise(0.0) for c in stats})
    rows = with_stat_columns(rows, needed_columns([r[0] for r in full + half]))
    scored = rows.withColumn("pts", compile_rules(full)).withColumn("half", compile_rules(half))
    return scored.join(scored_categories(scored), "category", "left_semi")


_TEMPLATE = ", ".join(f"('{i}', {float(p)})" for i, p in default_rules(0.5))
_UNITS = sorted(known_items(True) & {i for i, _ in default_rules(0.5)})


@query("p17_rules_in_words", "source:i n_items:i words:s unused:s categories:s",
       f"""WITH t(item, points) AS (VALUES {_TEMPLATE}),
            o AS (SELECT n_nationkey AS source, 'REC' AS item, 1.0 AS points FROM nation WHERE n_nationkey % 3 = 0
              UNION ALL SELECT n_nationkey, unnest(['FG0', 'FG40', 'FG50', 'FG60', 'PAT']), 0.0 FROM nation WHERE n_nationkey % 4 = 0
              UNION ALL SELECT n_nationkey, unnest({_UNITS}), 0.0 FROM nation WHERE n_nationkey % 6 = 0
              UNION ALL SELECT n_nationkey, unnest(['XYZ', '2PRET']), 2.5 FROM nation WHERE n_nationkey % 5 = 0),
            r AS (SELECT n_nationkey AS source, t.item, coalesce(o.points, t.points) AS points FROM nation CROSS JOIN t LEFT JOIN o ON o.source = n_nationkey AND o.item = t.item
              UNION ALL SELECT source, item, points FROM o WHERE item NOT IN (SELECT item FROM t)),
            u AS (SELECT *, item NOT IN ('XYZ', '2PRET') AS usable FROM r WHERE points <> 0)
          SELECT source, count(*) FILTER (WHERE usable) AS n_items, coalesce(string_agg(item || ': ' || printf('%.3f', CAST(points AS DOUBLE)), '; ' ORDER BY item || ': ') FILTER (WHERE usable), '') AS words,
            coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE NOT usable), '') AS unused,
            'players' || CASE WHEN source % 4 = 0 THEN '' ELSE ',K' END || CASE WHEN source % 6 = 0 THEN '' ELSE ',DST' END AS categories
          FROM u GROUP BY source""")
def rules_of_sources(spark, sf):
    """Template and own points of each source, in words, and which categories they score."""
    n = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"))
    def own(every, items, points):
        return n.where(F.col("source") % every == 0).select("source", F.explode(F.array(*[F.lit(i) for i in items])).alias("item"), F.lit(points).alias("points"))
    none = n.select("source", F.lit(None).cast("string").alias("item"), F.lit(0.0).alias("points"))
    overrides = none.union(own(3, ["REC"], 1.0)).union(own(4, ["FG0", "FG40", "FG50", "FG60", "PAT"], 0.0)).union(own(6, _UNITS, 0.0)).union(own(5, ["XYZ", "2PRET"], 2.5))
    return rules_in_words(rules_by_source(default_rules(0.5), overrides))


@query("p02_season_category_filter", "season:i category:s n:i", "SELECT season, category, count(*) AS n FROM v_perf WHERE season IN (1999, 2000) AND category = 'WR' AND week <= 10 GROUP BY season, category")
def season_filter(spark, sf):
    rows = b.perf(spark, sf, [1999, 2000]).where((F.col("category") == "WR") & (F.col("week") <= 10))
    return rows.groupBy("season", "category").agg(F.count(F.lit(1)).alias("n"))


@query("p08_expected_columns", "season:i week:i entity:i carries:d receptions:d attempts:d", "SELECT season, week, entity, carries, receptions * 0.75 AS receptions, 0.0 AS attempts FROM v_perf")
def expected_columns(spark, sf):
    from rivalgrid.functions.expected import weekly_stat_rows
    rows = b.perf(spark, sf).select("season", "week", "entity", F.col("carries").alias("rush_attempt"), (F.col("receptions") * 0.75).alias("receptions_exp"))
    return weekly_stat_rows(rows, ["season", "week", "entity"])


@query("j31_period_index", "season:i week:i entity:i pts:d group_pts:d before:d",
       """SELECT p.season, p.week, p.entity, p.pts, sum(p.pts) OVER (PARTITION BY p.season, p.week, p.grp) AS group_pts, q.pts AS before FROM v_perf p LEFT JOIN v_perf q ON q.season = p.season AND q.week = p.week - 1 AND q.entity = p.entity""")
def period_index(spark, sf):
    """Stats by entity and week, group totals and the previous week, joined on their keys."""
    rows = b.perf(spark, sf)
    totals = rows.groupBy("season", "week", "grp").agg(F.sum("pts").alias("group_pts"))
    before = rows.select("season", (F.col("week") + 1).alias("week"), "entity", F.col("pts").alias("before"))
    return rows.join(totals, ["season", "week", "grp"]).join(before, ["season", "week", "entity"], "left")
