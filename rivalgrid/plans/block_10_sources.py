"""Readers, documents, settings, identity and text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalgrid.functions import text as tx
from rivalgrid.operators import identity as idt
from rivalgrid.operators.asof import in_interval
from rivalgrid.operators.grids import period_for_instant
from rivalgrid.operators.ranking import row_numbers_any_size
from rivalgrid.operators.usage import fill_gaps
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS
from rivalgrid.sources import documents as dc
from rivalgrid.sources import settings as st
from rivalgrid.sources import tables as tb


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


@query("s01_read_stats", "season:i n:i pts:d absent:d",
       "SELECT CAST(year(l_shipdate) AS INT) AS season, count(*) AS n, sum(l_quantity) AS pts, 0.0 AS absent FROM lineitem WHERE year(l_shipdate) IN (1996, 1997, 2030) GROUP BY 1")
def read_stats(spark, sf):
    """S01 to S08 share one reader: schema-driven, season list, absent columns, missing tables."""
    cols = "l_suppkey bigint, l_quantity double, l_shipdate timestamp, air_yards double"
    rows = tb.read_seasons(spark, f"{sf}/lineitem.parquet", schema(cols), [])
    later = tb.read_seasons(spark, f"{sf}/not_there_yet.parquet", schema(cols), [2031])
    rows = rows.unionByName(later).where(tb.in_years("l_shipdate", (1996, 1997, 2030))).withColumn("season", F.year("l_shipdate"))
    return rows.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("pts"), F.sum("air_yards").alias("absent"))


@query("s03_read_schedule_games", "season:i n:i", "SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS n FROM orders WHERE o_orderdate < DATE '1997-01-01' GROUP BY 1")
def read_games(spark, sf):
    rows = tb.read_seasons(spark, f"{sf}/orders.parquet", schema("o_orderkey bigint, o_orderdate timestamp, stadium string"), [])
    return rows.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("date")).groupBy(F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("s22_column_subset", "grp:s n:i total:d", "SELECT l_returnflag AS grp, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY l_returnflag")
def column_subset(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity")
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("p01_group_aliases", "nationkey:i grp:s n:i",
       "SELECT c_nationkey AS nationkey, CASE n_name WHEN 'NATION_3' THEN 'NATION_4' WHEN 'NATION_7' THEN 'NATION_8' ELSE n_name END AS grp, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def group_aliases(spark, sf):
    names = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("grp"))
    rows = b.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")).join(names, "nationkey")
    return tb.normalize_groups(rows, ["grp"], {"NATION_3": "NATION_4", "NATION_7": "NATION_8"}).groupBy("nationkey", "grp").agg(F.count(F.lit(1)).alias("n"))


# ---- documents: landed JSON derived from the tables -------------------------------------------

def ranking_docs(spark, sf):
    """One document per event type and day, as a ranking page would land; some in the wrong format, some broken."""
    ev = b.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    player = F.struct(F.col("event_id").alias("id"), F.concat(F.lit("P "), F.col("user_id").cast("string")).alias("name"), F.lit("T1").alias("team"),
                      F.col("value").alias("ecr"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("value").cast("string")).alias("avg"))
    pages = ev.groupBy(F.col("event_type").alias("page"), F.to_date("ts").alias("taken"), F.floor(F.col("event_id") / 256).alias("part")).agg(F.collect_list(player).alias("players"))
    body = F.to_json(F.struct(F.when(F.dayofmonth("taken") == 3, "STD").otherwise("HALF").alias("scoring"), "page", F.col("taken").cast("string").alias("taken"), "players"))
    return pages.select(F.when(F.dayofmonth("taken") == 4, F.substring(body, 1, 25)).otherwise(body).alias("body"))


RANKED = "SELECT event_type AS page, CAST(CAST(ts AS DATE) AS VARCHAR) AS taken, event_id AS id, value AS rank_ecr, CASE WHEN event_id % 4 <> 0 THEN value END AS rank_avg FROM events WHERE day(ts) NOT IN (3, 4)"


@query("s09_ranking_documents", "page:s taken:s id:i rank_ecr:d rank_avg:d", RANKED)
def rankings(spark, sf):
    return dc.ranking_rows(ranking_docs(spark, sf), "HALF")


@query("s10_ranking_fallback", "page:s id:i rank:i",
       f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY rank_ecr, id) AS rank FROM ({RANKED}) WHERE page IN ('view', 'click') AND taken >= '2024-01-20'")
def ranking_fallback(spark, sf):
    rows = dc.ranking_rows(ranking_docs(spark, sf), "HALF").where(F.col("page").isin("view", "click") & (F.col("taken") >= "2024-01-20"))
    return row_numbers_any_size(rows, ["page"], [F.col("rank_ecr").asc(), F.col("id").asc()])


def bid_docs(spark, sf):
    items = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    ids = F.struct(F.lit("ADD").alias("type"), F.col("l_partkey").alias("entity"))
    drop = F.struct(F.lit("DROP").alias("type"), F.col("l_suppkey").alias("entity"))
    moves = F.when(F.col("l_linenumber") == 7, F.array(drop)).otherwise(F.array(drop, ids, F.struct(F.lit("ADD").alias("type"), F.lit(-1).cast("long").alias("entity"))))
    t = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("team"), F.lit("WAIVER").alias("type"),
                 F.when(F.col("l_returnflag") == "N", "PENDING").otherwise("EXECUTED").alias("status"), F.floor("l_extendedprice").alias("bid"), moves.alias("items"))
    docs = items.groupBy(F.floor(F.col("l_orderkey") / 64).alias("part"), F.col("l_linenumber").alias("week")).agg(F.collect_list(t).alias("transactions"))
    return docs.select(F.to_json(F.struct("week", "transactions")).alias("body"))


@query("s14_bid_documents", "week:i id:i team:i entity:i bid:d dropped:s",
       """SELECT l_linenumber AS week, l_orderkey * 10 + l_linenumber AS id, l_suppkey AS team, l_partkey AS entity, floor(l_extendedprice) / 100.0 AS bid, CAST(l_suppkey AS VARCHAR) AS dropped
          FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 7""")
def bid_documents(spark, sf):
    rows = dc.bid_rows(bid_docs(spark, sf), cents=True)
    return rows.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


@query("s17_projection_documents", "entity:i week:i receptions:d receiving_yards:d",
       "SELECT o_orderkey AS entity, CAST(month(o_orderdate) AS INT) AS week, floor(o_totalprice / 10000) AS receptions, 0.0 AS receiving_yards FROM orders WHERE o_orderstatus <> 'P'")
def projections(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    stats = F.when(F.col("o_orderstatus") == "P", F.create_map(F.lit("adp"), F.lit(1.0))).otherwise(F.create_map(F.lit("rec"), F.floor(F.col("o_totalprice") / 10000).cast("double")))
    docs = o.select(F.to_json(F.struct(F.col("o_orderkey").alias("entity"), F.month("o_orderdate").alias("week"), stats.alias("stats"))).alias("body"))
    return dc.projection_rows(docs, {"rec": "receptions", "rec_yd": "receiving_yards"})


@query("s18_two_projection_sources", "season:i week:i entity:i pts:d",
       """SELECT season, week, entity, CASE WHEN entity % 2 = 0 AND week % 2 = 0 THEN pts * 2 ELSE pts END AS pts FROM v_perf WHERE entity % 3 <> 0 OR (entity % 2 = 0 AND week % 2 = 0)""")
def two_sources(spark, sf):
    rows = b.perf(spark, sf)
    first = rows.withColumn("pts", F.when(F.col("entity") % 3 != 0, F.col("pts")))
    second = rows.where((F.col("entity") % 2 == 0) & (F.col("week") % 2 == 0)).withColumn("pts", F.col("pts") * 2)
    return dc.later_source_wins(first, second, ["season", "week", "entity"], "pts")


@query("s20_return_dates", "custkey:i return_date:s week:n",
       """SELECT c_custkey AS custkey, CAST(d AS VARCHAR) AS return_date, (SELECT max(w) FROM (SELECT i AS w, DATE '1999-09-09' + CAST((i - 1) * 7 AS INT) AS s FROM range(1, 19) t(i)) WHERE s <= d) AS week
          FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN CAST(make_date(CASE WHEN m >= 8 THEN 1999 ELSE 2000 END, m, 1 + c_custkey % 28) AS DATE) END AS d FROM (SELECT c_custkey, 1 + c_custkey % 12 AS m FROM customer))""")
def return_dates(spark, sf):
    """Month-day text to a date of the season, then its week."""
    month = F.element_at(F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]), (1 + F.col("c_custkey") % 12).cast("int"))
    text = F.when(F.col("c_custkey") % 11 == 0, "soon").otherwise(F.concat_ws(" ", month, (1 + F.col("c_custkey") % 28).cast("string")))
    rows = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), text.alias("t")).select(
        "custkey", tx.month_day_in_season(F.col("t"), F.lit(1999)).alias("return_date"), F.lit(1999).alias("season"))
    starts = spark.range(1, 19).select(F.col("id").cast("int").alias("week"), F.lit(1999).alias("season"), F.date_add(F.lit("1999-09-09").cast("date"), ((F.col("id") - 1) * 7).cast("int")).alias("start"))
    return period_for_instant(rows, starts, ["season"], "return_date", "start", "week")


SLOT_NAMES = {"BUILDING": ["QB"], "MACHINERY": ["RB"], "FURNITURE": ["WR"], "HOUSEHOLD": ["TE"], "AUTOMOBILE": ["RB", "WR", "TE"]}


@query("s29_settings_documents", "source:i slot:s n:i categories:s",
       """SELECT c_nationkey AS source, c_mktsegment AS slot, count(*) AS n, CASE c_mktsegment WHEN 'BUILDING' THEN 'QB' WHEN 'MACHINERY' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' WHEN 'HOUSEHOLD' THEN 'TE' ELSE 'RB,WR,TE' END AS categories
          FROM customer GROUP BY 1, 2""")
def settings_documents(spark, sf):
    seg = b.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("int").alias("n"))
    docs = seg.groupBy("c_nationkey").agg(F.map_concat(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))), F.create_map(F.lit("GHOST"), F.lit(0))).alias("slots"))
    body = F.to_json(F.struct(F.col("c_nationkey").alias("source"), F.lit(16).alias("roster_size"), "slots", F.array().cast("array<struct<item:string,points:double>>").alias("scoring")))
    return dc.settings_rows(docs.select(body.alias("body")), SLOT_NAMES).withColumn("categories", F.array_join("categories", ","))


@query("s29_scoring_items", "source:i item:s points:d",
       "SELECT c_nationkey AS source, c_mktsegment AS item, count(*) / 8.0 AS points FROM customer GROUP BY 1, 2")
def scoring_items(spark, sf):
    seg = b.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.count(F.lit(1)) / 8.0).alias("points"))
    items = F.collect_list(F.struct(F.col("c_mktsegment").alias("item"), "points"))
    docs = seg.groupBy("c_nationkey").agg(items.alias("scoring"))
    body = F.to_json(F.struct(F.col("c_nationkey").alias("source"), F.lit(16).alias("roster_size"), F.create_map(F.lit("GHOST"), F.lit(0)).alias("slots"), "scoring"))
    bad = docs.select(F.concat(F.lit("not a document "), F.col("c_nationkey").cast("string")).alias("body"))
    return dc.scoring_rows(docs.select(body.alias("body")).unionByName(bad))


@query("s30_ownership_changes", "entity:i change:d",
       "SELECT l_orderkey AS entity, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE count(*) / 4.0 END AS change FROM lineitem GROUP BY l_orderkey")
def ownership_documents(spark, sf):
    """Change in ownership; a document without one counts as unchanged."""
    rows = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("entity")).agg((F.count(F.lit(1)) / 4.0).alias("change"))
    change = F.when(F.col("entity") % 3 != 0, F.col("change")).alias("change")
    return dc.ownership_changes(rows.select(F.to_json(F.struct("entity", F.lit("FREEAGENT").alias("status"), change)).alias("body")))


@query("s30_waiver_documents", "entity:i clears:s label:s",
       """SELECT l_orderkey AS entity, strftime(max(l_shipdate), '%Y-%m-%d %H:%M') AS clears,
            'waivers, free ' || strftime(timezone('America/New_York', timezone('UTC', max(l_shipdate))), '%a') AS label FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def waiver_documents(spark, sf):
    rows = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("entity"), (F.col("l_returnflag") == "R").alias("r")).agg(F.max("l_shipdate").alias("d"))
    body = F.to_json(F.struct("entity", F.when(F.col("r"), "WAIVERS").otherwise("FREEAGENT").alias("status"), F.unix_millis(F.col("d").cast("timestamp")).alias("clears"), F.lit(0.5).alias("change")))
    out = dc.waiver_rows(rows.select(body.alias("body")))
    return out.withColumns({"clears": F.date_format("clears_at", "yyyy-MM-dd HH:mm"), "label": tx.waiver_label(F.lit(True), F.col("clears_at"))})


def roster_docs(spark, sf):
    s = b.table(spark, sf, "supplier")
    p = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), b.category_of(F.col("s_suppkey")).alias("position"),
                 F.when(F.col("s_acctbal") < 500, "OUT").alias("status"), F.when(F.col("s_suppkey") % 2 == 0, "FLEX").alias("slot"))
    docs = s.groupBy(F.col("s_nationkey").alias("team"), F.floor(F.col("s_suppkey") / 200).alias("part")).agg(F.collect_list(p).alias("players"))
    return docs.select(F.to_json(F.struct("team", F.lit("x").alias("name"), "players")).alias("body"))


@query("s31_roster_documents", "team:i entity:i position:s status:s slot:s reserve:b",
       """SELECT s_nationkey AS team, s_suppkey AS entity, CASE s_suppkey % 5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'K' END AS position,
            CASE WHEN s_acctbal < 500 THEN 'OUT' ELSE 'ACTIVE' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'FLEX' ELSE 'BE' END AS slot, s_acctbal < 500 AS reserve FROM supplier""")
def roster_documents(spark, sf):
    """S31, P29."""
    return dc.roster_rows(roster_docs(spark, sf)).withColumn("reserve", tx.reserve_eligible(F.col("status")))


@query("j33_owned_and_free", "team:n n:i", "SELECT CASE WHEN s_nationkey < 20 THEN s_nationkey END AS team, count(*) AS n FROM supplier GROUP BY 1")
def owned_and_free(spark, sf):
    rows = dc.roster_rows(roster_docs(spark, sf)).withColumn("owner", F.when(F.col("team") < 20, F.col("team")))
    free = rows.where(F.col("owner").isNull()).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    owned = rows.where(F.col("owner").isNotNull()).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return owned.unionByName(free).withColumnRenamed("owner", "team")


@query("j34_actual_starters", "team:i slot:s pos:i entity:i projected:d",
       """SELECT s_nationkey AS team, CASE s_suppkey % 3 WHEN 0 THEN 'FLEX' ELSE 'RB' END AS slot, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 = 0 ORDER BY coalesce(p, s_acctbal / 100, 0) DESC, s_suppkey) AS pos,
            s_suppkey AS entity, coalesce(p, s_acctbal / 100, 0) AS projected FROM (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal END AS p FROM supplier WHERE s_suppkey % 2 = 0)""")
def actual_starters(spark, sf):
    """Starters numbered in their slot by the first known of three projections."""
    p = F.coalesce(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal")), F.col("s_acctbal") / 100, F.lit(0.0))
    raw = F.when(F.col("s_suppkey") % 3 == 0, "RB/WR/TE").otherwise("RB")
    rows = b.table(spark, sf, "supplier").where(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_nationkey").alias("team"), F.col("s_suppkey").alias("entity"), tx.slot_label(raw, {"RB/WR/TE": "FLEX"}).alias("slot"), p.alias("projected"))
    return row_numbers_any_size(rows, ["team", "slot"], [F.col("projected").desc(), F.col("entity").asc()], "pos")


@query("s19_past_lineups", "period:i team:i place:i entity:i slot:s pts:d",
       """SELECT *, row_number() OVER (PARTITION BY period, team ORDER BY pts DESC, entity) AS place, CASE entity % 3 WHEN 0 THEN 'FLEX' ELSE 'RB' END AS slot FROM (
            SELECT CAST(l_linenumber AS INT) AS period, l_suppkey AS team, l_partkey AS entity, sum(l_quantity) AS pts FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2, 3)""")
def past_lineups(spark, sf):
    """Match documents with nested line-ups, read back to keyed rows by position."""
    items = b.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("period"), F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("entity")).agg(F.sum("l_quantity").alias("pts"))
    placed = row_numbers_any_size(items, ["period", "team"], [F.col("pts").desc(), F.col("entity").asc()], "place")
    slot = F.when(F.col("entity") % 3 == 0, "FLEX").otherwise("RB")
    bodies = dc.lineup_documents(placed.withColumns({"match": F.floor(F.col("team") / 2), "slot": slot}))
    return dc.lineup_rows(bodies, 6)


@query("s32_match_documents", "period:i home:i away:i home_score:d away_score:d",
       "SELECT s.season * 100 + s.week AS period, s.grp AS home, s.opp AS away, CASE WHEN s.season * 100 + s.week < 200005 THEN s.pf END AS home_score, CASE WHEN s.season * 100 + s.week < 200005 THEN a.pf END AS away_score FROM v_score s JOIN v_score a ON a.season = s.season AND a.week = s.week AND a.grp = s.opp WHERE s.home")
def match_documents(spark, sf):
    """Every season's periods, numbered season * 100 + week; the fifth week of 2000 is the current one."""
    s = b.scores(spark, sf)
    away = s.select("season", "week", F.col("grp").alias("opp"), F.col("pf").alias("away_score"))
    m = s.where("home").join(away, ["season", "week", "opp"])
    bye = F.array(F.struct(F.lit(0).cast("long").alias("home"), F.lit(None).cast("long").alias("away"), F.lit(1.0).alias("home_score"), F.lit(None).cast("double").alias("away_score")))
    entry = F.struct(F.col("grp").cast("long").alias("home"), F.col("opp").cast("long").alias("away"), F.col("pf").alias("home_score"), "away_score")
    docs = m.groupBy((F.col("season") * 100 + F.col("week")).alias("period")).agg(F.concat(F.collect_list(entry), F.first(bye)).alias("matches"))
    return dc.match_rows(docs.select(F.to_json(F.struct("period", "matches")).alias("body")), 200005)


# ---- settings ---------------------------------------------------------------------------------

VIEWS["v_setting"] = """
    SELECT 'n' || c_nationkey AS league_slug, key, arg_max(value, c_custkey) AS value FROM (
      SELECT c_nationkey, c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'dampening' WHEN 1 THEN 'streaming' WHEN 2 THEN 'mystery' WHEN 3 THEN 'seed_1_division_priority' WHEN 4 THEN 'seed_1_tiebreak_2'
        WHEN 5 THEN 'seed_2_tiebreak_1' WHEN 6 THEN 'seed_1_tiebreak_1' ELSE 'title' END AS key,
        CASE c_custkey % 8 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE CAST(c_custkey AS VARCHAR) END WHEN 1 THEN 'yes' WHEN 3 THEN CASE WHEN c_custkey % 3 = 0 THEN 'TRUE' ELSE 'no' END ELSE c_mktsegment END AS value FROM customer) GROUP BY 1, 2"""


def setting_rows(spark, sf):
    k = F.col("c_custkey") % 8
    keys = ("dampening", "streaming", "mystery", "seed_1_division_priority", "seed_1_tiebreak_2", "seed_2_tiebreak_1", "seed_1_tiebreak_1", "title")
    value = F.when(k == 0, F.when(F.col("c_custkey") % 3 == 0, "high").otherwise(F.col("c_custkey").cast("string"))).when(k == 1, "yes").when(
        k == 3, F.when(F.col("c_custkey") % 3 == 0, "TRUE").otherwise("no")).otherwise(F.col("c_mktsegment"))
    rows = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_no"), F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("league_slug"),
        F.element_at(F.array(*[F.lit(x) for x in keys]), (k + 1).cast("int")).alias("key"), F.concat(value, F.lit("  ")).alias("value"))
    sheet = tb.scratch(spark, "settings")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(sheet)
    landed = st.read_settings(spark, sheet)
    return st.latest_settings(landed.withColumn("row_no", F.col("row_no").cast("long")), "row_no")


@query("s11_settings_sheet", "league_slug:s key:s value:s", "SELECT * FROM v_setting")
def settings_sheet(spark, sf):
    return setting_rows(spark, sf)


DEFAULTS = [("dampening", "number", "0.5"), ("streaming", "flag", "false"), ("title", "text", "none"), ("weeks", "number", "17")]


@query("s12_apply_settings", "league_slug:s key:s value:s overridden:b",
       """SELECT t.league_slug, d.key, coalesce(s.value, d.value) AS value, s.value IS NOT NULL AS overridden FROM (SELECT DISTINCT league_slug FROM v_setting) t
          CROSS JOIN (VALUES ('dampening', '0.5'), ('streaming', 'false'), ('title', 'none'), ('weeks', '17')) d(key, value)
          LEFT JOIN (SELECT * FROM v_setting WHERE key <> 'dampening' OR TRY_CAST(value AS DOUBLE) IS NOT NULL) s ON s.league_slug = t.league_slug AND s.key = d.key""")
def apply_settings(spark, sf):
    return st.apply_settings(setting_rows(spark, sf), spark.createDataFrame(DEFAULTS, "key string, kind string, value string"))[0]


@query("s12_ignored_settings", "league_slug:s key:s value:s reason:s",
       """SELECT league_slug, key, value, CASE WHEN key = 'dampening' THEN 'bad value' ELSE 'unknown key' END AS reason FROM v_setting
          WHERE key NOT IN ('dampening', 'streaming', 'title') OR (key = 'dampening' AND TRY_CAST(value AS DOUBLE) IS NULL)""")
def ignored_settings(spark, sf):
    return st.apply_settings(setting_rows(spark, sf), spark.createDataFrame(DEFAULTS, "key string, kind string, value string"))[1]


@query("s13_seeding_rules", "league_slug:s seed:i division_priority:b tiebreaks:s",
       """SELECT league_slug, CAST(key[6:6] AS INT) AS seed, coalesce(bool_or(lower(value) IN ('true', '1', 'yes', 'y', 't')) FILTER (WHERE key LIKE '%division_priority'), FALSE) AS division_priority,
            coalesce(string_agg(value, ',' ORDER BY key) FILTER (WHERE key LIKE '%tiebreak%'), '') AS tiebreaks FROM v_setting WHERE key LIKE 'seed_%' GROUP BY 1, 2""")
def seeding_rules(spark, sf):
    """S13, F05."""
    return st.seeding_rules(setting_rows(spark, sf)).withColumn("tiebreaks", F.array_join("tiebreaks", ","))


# ---- sinks ------------------------------------------------------------------------------------

@query("s24_tenant_overwrite", "source:i origin:s n:i",
       "SELECT source, CASE WHEN source % 4 = 1 THEN 'second' ELSE 'first' END AS origin, count(*) AS n FROM v_raw_bid GROUP BY 1, 2")
def tenant_overwrite(spark, sf):
    """The second run only brings some tenants; the others keep the first run's output."""
    rows = b.raw_bids(spark, sf).groupBy("source", "season", "week").agg(F.count(F.lit(1)).alias("n"))
    path = tb.scratch(spark, "outputs")
    tb.write_tenant_tables(rows.withColumn("origin", F.lit("first")), path, "source")
    tb.write_tenant_tables(rows.where(F.col("source") % 4 == 1).withColumn("origin", F.lit("second")), path, "source")
    return spark.read.parquet(path).groupBy("source", "origin").agg(F.sum("n").alias("n"))


@query("s25_csv_export", "season:i grp:i pts:d", "SELECT season, grp, sum(pts) AS pts FROM v_points GROUP BY season, grp")
def csv_export(spark, sf):
    path = tb.scratch(spark, "csv")
    tb.write_csv(b.perf(spark, sf).groupBy("season", "grp").agg(F.sum("pts").alias("pts")), path, ["season", "grp"])
    return spark.read.option("header", True).schema("season int, grp int, pts double").csv(path)


@query("s26_training_export", "season:i n:i bid:d", "SELECT season, count(*) AS n, sum(bid) AS bid FROM v_bids GROUP BY season")
def training_export(spark, sf):
    path = tb.scratch(spark, "training")
    tb.write_training_table(b.bids(spark, sf).drop("tid"), path)
    return spark.read.parquet(path).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("bid").alias("bid"))


@query("s27_slim_history", "source:i season:i entity:i n:i first_category:s budget:d",
       """SELECT source, season, entity, count(*) AS n, arg_min(category, tid) AS first_category, any_value(budget) AS budget FROM v_bids LEFT JOIN v_budget USING (source, season) GROUP BY source, season, entity""")
def slim_history(spark, sf):
    rows = b.bids(spark, sf)
    slim = rows.groupBy("source", "season", "entity").agg(F.count(F.lit(1)).alias("n"), F.min_by("category", "tid").alias("first_category"))
    return slim.join(b.budgets(spark, sf, rows), ["source", "season"], "left")


# ---- identity, text, time ---------------------------------------------------------------------

VIEWS["v_record"] = """SELECT c_custkey AS main_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 7 END AS alt_id, 'D''Cust. ' || (c_custkey // CASE WHEN c_custkey % 10 < 2 THEN 2 ELSE 1 END) || ' Jr.' AS name,
    c_mktsegment[1:2] AS category FROM customer"""
VIEWS["v_request"] = """SELECT o_orderkey AS req, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS main_id, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey * 7 END AS alt_id,
    CASE WHEN o_orderkey % 4 >= 2 AND o_orderkey % 9 <> 0 THEN 'DCUST  ' || o_custkey END AS name, c_mktsegment[1:2] AS category FROM orders JOIN customer ON o_custkey = c_custkey"""
NORM = "regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[.''`,]', '', 'g'), '\\s+', ' ', 'g')), '^(.+) (jr|sr|ii|iii|iv|v)$', '\\1')"
VIEWS["v_cross"] = f"""SELECT name_key, category, main_id, alt_id FROM (SELECT *, count(DISTINCT main_id) OVER (PARTITION BY name_key, category) AS n FROM (SELECT *, {NORM} AS name_key FROM v_record))
    QUALIFY n = 1 AND row_number() OVER (PARTITION BY name_key, category ORDER BY main_id) = 1"""


def records(spark, sf):
    k = F.col("c_custkey")
    half = F.when(k % 10 < 2, 2).otherwise(1)
    name = F.concat(F.lit("D'Cust. "), F.floor(k / half).cast("string"), F.lit(" Jr."))
    return b.table(spark, sf, "customer").select(k.alias("main_id"), F.when(k % 2 == 0, k * 7).alias("alt_id"), name.alias("name"), F.substring("c_mktsegment", 1, 2).alias("category"))


def requests(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.substring("c_mktsegment", 1, 2).alias("category"))
    i, k = F.col("o_orderkey"), F.col("o_custkey")
    return o.join(c, "o_custkey").select(
        i.alias("req"), F.when(i % 4 == 0, k).alias("main_id"), F.when(i % 4 == 1, k * 7).alias("alt_id"),
        F.when((i % 4 >= 2) & (i % 9 != 0), F.concat(F.lit("DCUST  "), k.cast("string"))).alias("name"), "category")


@query("f01_merge_name", "main_id:i name_key:s", f"SELECT main_id, {NORM} AS name_key FROM v_record")
def merged_names(spark, sf):
    return records(spark, sf).withColumn("name_key", tx.merge_name(F.col("name")))


@query("j06_build_crosswalk", "name_key:s category:s main_id:i alt_id:n", "SELECT * FROM v_cross")
def build_crosswalk(spark, sf):
    return idt.crosswalk(records(spark, sf), ["main_id", "alt_id"])


RESOLVED = f"""SELECT r.req, coalesce(CAST(coalesce(m.main_id, a.main_id, x.main_id) AS VARCHAR), CASE WHEN r.main_id IS NOT NULL THEN 'main_id:' || r.main_id WHEN r.alt_id IS NOT NULL THEN 'alt_id:' || r.alt_id
      WHEN r.name IS NOT NULL THEN 'unmapped:' || {NORM.replace('lower(name)', 'lower(r.name)')} || ':' || r.category END, 'unmapped:unknown') AS resolved,
    CASE WHEN m.main_id IS NOT NULL THEN 'main_id' WHEN a.main_id IS NOT NULL THEN 'alt_id' WHEN x.main_id IS NOT NULL THEN 'name' ELSE 'unmapped' END AS resolved_by
    FROM v_request r LEFT JOIN v_record m ON m.main_id = r.main_id LEFT JOIN v_record a ON a.alt_id = r.alt_id
    LEFT JOIN v_cross x ON x.name_key = {NORM.replace('lower(name)', 'lower(r.name)')} AND x.category = r.category"""


@query("j05_resolve_identity", "req:i resolved:s resolved_by:s", RESOLVED)
def resolve_identity(spark, sf):
    return idt.resolve(requests(spark, sf), records(spark, sf), ["main_id", "alt_id"], "main_id")


@query("j30_ranks_by_id", "resolved:s req:i", f"SELECT resolved, max(req) AS req FROM ({RESOLVED}) GROUP BY resolved")
def ranks_by_id(spark, sf):
    rows = idt.resolve(requests(spark, sf), records(spark, sf), ["main_id", "alt_id"], "main_id").select("resolved", "req", F.col("req").alias("o"))
    return idt.ranks_by_id(rows, "o")


@query("f03_url_class", "page_id:i segment:s class:s",
       """SELECT page_id, segment, CASE WHEN regexp_matches(segment, 'snow') THEN 'Snow' WHEN regexp_matches(segment, 'sleet|fzra') THEN 'Wintry Mix' WHEN regexp_matches(segment, 'tsra') THEN 'Thunderstorm' WHEN regexp_matches(segment, 'rain') THEN 'Rain' END AS class
          FROM (SELECT page_id, lower(split_part(split_part(list_extract(string_split(u, '/'), -1), '?', 1), ',', 1)) AS segment FROM (
            SELECT page_id, split_part(url, '?', 1) || CASE page_id % 5 WHEN 0 THEN '/night/snow,20' WHEN 1 THEN '/RAIN_showers,40' WHEN 2 THEN '/tsra_hi' WHEN 3 THEN '/fzra,1' ELSE '' END || '?size=small' AS u FROM pages))""")
def url_class(spark, sf):
    extra = F.element_at(F.array(*[F.lit(x) for x in ("/night/snow,20", "/RAIN_showers,40", "/tsra_hi", "/fzra,1", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.concat(F.split("url", r"\?")[0], extra, F.lit("?size=small"))
    return b.table(spark, sf, "pages").select("page_id", tx.last_segment(url).alias("segment"), tx.weather_class(url).alias("class"))


@query("f04_season_list", "custkey:i season:i",
       "SELECT c_custkey AS custkey, CAST(unnest(list_sort(list_distinct(list_concat(range(2000 + c_custkey % 5, 2003 + c_custkey % 5), [2004 + c_custkey % 3])))) AS INT) AS season FROM customer")
def season_list(spark, sf):
    k = F.col("c_custkey")
    spec = F.concat((2000 + k % 5).cast("string"), F.lit("-"), (2002 + k % 5).cast("string"), F.lit(", "), (2004 + k % 3).cast("string"))
    return b.table(spark, sf, "customer").select(k.alias("custkey"), F.explode(tx.season_list(spec)).alias("season"))


@query("f07_display_name", "custkey:i owner:s",
       "SELECT c_custkey AS custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' ' || c_mktsegment WHEN 1 THEN c_mktsegment WHEN 2 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS owner FROM customer")
def display_names(spark, sf):
    k = F.col("c_custkey") % 4
    first, last = F.when(k == 0, F.col("c_name")), F.when(k <= 1, F.col("c_mktsegment")).otherwise(" ")
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), tx.display_name(first, last, F.when(k == 2, F.col("c_name")).otherwise(""), F.col("c_custkey")).alias("owner"))


@query("d01_local_to_utc", "orderkey:i utc:s",
       "SELECT o_orderkey AS orderkey, strftime(timezone('UTC', timezone('America/New_York', o_orderdate + INTERVAL (13 + o_orderkey % 9) HOUR)), '%Y-%m-%d %H:%M') AS utc FROM orders")
def local_to_utc(spark, sf):
    day, time = F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("%02d:00", 13 + F.col("o_orderkey") % 9)
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.date_format(tx.local_to_utc(day, time), "yyyy-MM-dd HH:mm").alias("utc"))


@query("d03_zoned_text", "event_id:i utc:s",
       "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(timezone('UTC', timezone('America/New_York', date_trunc('second', ts))), '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM events")
def zoned_text(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, " <html>").otherwise(" EST"))
    return b.table(spark, sf, "events").select("event_id", F.date_format(tx.zoned_to_utc(text), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query("d04_freshness", "grp:i fresh:b",
       "SELECT user_id AS grp, bool_or(ts > TIMESTAMP '2024-01-30 18:00:00') AS fresh FROM events GROUP BY user_id")
def freshness(spark, sf):
    """Any watched source newer than the baseline."""
    return b.table(spark, sf, "events").groupBy(F.col("user_id").alias("grp")).agg(F.max(F.col("ts") > F.lit("2024-01-30 18:00:00").cast("timestamp")).alias("fresh"))


@query("j16_interval_join", "event_id:i span:i",
       "SELECT event_id, span FROM events JOIN (SELECT c_custkey AS span, c_custkey % 150 AS u, TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 28) DAY AS s FROM customer) x ON x.u = user_id AND ts >= s AND ts < s + INTERVAL 36 HOUR")
def interval_join(spark, sf):
    day = (F.col("c_custkey") % 28).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp")
    spans = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("span"), (F.col("c_custkey") % 150).alias("user_id"), start.alias("s"), (start + F.expr("INTERVAL 36 HOURS")).alias("e"))
    return in_interval(b.table(spark, sf, "events").select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", "s", "e", ["span"])


@query("j23_status_overlay", "season:i week:i entity:i status:s",
       """SELECT season, week, entity, coalesce(CASE WHEN carries > 1 THEN 'report' END, 'reserve') AS status FROM (SELECT * FROM v_perf WHERE carries > 1 OR receptions > 0)""")
def status_overlay(spark, sf):
    rows, keys = b.perf(spark, sf), ["season", "week", "entity"]
    reports = rows.where(F.col("carries") > 1).select(*keys, F.lit("report").alias("status"))
    reserves = rows.where(F.col("receptions") > 0).select(*keys, F.lit("reserve").alias("status"))
    return fill_gaps(reports, reserves, keys, "status")


@query("p42_value_constraints", "custkey:i ok:b",
       """SELECT c_custkey AS custkey, CASE c_custkey % 4 WHEN 0 THEN v BETWEEN 4 AND 6 WHEN 1 THEN v <> -2 WHEN 2 THEN v = 0.5 ELSE TRUE END AS ok FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 5 ELSE -2 END AS v FROM customer)""")
def constraints(spark, sf):
    k = F.col("c_custkey")
    comment = F.element_at(F.array(*[F.lit(x) for x in ("Only include leagues with 4-6", "Exclude leagues with -2", "only include leagues with 0.5", "fine as is")]), (k % 4 + 1).cast("int"))
    rows = b.table(spark, sf, "customer").select(k.alias("custkey"), comment.alias("c"), F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 5.0).otherwise(-2.0).alias("v"))
    return rows.withColumns(tx.value_constraint(F.col("c"))).withColumn("ok", tx.meets_constraint(F.col("v"), F.col("constraint_kind"), F.col("constraint_low"), F.col("constraint_high")))
