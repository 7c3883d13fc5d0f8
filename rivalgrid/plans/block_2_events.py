"""Auction events: cleaning, budgets, promotion, consolidation, availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.operators import events as ev
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS
from rivalgrid.session import cut_lineage

CAT = "CASE {} % 5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'K' END"
TID = "tid.l_orderkey AS k1, tid.l_linenumber AS k2, tid.l_partkey AS k3, tid.l_suppkey AS k4"
TID_SPEC = "k1:i k2:i k3:i k4:i"
PRIORITY = "CASE signal WHEN 'won' THEN 0 WHEN 'outbid' THEN 1 WHEN 'other_failure' THEN 2 WHEN 'no_bid' THEN 3 ELSE 99 END"

VIEWS.update({
    "v_raw_bid": f"""
        SELECT c_nationkey AS source, season, week, l_partkey // 100 AS entity, l_suppkey AS team,
               {CAT.format('(l_partkey // 100)')} AS category,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'FREEAGENT' ELSE 'WAIVER' END AS kind,
               CASE l_returnflag WHEN 'R' THEN 'EXECUTED' WHEN 'A' THEN 'OUTBID' ELSE 'INVALID' END AS status,
               floor(l_extendedprice / 250.0) / 4.0 AS bid,
               CASE WHEN l_linenumber <> 7 THEN CAST(l_orderkey AS VARCHAR) END AS txn,
               {{'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey,
                 'l_extendedprice': l_extendedprice, 'l_shipdate': l_shipdate}} AS tid
        FROM v_order_item JOIN customer ON o_custkey = c_custkey""",
    "v_bids": """
        SELECT *, CASE WHEN signal <> 'won' THEN 0.0 WHEN kind = 'FREEAGENT' THEN CASE WHEN source = 0 THEN 2.0 ELSE 0.0 END ELSE bid END AS cost
        FROM (SELECT *, CASE status WHEN 'EXECUTED' THEN 'won' WHEN 'OUTBID' THEN 'outbid' ELSE 'other_failure' END AS signal,
                     count(*) OVER (PARTITION BY source, season, week, team, entity) - 1 AS variants_dropped
              FROM v_raw_bid
              QUALIFY row_number() OVER (PARTITION BY source, season, week, team, entity
                ORDER BY status <> 'EXECUTED', CASE WHEN status <> 'EXECUTED' THEN -bid ELSE 0 END, tid) = 1)""",
    "v_budget": """
        SELECT source, season, CASE WHEN source = 0 AND season <= 1998 THEN spend / size
               WHEN (source + season) % 3 <> 0 THEN 1000.0 + 10 * source ELSE 800.0 + source END AS budget
        FROM (SELECT source, season, 8 + source % 5 AS size, sum(CASE WHEN txn IN ('7', '14') THEN 0 ELSE cost END) AS spend FROM v_bids GROUP BY source, season)""",
    "v_event_facts": """
        SELECT source, season, week, entity, count(*) FILTER (WHERE signal IN ('won', 'outbid')) AS n_bids,
               max(bid) FILTER (WHERE signal = 'won') AS win_bid, max(bid) FILTER (WHERE signal = 'outbid') AS runner_up
        FROM v_bids WHERE kind = 'WAIVER' GROUP BY source, season, week, entity""",
    "v_full": """
        SELECT b.*, budget, CASE WHEN budget > 0 THEN bid / budget END AS pct,
               CASE WHEN signal IN ('won', 'outbid') THEN signal ELSE 'failed' END AS signal3,
               CASE WHEN kind = 'WAIVER' AND signal IN ('won', 'outbid') THEN n_bids END AS n_bids,
               CASE WHEN kind = 'WAIVER' AND signal IN ('won', 'outbid') THEN win_bid END AS win_bid,
               CASE WHEN kind = 'WAIVER' AND signal IN ('won', 'outbid') THEN runner_up END AS runner_up
        FROM v_bids b LEFT JOIN v_budget USING (source, season) LEFT JOIN v_event_facts USING (source, season, week, entity)""",
    "v_train": "SELECT * FROM v_full WHERE kind <> 'FREEAGENT' AND (txn IS NULL OR txn NOT IN ('7', '14'))",
    "v_promoted": """
        SELECT *, FALSE AS synthetic FROM v_train
        UNION ALL BY NAME
        SELECT * REPLACE ('won' AS signal, bid AS cost), TRUE AS synthetic FROM (
          SELECT * FROM v_train WHERE signal = 'other_failure'
          QUALIFY row_number() OVER (PARTITION BY source, season, week, entity ORDER BY bid DESC, tid) = 1) f
        WHERE NOT EXISTS (SELECT 1 FROM v_train r WHERE r.signal IN ('won', 'outbid') AND r.source = f.source
          AND r.season = f.season AND r.week = f.week AND r.entity = f.entity)""",
    "v_deduped": f"""
        SELECT * FROM v_promoted
        QUALIFY row_number() OVER (PARTITION BY source, season, week, entity ORDER BY {PRIORITY}, synthetic, tid) = 1""",
    "v_rostered": "SELECT DISTINCT source, season, week + 1 AS week, entity FROM v_bids WHERE signal = 'won'",
    "v_part_perf": f"""
        SELECT *, {CAT.format('entity')} AS category, CAST(entity % 2 AS INT) AS grp, 0.25 * snaps + 0.0625 * yards AS pts
        FROM (SELECT season, week, l_partkey // 100 AS entity, CAST(count(*) AS DOUBLE) AS snaps,
                CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS carries, sum(l_quantity) AS yards
              FROM v_order_item GROUP BY season, week, entity)""",
    "v_prices": """
        SELECT season, week, entity, any_value(category) AS category, count(*) AS n_rows, count(DISTINCT source) AS n_sources,
               avg(target) AS mean_target, quantile_cont(target, 0.5) AS target
        FROM (SELECT *, CASE WHEN budget > 0 THEN cost / budget ELSE 0 END AS target FROM v_promoted WHERE signal = 'won')
        GROUP BY season, week, entity""",
})


def with_tid(df):
    return df.select("*", *[F.col(f"tid.{f}").alias(k) for f, k in (
        ("l_orderkey", "k1"), ("l_linenumber", "k2"), ("l_partkey", "k3"), ("l_suppkey", "k4"))])


@query("a39_collapse_variants", f"source:i season:i week:i team:i entity:i status:s bid:d variants_dropped:i {TID_SPEC}",
       f"SELECT source, season, week, team, entity, status, bid, variants_dropped, {TID} FROM v_bids")
def collapse(spark, sf):
    return with_tid(b.described(ev.collapse_variants(b.claims(spark, sf))))


@query("p18_classify_bids", f"source:i season:i week:i entity:i kind:s signal:s cost:d {TID_SPEC}",
       f"SELECT source, season, week, entity, kind, signal, cost, {TID} FROM v_bids")
def classify(spark, sf):
    return with_tid(b.bids(spark, sf))


@query("p19_recode_signal", "source:i season:i signal3:s n:i",
       "SELECT source, season, signal3, count(*) AS n FROM v_full GROUP BY source, season, signal3")
def recode(spark, sf):
    rows = b.bids(spark, sf).withColumn("signal3", ev.recode_signal())
    return rows.groupBy("source", "season", "signal3").agg(F.count(F.lit(1)).alias("n"))


def trainable(spark, sf):
    return ev.trainable(b.priced_bids(spark, sf), b.CATEGORIES, b.BAD_IDS)


@query("p03_trainable_rows", f"source:i season:i week:i entity:i signal:s txn:s {TID_SPEC}",
       f"SELECT source, season, week, entity, signal, txn, {TID} FROM v_train")
def train_rows(spark, sf):
    """Null-safe NOT IN: rows without an id stay."""
    return with_tid(ev.trainable(b.bids(spark, sf), b.CATEGORIES, b.BAD_IDS))


@query("a29_competing_bidders", "source:i season:i week:i entity:i n_bidders:i",
       "SELECT source, season, week, entity, count(DISTINCT team) AS n_bidders FROM v_bids WHERE kind = 'WAIVER' GROUP BY source, season, week, entity")
def bidders(spark, sf):
    return ev.competing_bidders(b.bids(spark, sf))


@query("a30_spend_shares", "source:i season:i team:i team_spend:d source_spend:d share:d",
       """SELECT *, CASE WHEN source_spend > 0 THEN team_spend / source_spend END AS share FROM (
            SELECT source, season, team, sum(cost) AS team_spend, sum(sum(cost)) OVER (PARTITION BY source, season) AS source_spend
            FROM v_bids GROUP BY source, season, team)""")
def spend(spark, sf):
    return ev.spend_shares(b.bids(spark, sf))


@query("a31_effective_budgets", "source:i season:i budget:d", "SELECT * FROM v_budget")
def eff_budgets(spark, sf):
    return b.budgets(spark, sf, b.bids(spark, sf))


LEFT_SQL = """
    SELECT g.source, g.season, g.team, g.week, spent_before, team_left, avg(team_left) OVER (PARTITION BY g.source, g.season, g.week) AS avg_left
    FROM (SELECT *, CASE WHEN budget > 0 THEN greatest(0, least(1, 1 - spent_before / budget)) END AS team_left FROM (
      SELECT t.source, t.season, t.team, w.week, coalesce(sum(spend) OVER (PARTITION BY t.source, t.season, t.team ORDER BY w.week
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent_before
      FROM (SELECT DISTINCT source, season, team FROM v_bids) t CROSS JOIN (SELECT unnest(range(1, 13)) AS week) w
      LEFT JOIN (SELECT source, season, team, week, sum(cost) AS spend FROM v_bids GROUP BY source, season, team, week) s
        ON s.source = t.source AND s.season = t.season AND s.team = t.team AND s.week = w.week)
      LEFT JOIN v_budget USING (source, season)) g"""


@query("a32_budget_remaining", "source:i season:i team:i week:i spent_before:d team_left:d avg_left:d", LEFT_SQL)
def remaining(spark, sf):
    """Cumulative spend before the week on a dense grid."""
    rows = b.bids(spark, sf)
    return ev.budget_remaining(rows, b.budgets(spark, sf, rows), b.WEEKS)


@query("a33_event_stats", f"source:i season:i week:i entity:i signal3:s n_bids:n win_bid:d runner_up:d {TID_SPEC}",
       f"SELECT source, season, week, entity, signal3, n_bids, win_bid, runner_up, {TID} FROM v_full")
def event_stats(spark, sf):
    return with_tid(ev.event_stats(b.bids(spark, sf)))


@query("p07_target_share", f"source:i season:i week:i entity:i target:d {TID_SPEC}",
       f"SELECT source, season, week, entity, CASE WHEN budget > 0 THEN cost / budget ELSE 0 END AS target, {TID} FROM v_full")
def target(spark, sf):
    rows = b.bids(spark, sf)
    return with_tid(rows.join(b.budgets(spark, sf, rows), ["source", "season"], "left").withColumn("target", ev.target_share()))


@query("p06_season_phase", "season:i week:i phase_decline:d phase_final:d n:i",
       """SELECT season, week + 6 AS week, CASE WHEN week + 6 BETWEEN 13 AND 15 THEN 1.0 ELSE 0.0 END AS phase_decline,
            CASE WHEN week + 6 >= 16 THEN 1.0 ELSE 0.0 END AS phase_final, count(*) AS n FROM v_raw_bid GROUP BY season, week""")
def phases(spark, sf):
    rows = b.raw_bids(spark, sf).withColumn("week", F.col("week") + 6)
    return rows.groupBy("season", "week").agg(F.count(F.lit(1)).alias("n")).withColumns(ev.season_phase())


@b.written_once
def promoted(spark, sf):
    return ev.promote_best_failed(trainable(spark, sf))


@b.written_once
def winners(spark, sf):
    """The wins of ``promoted`` with what prices read of them: no keys. The category follows from the entity, so
    no shuffle carries it."""
    rows = b.bids(spark, sf)
    # written, so that the planner knows how small budgets are and need not shuffle the bids to them
    budgets = cut_lineage(b.budgets(spark, sf, rows))
    learnt = ev.trainable(rows, b.CATEGORIES, b.BAD_IDS).select(*ev.EVENT, "signal", "bid", "cost")
    won = ev.promote_best_failed(learnt.join(budgets, ["source", "season"], "left")).where(F.col("signal") == "won")
    return won.select(*ev.EVENT, b.category_of(F.col("entity")).alias("category"), "cost", "budget")


@query("a37_promote_best_failed", f"source:i season:i week:i entity:i signal:s cost:d synthetic:b {TID_SPEC}",
       f"SELECT source, season, week, entity, signal, cost, synthetic, {TID} FROM v_promoted")
def promote(spark, sf):
    """Synthetic wins unioned to the real rows."""
    return with_tid(promoted(spark, sf))


@query("j11_only_failed_events", "source:i season:i week:i entity:i",
       """SELECT DISTINCT source, season, week, entity FROM v_train t WHERE NOT EXISTS (SELECT 1 FROM v_train r WHERE r.signal IN ('won', 'outbid')
            AND r.source = t.source AND r.season = t.season AND r.week = t.week AND r.entity = t.entity)""")
def only_failed(spark, sf):
    """Distinct event keys without a row of the given classes."""
    rows = trainable(spark, sf)
    real = rows.where(F.col("signal").isin("won", "outbid")).select(*ev.EVENT)
    return rows.select(*ev.EVENT).distinct().join(real, ev.EVENT, "left_anti")


def deduped(spark, sf):
    rows = promoted(spark, sf)
    return ev.first_row(rows, ev.EVENT, [ev.signal_priority().alias("p"), F.col("synthetic"), F.col("tid")])


@query("a34_one_row_per_event", f"source:i season:i week:i entity:i signal:s bid:d synthetic:b {TID_SPEC}",
       f"SELECT source, season, week, entity, signal, bid, synthetic, {TID} FROM v_deduped")
def one_row(spark, sf):
    return with_tid(deduped(spark, sf))


def interest_pool(spark, sf):
    return ev.consolidate_interest(deduped(spark, sf), ["bid", "cost"], b.NAMED_SOURCE)


@query("a35_consolidate_interest",
       f"season:i week:i entity:i category:s signal:s source:i sources_eligible:i sources_acting:i sources:s named_signal:s named_bid:d bid:d cost:d {TID_SPEC}",
       f"""SELECT a.*, r.category, r.signal, r.source, {TID.replace('tid.', 'r.tid.')}, CASE WHEN n > 1 THEN o.signal END AS named_signal,
             CASE WHEN n > 1 AND o.signal = 'won' THEN o.bid END AS named_bid
           FROM (SELECT season, week, entity, count(*) AS n, count(DISTINCT source) AS sources_eligible,
                   count(DISTINCT source) FILTER (WHERE signal <> 'no_bid') AS sources_acting,
                   string_agg(CAST(source AS VARCHAR), ',' ORDER BY source) AS sources, avg(bid) AS bid, avg(cost) AS cost
                 FROM v_deduped GROUP BY season, week, entity) a
           JOIN (SELECT * FROM v_deduped QUALIFY row_number() OVER (PARTITION BY season, week, entity ORDER BY {PRIORITY}, synthetic, tid) = 1) r
             USING (season, week, entity)
           LEFT JOIN (SELECT season, week, entity, signal, bid FROM v_deduped WHERE source = 0) o USING (season, week, entity)""")
def interest(spark, sf):
    rows = interest_pool(spark, sf)
    return with_tid(rows.withColumns({
        "sources": F.array_join(F.col("sources").cast("array<string>"), ","),
        "named_signal": F.col("named_detail.signal"), "named_bid": F.col("named_detail.bid")}))


@query("a36_consolidate_prices", "season:i week:i entity:i category:s n_rows:i n_sources:i mean_target:d target:d", "SELECT * FROM v_prices")
@b.written_once
def prices(spark, sf):
    return ev.consolidate_prices(winners(spark, sf))


@query("a38_winning_rows", f"season:i week:i entity:i source:i cost:d {TID_SPEC}",
       f"SELECT season, week, entity, source, cost, {TID} FROM v_promoted WHERE signal = 'won'")
def winning_rows(spark, sf):
    return with_tid(promoted(spark, sf).where(F.col("signal") == "won"))


@query("a55_win_distribution", f"season:i week:i entity:i source:i value:d {TID_SPEC}",
       f"SELECT season, week, entity, source, cost / budget AS value, {TID} FROM v_promoted WHERE signal = 'won' AND budget > 0")
def distribution(spark, sf):
    return with_tid(ev.win_distribution(promoted(spark, sf).where(F.col("signal") == "won")))


@query("a54_same_week_signal", "season:i week:i entity:i mean_price:d median_price:d sources_active:i n_won:i",
       """SELECT season, week, entity, avg(price) AS mean_price, quantile_cont(price, 0.5) AS median_price, count(DISTINCT source) AS sources_active,
            count(price) AS n_won FROM (SELECT *, CASE WHEN signal = 'won' THEN CASE WHEN budget > 0 THEN cost / budget ELSE 0 END END AS price FROM v_full)
          GROUP BY season, week, entity""")
@b.written_once
def same_week(spark, sf):
    return ev.same_week_signal(b.budgeted_bids(spark, sf))


@query("a56_single_observation", "season:i week:i entity:i backing:i single:b",
       """SELECT season, week, entity, count(DISTINCT source) AS backing, count(DISTINCT source) = 1 AS single
          FROM v_promoted WHERE signal = 'won' GROUP BY season, week, entity""")
def single(spark, sf):
    won = promoted(spark, sf).where(F.col("signal") == "won")
    return won.groupBy(*ev.POOLED).agg(F.count_distinct("source").alias("backing")).withColumn("single", F.col("backing") == 1)


@query("j27_same_week_availability", "season:i week:i entity:i sources_won:i sources_eligible:i",
       """WITH reporting AS (SELECT DISTINCT season, week, source FROM v_bids),
            acting AS (SELECT season, week, entity, source, max(CAST(signal = 'won' AS INT)) AS won FROM v_bids GROUP BY season, week, entity, source),
            keys AS (SELECT season, week, entity FROM acting UNION SELECT season, week, entity FROM v_rostered),
            eligible AS (
              SELECT k.season, k.week, k.entity, r.source FROM keys k JOIN reporting r ON r.season = k.season AND r.week = k.week
              WHERE NOT EXISTS (SELECT 1 FROM v_rostered o WHERE o.season = k.season AND o.week = k.week AND o.entity = k.entity AND o.source = r.source)
              UNION SELECT season, week, entity, source FROM acting)
          SELECT k.season, k.week, k.entity, coalesce(a.won, 0) AS sources_won, coalesce(e.n, 0) AS sources_eligible FROM keys k
          LEFT JOIN (SELECT season, week, entity, sum(won) AS won FROM acting GROUP BY season, week, entity) a USING (season, week, entity)
          LEFT JOIN (SELECT season, week, entity, count(*) AS n FROM eligible GROUP BY season, week, entity) e USING (season, week, entity)""")
def same_week_availability(spark, sf):
    """Universe minus owners union the active, by counting."""
    rows = b.bids(spark, sf)
    return ev.availability(rows, b.rostered(rows), rows)


@query("j13_valid_sources_only", "source:i season:i n:i",
       """SELECT source, season, count(*) AS n FROM v_bids WHERE source IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY source, season""")
def valid_sources(spark, sf):
    ok = b.table(spark, sf, "nation").where(F.col("n_regionkey") != 2).select(F.col("n_nationkey").alias("source"))
    return b.bids(spark, sf).join(ok, "source", "left_semi").groupBy("source", "season").agg(F.count(F.lit(1)).alias("n"))


@query("s33_source_provenance", "source:i name:s size:i budget:d",
       """SELECT n_nationkey AS source, n_name AS name, size, 800.0 + n_nationkey AS budget FROM nation JOIN
          (SELECT source, count(DISTINCT team) AS size FROM v_bids GROUP BY source) ON source = n_nationkey WHERE n_regionkey <> 2""")
def source_provenance(spark, sf):
    """Valid sources with their name, observed size and budget."""
    names = b.table(spark, sf, "nation").where(F.col("n_regionkey") != 2).select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("name"))
    sizes = b.bids(spark, sf).groupBy("source").agg(F.count_distinct("team").alias("size"))
    budgets = b.provenance(spark, sf).select("source", F.col("current_budget").alias("budget"))
    return sizes.join(names, "source").join(budgets, "source")


NO_BID = """
    SELECT s.source, c.season, c.week, c.entity, c.category
    FROM (SELECT season, week + 1 AS week, entity, category FROM v_part_perf
          WHERE pts >= 5) c
    JOIN (SELECT DISTINCT source, season, week FROM v_bids) s ON s.season = c.season AND s.week = c.week
    WHERE NOT EXISTS (SELECT 1 FROM v_rostered r WHERE r.source = s.source AND r.season = c.season AND r.week = c.week AND r.entity = c.entity)
      AND NOT EXISTS (SELECT 1 FROM v_bids x WHERE x.source = s.source AND x.season = c.season AND x.week = c.week AND x.entity = c.entity)"""
VIEWS["v_no_bid"] = NO_BID


@b.written_once
def no_bids(spark, sf):
    return free_candidates(spark, sf, b.bids(spark, sf))


def candidates(spark, sf):
    """Entities relevant in a week by their usage in the week before."""
    gated = b.part_perf(spark, sf).withColumn("week", F.col("week") + 1).where(
        ev.relevant(F.col("pts"), F.lit(None).cast("double"), F.lit(None).cast("int"), F.col("category")))
    return gated.select("season", "week", "entity", "category")


def free_candidates(spark, sf, rows):
    return ev.no_bid_rows(candidates(spark, sf), rows, b.rostered(rows), rows)


@query("j12_no_bid_candidates", "source:i season:i week:i entity:i category:s", "SELECT * FROM v_no_bid")
def no_bid_candidates(spark, sf):
    return no_bids(spark, sf)


@query("u02_bids_and_no_bids", "source:i season:i week:i signal:s n:i cost:d",
       """SELECT source, season, week, signal, count(*) AS n, sum(cost) AS cost FROM (
            SELECT source, season, week, signal, cost FROM v_bids UNION ALL SELECT source, season, week, 'no_bid', 0.0 FROM v_no_bid)
          GROUP BY source, season, week, signal""")
def bids_and_no_bids(spark, sf):
    both = b.bids(spark, sf).unionByName(no_bids(spark, sf), allowMissingColumns=True)
    return both.groupBy("source", "season", "week", "signal").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query("p04_relevance_gate", "season:i week:i entity:i relevant:b",
       """SELECT season, week, entity, pts >= 5 OR share >= 0.15 OR coalesce(rank <= CASE category WHEN 'QB' THEN 25 WHEN 'TE' THEN 25 WHEN 'K' THEN 18 ELSE 73 END, FALSE) AS relevant
          FROM (SELECT *, CASE WHEN snaps % 4 <> 0 THEN snaps * 5 END AS rank, CASE WHEN snaps % 3 <> 0 THEN snaps / sum(snaps) OVER (PARTITION BY season, week, grp) ELSE 0 END AS share FROM v_part_perf)""")
def relevance(spark, sf):
    from rivalgrid.operators.usage import shares
    rows = shares(b.part_perf(spark, sf), "snaps", "share")
    share = F.when(F.col("snaps") % 3 != 0, F.col("share"))
    rank = F.when(F.col("snaps") % 4 != 0, F.col("snaps") * 5)
    return rows.withColumn("relevant", ev.relevant(F.col("pts"), share, rank, F.col("category")))


@query("j29_ranked_without_activity", "season:i week:i entity:i n_snaps:d",
       """SELECT season, week, entity, snaps AS n_snaps FROM v_part_perf p WHERE snaps >= 6 AND NOT EXISTS (
            SELECT 1 FROM v_train t WHERE t.season = p.season AND t.week = p.week AND t.entity = p.entity AND t.signal = 'won' AND t.bid > 24)""")
def ranked_without_activity(spark, sf):
    ranked = b.part_perf(spark, sf).where(F.col("snaps") >= 6).withColumnRenamed("snaps", "n_snaps")
    active = trainable(spark, sf).where((F.col("signal") == "won") & (F.col("bid") > 24)).select(*ev.POOLED)
    return ranked.join(active, ev.POOLED, "left_anti")


@query("j18_log_outcomes", "source:i season:i week:i entity:i status:s n_bids:n win_pct:d",
       """SELECT l.source, l.season, l.week, l.entity,
            CASE WHEN w.bid IS NOT NULL THEN 'won' WHEN e.n IS NOT NULL THEN 'lost' WHEN p.source IS NOT NULL THEN 'no_bid' ELSE 'pending' END AS status,
            e.n AS n_bids, CASE WHEN budget > 0 THEN w.bid / budget END AS win_pct
          FROM (SELECT DISTINCT source, season, week + 2 AS week, entity FROM v_bids) l
          LEFT JOIN (SELECT source, season, week, entity, count(*) AS n FROM v_bids WHERE kind = 'WAIVER' AND signal IN ('won', 'outbid') GROUP BY ALL) e USING (source, season, week, entity)
          LEFT JOIN (SELECT source, season, week, entity, bid FROM v_bids WHERE kind = 'WAIVER' AND signal = 'won'
                     QUALIFY row_number() OVER (PARTITION BY source, season, week, entity ORDER BY tid) = 1) w USING (source, season, week, entity)
          LEFT JOIN (SELECT DISTINCT source, season, week FROM v_bids WHERE kind = 'WAIVER' AND week <= 10) p USING (source, season, week)
          LEFT JOIN v_budget USING (source, season)""")
def log_outcomes(spark, sf):
    rows = b.bids(spark, sf)
    log = rows.select("source", "season", (F.col("week") + 2).alias("week"), "entity").distinct()
    processed = rows.where((F.col("kind") == "WAIVER") & (F.col("week") <= 10))
    return ev.log_outcomes(log, rows, b.budgets(spark, sf, rows), processed)


@query("j19_current_season_replaces", "season:i origin:s n:i",
       """SELECT season, origin, count(*) AS n FROM (
            SELECT season, 'frozen' AS origin FROM v_bids WHERE season NOT IN (SELECT season FROM v_bids WHERE season >= 2000)
            UNION ALL SELECT season, 'live' FROM v_bids WHERE season >= 2000) GROUP BY season, origin""")
def current_replaces(spark, sf):
    """J19 and S16 forced: incoming seasons replace the frozen rows of the same season."""
    rows = b.bids(spark, sf).select("season", "tid")
    merged = ev.source_of_record(
        rows.withColumn("origin", F.lit("frozen")), rows.where(F.col("season") >= 2000).withColumn("origin", F.lit("live")), ["season"], force=True)
    return merged.groupBy("season", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("s16_source_of_record_wins", "season:i origin:s n:i",
       """SELECT season, origin, count(*) AS n FROM (
            SELECT season, 'held' AS origin FROM v_bids WHERE season < 1998
            UNION ALL SELECT season, 'incoming' FROM v_bids WHERE season NOT IN (SELECT season FROM v_bids WHERE season < 1998)) GROUP BY season, origin""")
def source_of_record(spark, sf):
    rows = b.bids(spark, sf).select("season", "tid")
    merged = ev.source_of_record(
        rows.where(F.col("season") < 1998).withColumn("origin", F.lit("held")), rows.withColumn("origin", F.lit("incoming")), ["season"])
    return merged.groupBy("season", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("m13_build_pools", "pool:s category:s n:i backing:i",
       """SELECT 'interest' AS pool, r.category, count(*) AS n, sum(a.e) AS backing FROM
            (SELECT season, week, entity, count(DISTINCT source) AS e, any_value(category) AS category FROM v_deduped WHERE week <> 1 GROUP BY season, week, entity) a
            JOIN (SELECT DISTINCT entity, category FROM v_train) r ON a.entity = r.entity GROUP BY r.category
          UNION ALL SELECT 'price', category, count(*), sum(n_sources) FROM v_prices GROUP BY category""")
def pools(spark, sf):
    """Both training pools from raw bids as one lazy plan."""
    rows = promoted(spark, sf)
    one = ev.first_row(rows.where(F.col("week") != 1), ev.EVENT, [ev.signal_priority().alias("p"), F.col("synthetic"), F.col("tid")])
    interest_rows = ev.consolidate_interest(one, ["bid"], b.NAMED_SOURCE)
    price_rows = ev.consolidate_prices(rows.where(F.col("signal") == "won"))
    a = interest_rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("sources_eligible").alias("backing"))
    p = price_rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("n_sources").alias("backing"))
    return a.withColumn("pool", F.lit("interest")).unionByName(p.withColumn("pool", F.lit("price")))
