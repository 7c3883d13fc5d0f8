"""Line-ups, pick-ups and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalgrid.operators import lineup as ln
from rivalgrid.operators import swaps as sw
from rivalgrid.operators import trades as tr
from rivalgrid.operators.lineup import Slot
from rivalgrid.operators.ranking import top_n_any_size
from rivalgrid.plans import bindings as b
from rivalgrid.plans.registry import query
from rivalgrid.plans.sql_views import VIEWS
from rivalgrid.session import cut_lineage

SLOTS = [Slot("QB", 1, ("QB",)), Slot("RB", 1, ("RB",)), Slot("WR", 1, ("WR",)), Slot("TE", 1, ("TE",)), Slot("K", 1, ("K",)),
         Slot("FLEX", 2, ("RB", "WR", "TE"))]
FREE_GROUP, OWNERS = 20, 20
MARKET = tr.Market(tuple(SLOTS), b.CATEGORIES)
# How far down a group's list the search goes, for one for one and for two for one; trades verified per group.
POOL, TWO_FOR_ONE, VERIFIED = 10, 6, 300


def claim_sql(source: str, keys: str, order: str) -> str:
    """The slot passes as nested selects."""
    sql = f"SELECT *, CAST(NULL AS VARCHAR) AS slot FROM ({source})"
    for s in ln.slot_order(SLOTS):
        free = "slot IS NULL AND category IN (" + ", ".join(f"'{c}'" for c in s.categories) + ")"
        sql = (f"SELECT * REPLACE (CASE WHEN {free} AND row_number() OVER (PARTITION BY {keys}, ({free}) ORDER BY {order}) <= {s.count} THEN '{s.label}' ELSE slot END AS slot) FROM ({sql})")
    return sql


def value_sql(source: str, keys: str, seasonal: str, bars: str = "v_free_best f ON f.week = c.week") -> str:
    """Starting and depth value per row of a roster table."""
    marked = f"""SELECT * FROM (SELECT *, max(value) OVER (PARTITION BY {seasonal}, entity) <= 0 AS dead FROM ({source})) WHERE value > 0 OR dead"""
    claimed = claim_sql(marked, keys, "value > 0 DESC, CASE WHEN value > 0 THEN value END DESC NULLS LAST, entity")
    best = "CASE slot " + " ".join(
        f"WHEN '{s.label}' THEN greatest(0, " + ", ".join(f"coalesce(f.{c}, 0)" for c in s.categories) + ")" for s in SLOTS) + " END"
    own = "coalesce(CASE category " + " ".join(f"WHEN '{c}' THEN f.{c}" for c in b.CATEGORIES) + " END, 0)"
    return f"""SELECT c.*, CASE WHEN slot IS NOT NULL THEN greatest(value, 0) - {best} ELSE 0 END AS starting_value,
                 CASE WHEN slot IS NULL AND value > 0 THEN greatest(0, value - {own}) ELSE 0 END AS depth_value
               FROM ({claimed}) c LEFT JOIN {bars}"""


VIEWS.update({
    "v_weekly_value": """
        SELECT entity, grp, category, week, bye_week, CASE WHEN week = bye_week OR entity % 13 = 6 THEN 0.0 ELSE total / n END AS value, week = bye_week AS on_bye FROM (
          SELECT entity, grp, category, week, CAST(1 + entity % 12 AS INT) AS bye_week, sum(pts) AS total, count(*) AS n FROM v_perf GROUP BY entity, grp, category, week)""",
    "v_roster": "SELECT * FROM v_weekly_value WHERE grp < 20",
    "v_free": "SELECT * FROM v_weekly_value WHERE grp >= 20",
    "v_free_best": "SELECT week, " + ", ".join(f"greatest(0, max(value) FILTER (WHERE category = '{c}')) AS {c}" for c in b.CATEGORIES) + " FROM v_free GROUP BY week",
    "v_start": claim_sql("SELECT * FROM v_roster", "grp, week", "value DESC, entity"),
    "v_value": value_sql("SELECT grp, week, entity, category, value FROM v_roster", "grp, week", "grp"),
    "v_group_value": "SELECT grp, sum(starting_value) + 0.5 * sum(depth_value) AS total_value FROM v_value GROUP BY grp",
    "v_rest": "SELECT grp, entity, category, sum(value) AS rest_total FROM v_roster GROUP BY grp, entity, category",
})


def weekly_values(spark, sf):
    rows = b.perf(spark, sf).groupBy("entity", "grp", "category", "week").agg((F.sum("pts") / F.count(F.lit(1))).alias("_v"))
    bye = (1 + F.col("entity") % 12).cast("int")
    rows = rows.withColumn("bye_week", bye)
    off = (F.col("week") == F.col("bye_week"))
    return rows.withColumns({"value": F.when(off | (F.col("entity") % 13 == 6), 0.0).otherwise(F.col("_v")), "on_bye": off}).drop("_v")


def sides(spark, sf):
    """Owned rows and the free pool."""
    rows = cut_lineage(weekly_values(spark, sf))
    return rows.where(F.col("grp") < OWNERS), rows.where(F.col("grp") >= FREE_GROUP)


KEYS = ["grp", "week"]


@query("w14_best_lineup", "grp:i week:i entity:i category:s value:d slot:s",
       "SELECT grp, week, entity, category, value, slot FROM v_start WHERE slot IS NOT NULL")
def best_lineup(spark, sf):
    return ln.starters(sides(spark, sf)[0], KEYS, SLOTS)


@query("w15_value_above_free", "grp:i week:i entity:i slot:s starting_value:d depth_value:d",
       "SELECT grp, week, entity, slot, starting_value, depth_value FROM v_value")
def above_free(spark, sf):
    owned, free = sides(spark, sf)
    return ln.value_above_free(owned.select("grp", "week", "entity", "category", "value"), free, KEYS, SLOTS)


def group_values(owned, free, by):
    return ln.value_totals(ln.value_above_free(owned.select("grp", "week", "entity", "category", "value"), free, KEYS, SLOTS), by)


@query("w16_value_by_category", "grp:i category:s starting_value:d depth_value:d total_value:d",
       "SELECT grp, category, sum(starting_value) AS starting_value, sum(depth_value) AS depth_value, sum(starting_value) + 0.5 * sum(depth_value) AS total_value FROM v_value GROUP BY grp, category")
def by_category(spark, sf):
    return group_values(*sides(spark, sf), ["grp", "category"])


@query("w17_free_pool_value", "entity:i category:s gain:d net:d",
       """SELECT entity, category, sum(greatest(d, 0)) AS gain, sum(d) AS net FROM (
            SELECT a.entity, a.category, a.value - greatest(0, coalesce((SELECT max(o.value) FROM v_free o WHERE o.week = a.week AND o.category = a.category AND o.entity <> a.entity), 0)) AS d
            FROM v_free a) GROUP BY entity, category""")
def free_value(spark, sf):
    return ln.free_pool_value(sides(spark, sf)[1])


STREAM = """SELECT grp, week, entity, category, value FROM v_roster UNION ALL
    SELECT g.grp, g.week, -1, c.category, f.best FROM (SELECT DISTINCT grp, week FROM v_roster) g CROSS JOIN v_category c
    JOIN (SELECT week, category, max(value) AS best FROM v_free GROUP BY week, category) f ON f.week = g.week AND f.category = c.category AND f.best > 0
    WHERE NOT EXISTS (SELECT 1 FROM v_roster r WHERE r.grp = g.grp AND r.week = g.week AND r.category = c.category AND r.value > 0)"""


@query("w18_lineup_with_streaming", "grp:i week:i total:d",
       f"SELECT grp, week, sum(value) AS total FROM ({claim_sql(STREAM, 'grp, week', 'value DESC, entity')}) WHERE slot IS NOT NULL GROUP BY grp, week")
def streaming(spark, sf):
    owned, free = sides(spark, sf)
    return ln.totals(ln.with_streaming(owned, free, KEYS, b.CATEGORIES), KEYS, SLOTS)


def fill_sql() -> str:
    """The free rows claimed for holes, slot by slot: as many of a slot as it has holes."""
    sql = """SELECT h.*, f.entity, f.category, f.value, CAST(NULL AS VARCHAR) AS slot, 0 AS turn FROM v_hole h JOIN (
        SELECT * FROM v_free WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY week, category ORDER BY value DESC, entity) <= 7) f USING (week)"""
    for s in ln.slot_order(SLOTS):
        free = "slot IS NULL AND category IN (" + ", ".join(f"'{c}'" for c in s.categories) + ")"
        rank = f"row_number() OVER (PARTITION BY grp, week, ({free}) ORDER BY value DESC, entity)"
        sql = f"""SELECT * REPLACE (CASE WHEN {free} AND {rank} <= n_{s.label} THEN {rank} ELSE turn END AS turn,
            CASE WHEN {free} AND {rank} <= n_{s.label} THEN '{s.label}' ELSE slot END AS slot) FROM ({sql})"""
    return sql


VIEWS["v_hole"] = "SELECT grp, week, " + ", ".join(f"count(*) FILTER (WHERE slot = '{s.label}') AS n_{s.label}" for s in SLOTS) + " FROM v_start WHERE slot IS NOT NULL AND on_bye GROUP BY grp, week"


@query("w19_bye_fill", "grp:i week:i slot:s entity:i fill:n streamed:b final_value:d",
       f"""SELECT l.grp, l.week, l.slot, l.entity, f.entity AS fill, f.entity IS NOT NULL AS streamed, l.value + coalesce(f.value, 0) AS final_value FROM (
            SELECT *, CASE WHEN on_bye THEN row_number() OVER (PARTITION BY grp, week, slot, on_bye ORDER BY value DESC, entity) END AS turn FROM v_start WHERE slot IS NOT NULL) l
          LEFT JOIN (SELECT * FROM ({fill_sql()}) WHERE slot IS NOT NULL) f ON f.grp = l.grp AND f.week = l.week AND f.slot = l.slot AND f.turn = l.turn""")
def bye_fill(spark, sf):
    """A starter on bye gives its slot to the best free entity not used yet."""
    owned, free = sides(spark, sf)
    return ln.bye_fill(owned, free, KEYS, SLOTS)


@query("w20_slot_strength", "grp:i slot:s instance:i avg_value:d",
       """SELECT grp, slot, instance, avg(value) AS avg_value FROM (
            SELECT *, row_number() OVER (PARTITION BY grp, week, slot ORDER BY value DESC, entity) AS instance FROM v_start WHERE slot IS NOT NULL) GROUP BY grp, slot, instance""")
def strength(spark, sf):
    return ln.slot_strength(ln.starters(sides(spark, sf)[0], KEYS, SLOTS), KEYS, ["grp"])


@query("a52_lineup_efficiency", "grp:i week:i actual:d best:d mer:d",
       """SELECT a.grp, a.week, actual, greatest(actual, total) AS best, CASE WHEN greatest(actual, total) > 0 THEN actual / greatest(actual, total) END AS mer FROM
            (SELECT grp, week, sum(CASE WHEN (entity + week) % 3 <> 0 THEN value ELSE 0 END) AS actual FROM v_roster GROUP BY grp, week) a
          JOIN (SELECT grp, week, sum(value) AS total FROM v_start WHERE slot IS NOT NULL GROUP BY grp, week) t USING (grp, week)""")
def efficiency(spark, sf):
    return ln.efficiency(sides(spark, sf)[0], KEYS, SLOTS, (F.col("entity") + F.col("week")) % 3 != 0)


@query("p38_expand_slots", "source:i label:s instance:s",
       """SELECT c_nationkey AS source, c_mktsegment AS label, c_mktsegment || CASE WHEN n > 1 THEN CAST(i AS VARCHAR) ELSE '' END AS instance FROM (
            SELECT c_nationkey, c_mktsegment, count(*) AS n, unnest(range(1, count(*) + 1)) AS i FROM customer GROUP BY c_nationkey, c_mktsegment)""")
def expand(spark, sf):
    conf = b.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return ln.expand_slots(conf)


@query("u05_starters_changed", "grp:i week:i entity:i change:s",
       """SELECT grp, week, entity, 'in' AS change FROM v_start n WHERE slot IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_roster o WHERE o.grp = n.grp AND o.week = n.week AND o.entity = n.entity AND (o.entity + o.week) % 3 <> 0)
          UNION ALL SELECT grp, week, entity, 'out' FROM v_roster o WHERE (entity + week) % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM v_start n WHERE n.slot IS NOT NULL AND o.grp = n.grp AND o.week = n.week AND o.entity = n.entity)""")
def changed(spark, sf):
    owned, _ = sides(spark, sf)
    best = ln.starters(owned, KEYS, SLOTS).select("grp", "week", "entity")
    now = owned.where((F.col("entity") + F.col("week")) % 3 != 0).select("grp", "week", "entity")
    ids = ["grp", "week", "entity"]
    return best.join(now, ids, "left_anti").withColumn("change", F.lit("in")).unionByName(now.join(best, ids, "left_anti").withColumn("change", F.lit("out")))


@query("j26_paired_changes", "grp:i week:i came:n in_value:d out:n out_value:d",
       """WITH c AS (SELECT grp, week, category, entity AS came, value AS in_value, row_number() OVER (PARTITION BY grp, week, category ORDER BY value DESC, entity) AS n FROM v_start s WHERE slot IS NOT NULL
              AND NOT ((entity + week) % 3 <> 0)),
            g AS (SELECT grp, week, category, entity AS out, value AS out_value, row_number() OVER (PARTITION BY grp, week, category ORDER BY value DESC, entity) AS n FROM v_roster o WHERE (entity + week) % 3 <> 0
              AND NOT EXISTS (SELECT 1 FROM v_start s WHERE s.slot IS NOT NULL AND s.grp = o.grp AND s.week = o.week AND s.entity = o.entity)),
            m AS (SELECT * FROM c FULL JOIN g USING (grp, week, category, n))
          SELECT grp, week, came, in_value, out, out_value FROM m WHERE came IS NOT NULL AND out IS NOT NULL
          UNION ALL SELECT grp, week, came, in_value, out, out_value FROM
            (SELECT grp, week, came, in_value, row_number() OVER (PARTITION BY grp, week ORDER BY in_value DESC, came) AS k FROM m WHERE out IS NULL)
            FULL JOIN (SELECT grp, week, out, out_value, row_number() OVER (PARTITION BY grp, week ORDER BY out_value DESC, out) AS k FROM m WHERE came IS NULL) USING (grp, week, k)""")
def paired(spark, sf):
    owned, _ = sides(spark, sf)
    return ln.changes(owned.where((F.col("entity") + F.col("week")) % 3 != 0), ln.starters(owned, KEYS, SLOTS), KEYS)


@query("t03_top_pool", "grp:i entity:i category:s rest_total:d pos:i", "SELECT * FROM v_pool")
def top_pool(spark, sf):
    return pool(sides(spark, sf)[0])


def pool(owned):
    return sw.top_pool(sw.rest_totals(owned), POOL, ["K"])


def side_sql(trades: str) -> str:
    """Two rows per trade: what each side gives and gets."""
    return f"SELECT scenario, 'a' AS side, grp_a AS grp, give_a AS gives, give_b AS gets FROM {trades} UNION ALL SELECT scenario, 'b', grp_b, give_b, give_a FROM {trades}"


def changed_sql(side: str) -> str:
    """Rosters after the trades, row by row."""
    return f"""SELECT s.scenario, s.grp, r.week, r.entity, r.category, r.value FROM {side} s JOIN v_roster r ON r.grp = s.grp AND NOT list_contains(s.gives, r.entity)
        UNION ALL SELECT s.scenario, s.grp, r.week, r.entity, r.category, r.value FROM (SELECT *, unnest(gets) AS got FROM {side}) s JOIN v_roster r ON r.entity = s.got"""


def scored_sql(trades: str, side: str, valued: str) -> str:
    """Gains and scores of trades from the value of every changed roster."""
    return f"""SELECT c.*, ga AS gain_a, gb AS gain_b, na AS need_a, nb AS need_b, CASE WHEN ga < 0 AND gb < 0 THEN least(ga, gb) ELSE ga * gb END AS score FROM {trades} c JOIN (
        SELECT scenario, max(gain) FILTER (WHERE side = 'a') AS ga, max(gain) FILTER (WHERE side = 'b') AS gb, max(need) FILTER (WHERE side = 'a') AS na, max(need) FILTER (WHERE side = 'b') AS nb FROM (
          SELECT s.scenario, s.side, round(coalesce(v.t, 0) - coalesce(g.t, 0), 9) AS gain, round(coalesce(v.n, 0) - coalesce(g.n, 0), 9) AS need FROM {side} s
          LEFT JOIN (SELECT scenario, grp, sum(starting_value + 0.5 * depth_value) AS t, sum(starting_value + 0.5 * depth_value) FILTER (WHERE category IN {NEEDS}) AS n FROM {valued} GROUP BY scenario, grp) v USING (scenario, grp)
          LEFT JOIN (SELECT grp, sum(starting_value + 0.5 * depth_value) AS t, sum(starting_value + 0.5 * depth_value) FILTER (WHERE category IN {NEEDS}) AS n FROM v_value GROUP BY grp) g USING (grp))
        GROUP BY scenario) USING (scenario)"""


NEEDS = ("RB", "TE")
NAMED = "grp_a || '-' || array_to_string(give_a, '+') || '-' || grp_b || '-' || array_to_string(give_b, '+')"
PAIR = "a.grp AS grp_a, a.ids AS give_a, b.grp AS grp_b, b.ids AS give_b, len(a.ids) || '-' || len(b.ids) AS kind"
VIEWS.update({
    "v_pool": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rest_total DESC, entity) AS pos FROM v_rest WHERE category <> 'K') WHERE pos <= {POOL}",
    "v_offer": "SELECT grp, [entity] AS ids, pos AS far FROM v_pool UNION ALL SELECT a.grp, [a.entity, b.entity], greatest(a.pos, b.pos) FROM v_pool a JOIN v_pool b ON a.grp = b.grp AND a.entity < b.entity",
    "v_swap_cand": f"""SELECT *, {NAMED} AS scenario FROM (SELECT {PAIR} FROM v_offer a JOIN v_offer b ON a.grp < b.grp
        AND (len(a.ids) + len(b.ids) = 2 OR (len(a.ids) + len(b.ids) = 3 AND greatest(a.far, b.far) <= {TWO_FOR_ONE})))""",
    "v_side": side_sql("v_swap_cand"),
    "v_side_value": value_sql(changed_sql("v_side"), "scenario, grp, week", "scenario, grp"),
    "v_trade": scored_sql("v_swap_cand", "v_side", "v_side_value"),
    "v_directed": """SELECT scenario, grp_a AS grp, grp_b AS partner, give_a AS gives, give_b[1] AS get, gain_a AS gain, gain_b AS partner_gain, need_a AS need_gain, score FROM v_trade WHERE len(give_b) = 1
        UNION ALL SELECT scenario, grp_b, grp_a, give_b, give_a[1], gain_b, gain_a, need_b, score FROM v_trade WHERE len(give_a) = 1""",
    "v_chosen": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 6) DESC, scenario) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY grp, get ORDER BY round(score, 6) DESC, scenario) AS k FROM v_directed) WHERE k <= 2) WHERE pos <= 5""",
    "v_worth": "SELECT grp, entity, sum(starting_value + 0.5 * depth_value) AS worth FROM v_value GROUP BY grp, entity",
    "v_rough_offer": "SELECT o.grp, o.ids, sum(coalesce(w.worth, 0)) AS worth FROM (SELECT *, unnest(ids) AS entity FROM v_offer) o LEFT JOIN v_worth w USING (grp, entity) GROUP BY o.grp, o.ids",
    "v_rough": f"SELECT *, {NAMED} AS scenario FROM (SELECT {PAIR}, -abs(a.worth - b.worth) AS rough FROM v_rough_offer a JOIN v_rough_offer b ON a.grp < b.grp)",
    "v_verify": f"""SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY grp_a ORDER BY round(rough, 9) DESC, scenario) AS r FROM v_rough)
        WHERE r <= {VERIFIED} OR (kind = '1-1' AND give_b[1] % 10 = 3)""",
    "v_verify_side": side_sql("v_verify"),
    "v_verify_value": value_sql(changed_sql("v_verify_side"), "scenario, grp, week", "scenario, grp"),
})


def ids(name):
    return F.array_join(F.col(name).cast("array<string>"), "+").alias(name)


def shown(df):
    return df.select(*[ids(c) if c in ("give_a", "give_b", "gives") else F.col(c) for c in df.columns])


SHOW = "SELECT * REPLACE (array_to_string(give_a, '+') AS give_a, array_to_string(give_b, '+') AS give_b) FROM"


def candidates(owned):
    # one league: its groups meet, and each puts up a bounded pool
    return tr.candidate_trades(pool(owned).withColumn("tenant", F.lit(0)), TWO_FOR_ONE)


@query("j25_candidate_swaps", "grp_a:i give_a:s grp_b:i give_b:s kind:s", f"{SHOW} v_swap_cand")
def candidate_swaps(spark, sf):
    return shown(candidates(sides(spark, sf)[0]))


def trades(spark, sf, needs=None):
    owned, free = sides(spark, sf)
    return cut_lineage(tr.trade_gains(owned, free, cut_lineage(candidates(owned)), MARKET, needs))


TRADE_SPEC = "grp_a:i give_a:s grp_b:i give_b:s kind:s gain_a:d gain_b:d score:d"


@query("m20_trade_scores", TRADE_SPEC, f"{SHOW} v_trade")
def trade_scores(spark, sf):
    """One for one and two for one, either way round, with both gains and the mutual score."""
    return shown(trades(spark, sf))


def chosen(scored):
    return sw.diverse_top(tr.directed(scored), ["grp"], "get", 2, 5)


DIRECTED_SPEC = "grp:i partner:i gives:s get:i gain:d partner_gain:d score:d"


@query("t01_diverse_top_trades", f"pos:i {DIRECTED_SPEC}", "SELECT * REPLACE (array_to_string(gives, '+') AS gives) FROM v_chosen")
def diverse(spark, sf):
    return shown(chosen(trades(spark, sf)))


@query("t02_missing_partners", DIRECTED_SPEC,
       """SELECT * REPLACE (array_to_string(gives, '+') AS gives) FROM (SELECT grp, partner, gives, get, gain, partner_gain, score FROM v_chosen UNION ALL
          SELECT grp, partner, gives, get, gain, partner_gain, score FROM (SELECT *, row_number() OVER (PARTITION BY grp, partner ORDER BY round(score, 6) DESC, scenario) AS k FROM v_directed) t
          WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM v_chosen c WHERE c.grp = t.grp AND c.partner = t.partner))""")
def missing_partners(spark, sf):
    """The best trades of each group, and the best one with every partner not among them."""
    scored = trades(spark, sf)
    return shown(sw.plus_missing_partners(chosen(scored), tr.directed(scored), ["grp"], "partner"))


@query("t08_budget_then_exact", f"{TRADE_SPEC} rough:d", f"{SHOW} ({scored_sql('v_verify', 'v_verify_side', 'v_verify_value')})")
def budget(spark, sf):
    """Up to two a side: a cheap rank, a budget per group, locked trades always kept; only those are valued."""
    owned, free = sides(spark, sf)
    locked = (F.col("kind") == "1-1") & (F.get("give_b", F.lit(0)) % 10 == 3)
    rough = tr.rough_trades(pool(owned).withColumn("tenant", F.lit(0)), tr.entity_worth(owned, free, MARKET), ["grp_a"], VERIFIED, locked)
    return shown(tr.trade_gains(owned, free, cut_lineage(rough), MARKET))


@query("m22_block_list_offers", f"pos:i {DIRECTED_SPEC} need_gain:d brings:b",
       f"""SELECT * REPLACE (array_to_string(gives, '+') AS gives) FROM (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY brings AND round(need_gain, 6) > 0 DESC, round(score, 6) DESC, scenario) AS pos FROM (
              SELECT d.*, (SELECT any_value(category) FROM v_rest r WHERE r.entity = d.get) IN {NEEDS} AS brings FROM v_directed d
              WHERE NOT EXISTS (SELECT 1 FROM (SELECT scenario, grp, unnest(gives) AS given FROM v_directed) o
                WHERE o.scenario = d.scenario AND o.grp = d.grp AND o.given NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)))) WHERE pos <= 10""")
def block_offers(spark, sf):
    """Offers of entities on a block list, first those that bring a needed category and raise its value."""
    owned = sides(spark, sf)[0]
    listed = b.table(spark, sf, "supplier").where(F.col("s_acctbal") > 3000).select(F.col("s_suppkey").cast("bigint").alias("given"))
    seen = tr.directed(trades(spark, sf, NEEDS))
    off = seen.select("scenario", "grp", F.explode("gives").alias("given")).join(listed, "given", "left_anti").select("scenario", "grp").distinct()
    brought = owned.select(F.col("entity").cast("bigint").alias("get"), F.col("category").isin(*NEEDS).alias("brings")).distinct()
    rows = seen.join(off, ["scenario", "grp"], "left_anti").join(brought, "get")
    first = F.col("brings") & (F.round("need_gain", 6) > 0)
    return shown(top_n_any_size(rows, ["grp"], [first.desc(), F.round("score", 6).desc(), F.col("scenario").asc()], "scenario", 10))


# Nothing of the bounded summaries here: each pick-up's roster and free pool are laid out row by row.
PICKUP_SRC = """SELECT p.scenario, p.grp, r.week, r.entity, r.category, r.value, 0 AS after FROM v_pickup p JOIN v_roster r ON r.grp = p.grp
    UNION ALL SELECT p.scenario, p.grp, r.week, r.entity, r.category, r.value, 1 FROM v_pickup p JOIN v_roster r ON r.grp = p.grp AND r.entity <> p.drop
    UNION ALL SELECT p.scenario, p.grp, r.week, r.entity, r.category, r.value, 1 FROM v_pickup p JOIN v_free r ON r.entity = p.add"""
VIEWS.update({
    "v_droppable": "SELECT r.grp, r.entity, r.category, round(coalesce(w.worth, 0), 9) AS worth FROM v_rest r LEFT JOIN v_worth w USING (grp, entity)",
    "v_pickup": """SELECT g.grp, f.entity AS add, g.grp || '-' || f.entity AS scenario, coalesce(o.drop, g.drop) AS drop
        FROM (SELECT entity, category FROM v_free GROUP BY entity, category HAVING sum(value) > 0) f
        CROSS JOIN (SELECT grp, arg_min(entity, (worth, entity)) AS drop FROM v_droppable GROUP BY grp) g
        LEFT JOIN (SELECT grp, category, arg_min(entity, (worth, entity)) AS drop FROM v_droppable GROUP BY grp, category) o ON o.grp = g.grp AND o.category = f.category""",
    "v_pickup_bar": "SELECT scenario, week, " + ", ".join(f"greatest(0, coalesce(max(value) FILTER (WHERE category = '{c}'), 0)) AS {c}" for c in b.CATEGORIES) + """ FROM (
        SELECT p.scenario, f.week, f.category, f.value FROM v_pickup p JOIN v_free f ON f.entity <> p.add
        UNION ALL SELECT p.scenario, r.week, r.category, r.value FROM v_pickup p JOIN v_roster r ON r.entity = p.drop) GROUP BY scenario, week""",
    "v_pickup_value": value_sql(PICKUP_SRC, "scenario, after, week", "scenario, after", "v_pickup_bar f ON f.week = c.week AND f.scenario = c.scenario"),
})


@query("m19_pickup_gains", "grp:i drop:i add:i gain:d",
       """SELECT * FROM (SELECT p.grp, p.drop, p.add, sum((CASE WHEN after = 1 THEN 1 ELSE -1 END) * (starting_value + 0.5 * depth_value)) AS gain
          FROM v_pickup p JOIN v_pickup_value v USING (scenario) GROUP BY p.grp, p.drop, p.add) WHERE round(gain, 6) > 0""")
def pickups(spark, sf):
    """Every free entity with points to come, for the weakest of its category, where the group gains."""
    return tr.pickups(*sides(spark, sf), MARKET)


@query("m21_trade_by_week", "scenario:s side:i grp:i week:i before:d after:d gain:d favors:s",
       f"""WITH sides AS (SELECT DISTINCT s.* FROM v_side s JOIN v_chosen USING (scenario)),
            changed AS ({changed_sql('sides')}),
            weeks AS (SELECT DISTINCT week FROM v_weekly_value),
            a AS (SELECT scenario, grp, week, sum(value) AS after FROM ({claim_sql('SELECT * FROM changed', 'scenario, grp, week', 'value DESC, entity')}) WHERE slot IS NOT NULL GROUP BY scenario, grp, week),
            t AS (SELECT grp, week, sum(value) AS before FROM v_start WHERE slot IS NOT NULL GROUP BY grp, week),
            r AS (SELECT s.scenario, CASE side WHEN 'a' THEN 0 ELSE 1 END AS side, s.grp, w.week, coalesce(t.before, 0) AS before, coalesce(a.after, 0) AS after, coalesce(a.after, 0) - coalesce(t.before, 0) AS gain
                  FROM sides s CROSS JOIN weeks w LEFT JOIN a USING (scenario, grp, week) LEFT JOIN t USING (grp, week)),
            f AS (SELECT scenario, round(sum(CASE side WHEN 0 THEN gain ELSE -gain END), 9) AS lead, count(DISTINCT week) AS n FROM r GROUP BY scenario)
          SELECT r.*, CASE WHEN abs(lead) < n THEN 'even' WHEN lead > 0 THEN 'a' ELSE 'b' END AS favors FROM r JOIN f USING (scenario)""")
def trade_by_week(spark, sf):
    """The trades picked for any group: line-up totals of both sides week by week, and whom it favours."""
    owned, free = sides(spark, sf)
    scored = trades(spark, sf)
    picked = scored.join(chosen(scored).select("scenario").distinct(), "scenario", "left_semi")
    return tr.lineup_weeks(owned, free, cut_lineage(picked), MARKET)


@query("m23_roster_repair", "grp:i entity:i category:s rest_total:d action:s",
       """WITH e AS (SELECT grp, entity, category, rest_total, 'kept' AS action FROM v_rest UNION ALL
            SELECT g.grp, f.entity, c.category, f.t, 'added' FROM (SELECT DISTINCT grp FROM v_rest) g CROSS JOIN v_category c
            JOIN (SELECT category, arg_max(entity, (t, -entity)) AS entity, max(t) AS t FROM (SELECT entity, category, sum(value) AS t FROM v_free GROUP BY entity, category) GROUP BY category) f USING (category)
            WHERE NOT EXISTS (SELECT 1 FROM v_rest r WHERE r.grp = g.grp AND r.category = c.category)),
            s AS (SELECT *, row_number() OVER (PARTITION BY grp, category ORDER BY rest_total DESC, entity) = 1 AS safe FROM e)
          SELECT grp, entity, category, rest_total, CASE WHEN NOT safe AND row_number() OVER (PARTITION BY grp ORDER BY safe DESC, rest_total DESC, entity) > 6 THEN 'cut' ELSE action END AS action FROM s""")
def repair(spark, sf):
    owned, free = sides(spark, sf)
    pool = free.groupBy("entity", "category").agg(F.sum("value").alias("rest_total"))
    return sw.repair(sw.rest_totals(owned), pool, b.CATEGORIES, 6)
