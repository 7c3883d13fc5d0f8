"""Role views over the given tables: who is entity, group, opponent, period and measure."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalgrid.functions.numeric import ratio
from rivalgrid.functions.scoring import score
from rivalgrid.operators.allowed import points_by_group
from rivalgrid.operators import events as ev
from rivalgrid.operators.grids import dense_points, with_opponent
from rivalgrid.session import cuts, drop_tables, drops, free_shuffles, partitions_for, written
from rivalgrid.sources.tables import in_years

CATEGORIES = ("QB", "RB", "WR", "TE", "K")
# Binary fractions, so that sums of points are exact in any order.
RULES = [("RECS", 0.5), ("REY", 0.0625), ("RY10", 1.0), ("RA", 0.25)]
PARTIAL_SEASON, PARTIAL_WEEK, WEEKS, GROUPS = 2001, 6, 12, 25


# The tables that shared tables are built from.
FACTS = ("customer.parquet", "orders.parquet", "lineitem.parquet")
_WRITTEN: dict[tuple, tuple[str, T.StructType]] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """What a folder of tables holds now: name, time, number and length of files of each table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = [(s, fs.getContentSummary(s.getPath())) for s in fs.listStatus(path)]
    return tuple(sorted((s.getPath().getName(), s.getModificationTime(), c.getFileCount(), c.getLength()) for s, c in tables))


def written_once(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write what ``build`` returns once per application and state of the input folder; later queries read that table.

    Once it is written, tables that ``build`` wrote on its way and the shuffles behind them are let go, so the disk holds
    those of one build at a time.
    """

    @wraps(build)
    def rows(spark: SparkSession, sf: str) -> DataFrame:
        state = _state(spark, sf)
        key = (spark.sparkContext.applicationId, drops(spark), sf, state, f"{build.__module__}.{build.__name__}")
        if key not in _WRITTEN:
            before = set(cuts(spark))
            with partitions_for(spark, sum(length for name, _, _, length in state if name in FACTS)):
                df = build(spark, sf)
                _WRITTEN[key] = written(df), df.schema
            del df
            shared = {path for path, _ in _WRITTEN.values()}
            drop_tables(spark, [path for path in cuts(spark) if path not in before and path not in shared])
            free_shuffles(spark)
        path, schema = _WRITTEN[key]
        return spark.read.schema(schema).parquet(path)

    return rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def category_of(entity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (entity % 5).cast("int") + 1)


def season_week(date: str = "o_orderdate") -> list[Column]:
    return [F.year(date).alias("season"), F.month(date).alias("week")]


def orders_of(spark: SparkSession, sf: str, seasons: Sequence[int] | None) -> DataFrame:
    """Orders, of some seasons only: as date ranges, which reach the scan."""
    rows = table(spark, sf, "orders")
    return rows.where(in_years("o_orderdate", seasons)) if seasons else rows


def order_items(spark: SparkSession, sf: str, *columns: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """lineitem with its order's season and week; only the named columns are scanned."""
    dates = orders_of(spark, sf, seasons).select("o_orderkey", *season_week(), *[c for c in columns if c.startswith("o_")])
    items = table(spark, sf, "lineitem").select(*dict.fromkeys(["l_orderkey", *[c for c in columns if c.startswith("l_")]]))
    return items.join(dates, items.l_orderkey == dates.o_orderkey).drop("o_orderkey")


def perf(spark: SparkSession, sf: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """One row per entity and period: group, category, stats and points."""
    items = order_items(spark, sf, "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", seasons=seasons)
    stats = items.groupBy("season", "week", F.col("l_suppkey").alias("entity")).agg(
        F.count(F.lit(1)).cast("double").alias("carries"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("receptions"),
        F.sum("l_quantity").alias("receiving_yards"),
        F.sum(F.floor(F.col("l_extendedprice") / 1000.0)).cast("double").alias("rushing_yards"),
    )
    owner = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"))
    rows = stats.join(owner, "entity").withColumn("category", category_of(F.col("entity")))
    return score(rows, RULES)


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Symmetric round robin over the groups, one bye each week (opp NULL)."""
    opp = F.pmod(F.col("week") - F.col("grp"), F.lit(GROUPS))
    rows = (
        table(spark, sf, "orders").select(F.year("o_orderdate").alias("season")).distinct()
        .withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))))
        .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
        .withColumn("opp", F.when(opp != F.col("grp"), opp))
    )
    return rows.select("season", "week", "grp", "opp", (F.col("grp") < F.col("opp")).alias("home"))


def with_final(sched: DataFrame) -> DataFrame:
    """Games only, with the completion flag."""
    late = (F.col("week") > PARTIAL_WEEK) | (
        (F.col("week") == PARTIAL_WEEK) & (F.least("grp", "opp") % 2 == 1)
    )
    return sched.where(F.col("opp").isNotNull()).withColumn("final", ~((F.col("season") == PARTIAL_SEASON) & late))


def games(spark: SparkSession, sf: str) -> DataFrame:
    return with_final(schedule(spark, sf))


def played(spark: SparkSession, sf: str) -> DataFrame:
    return games(spark, sf).where("final")


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Played games x categories with points."""
    return dense_points(played(spark, sf), points_by_group(perf(spark, sf)), CATEGORIES)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """One row per group and played game with its total."""
    return dense(spark, sf).groupBy("season", "week", "grp", "opp", "home").agg(F.sum("pts").alias("pf"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Team games: manager, points for and against, opponent, result, playoff flag."""
    rows = with_opponent(scores(spark, sf), ["season", "week"], {"pf": "pa"})
    result = F.when(F.col("pf") > F.col("pa"), "W").when(F.col("pf") < F.col("pa"), "L").otherwise("T")
    return rows.select(
        "season", "week", F.col("grp").alias("manager"), "pf", "opp", "pa",
        (F.col("week") > 10).alias("playoff"), result.alias("result"),
    )


# Sources, entities and teams of the auction binding. Entities are ranges of part keys, so their
# number grows with the tables.
PARTS_PER_ENTITY, NAMED_SOURCE, LEGACY_LAST, FLAT_COST = 100, 0, 1998, 2.0
BAD_IDS = ("7", "14")


def part_entity() -> Column:
    return F.floor(F.col("l_partkey") / PARTS_PER_ENTITY).cast("long")


def claims(spark: SparkSession, sf: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """Bid rows as landed: one per claim, contingent variants included, without what ``described`` derives."""
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source"))
    placed = orders_of(spark, sf, seasons).select("o_orderkey", "o_custkey", "o_orderpriority", *season_week()).join(sources, "o_custkey")
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    rows = items.join(placed, items.l_orderkey == placed.o_orderkey).withColumn("entity", part_entity())
    status = F.when(F.col("l_returnflag") == "R", "EXECUTED").when(F.col("l_returnflag") == "A", "OUTBID").otherwise("INVALID")
    return rows.select(
        "source", "season", "week", "entity", F.col("l_suppkey").alias("team"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "FREEAGENT").otherwise("WAIVER").alias("kind"), status.alias("status"),
        (F.floor(F.col("l_extendedprice") / 250.0) / 4.0).alias("bid"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("tid"))


def described(rows: DataFrame) -> DataFrame:
    """Claims with their entity's category and their id, which other columns give: no shuffle need carry them."""
    return rows.withColumns({
        "category": category_of(F.col("entity")),
        "txn": F.when(F.col("tid.l_linenumber") != 7, F.col("tid.l_orderkey").cast("string"))})


def raw_bids(spark: SparkSession, sf: str, seasons: Sequence[int] | None = None) -> DataFrame:
    return described(claims(spark, sf, seasons))


@written_once
def collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return ev.collapse_variants(claims(spark, sf))


def bids(spark: SparkSession, sf: str) -> DataFrame:
    """Collapsed and classified bids.

    Everything downstream reads them several times (budgets, auction facts, free candidates), so they
    are written once collapsed instead of joining and collapsing the raw rows for every reader. What other columns
    give is worked out on reading and takes no disk.
    """
    flat = F.when(F.col("source") == NAMED_SOURCE, FLAT_COST).otherwise(0.0)
    return ev.classify(described(collapsed(spark, sf)), flat)


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Size and current budget of each source."""
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("source"), (8 + F.col("n_nationkey") % 5).alias("size"),
        (F.lit(800.0) + F.col("n_nationkey")).alias("current_budget"))


def reported_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets reported per source and season; some seasons are missing."""
    seasons = F.explode(F.sequence(F.lit(1990), F.lit(PARTIAL_SEASON)))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"), seasons.alias("season"))
    return rows.where((F.col("source") + F.col("season")) % 3 != 0).withColumn(
        "reported_budget", F.lit(1000.0) + 10 * F.col("source"))


def budgets(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return ev.effective_budgets(
        rows, reported_budgets(spark, sf), provenance(spark, sf), NAMED_SOURCE, LEGACY_LAST, BAD_IDS)


def priced_bids(spark: SparkSession, sf: str) -> DataFrame:
    """Bids with the budget of their source and season and the bid as a share of it."""
    rows = bids(spark, sf)
    return rows.join(budgets(spark, sf, rows), ["source", "season"], "left").withColumn("pct", ratio("bid", "budget"))


@written_once
def budgeted_bids(spark: SparkSession, sf: str) -> DataFrame:
    """Priced bids with their auction's facts, without the keys that no statistic reads."""
    return ev.event_stats(priced_bids(spark, sf).drop("tid", "txn", "status", "variants_dropped"))


def rostered(rows: DataFrame) -> DataFrame:
    """Who owns whom: an entity won in a week is owned in the next."""
    return rows.where(F.col("signal") == "won").select("source", "season", (F.col("week") + 1).alias("week"), "entity").distinct()


@written_once
def part_perf(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly stats of the auctioned entities."""
    items = order_items(spark, sf, "l_partkey", "l_quantity", "l_returnflag")
    return items.groupBy("season", "week", part_entity().alias("entity")).agg(
        F.count(F.lit(1)).cast("double").alias("snaps"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("carries"),
        F.sum("l_quantity").alias("yards"),
    ).withColumns({
        "category": category_of(F.col("entity")), "grp": (F.col("entity") % 2).cast("int"),
        "pts": 0.25 * F.col("snaps") + 0.0625 * F.col("yards")})
