"""Landed JSON documents (one per row, column ``body``) to rows. Malformed documents give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKINGS = "struct<scoring string, page string, taken string, players array<struct<id bigint, name string, team string, ecr double, avg string>>>"
BIDS = "struct<week int, transactions array<struct<id bigint, team bigint, type string, status string, bid double, items array<struct<type string, entity bigint>>>>>"
PROJECTION = "struct<entity bigint, week int, stats map<string,double>>"
SCOREBOARD = "struct<state string, period int, clock string, home string, away string, sent bigint>"
SETTINGS = "struct<source bigint, roster_size int, slots map<string,int>, scoring array<struct<item string, points double>>>"
ROSTER = "struct<team bigint, name string, players array<struct<id bigint, name string, position string, status string, slot string>>>"
OWNERSHIP = "struct<entity bigint, status string, clears bigint, change double>"
LINEUPS = "struct<period int, match bigint, piece int, sides array<struct<team bigint, lineup array<struct<entity bigint, slot string, pts double>>>>>"
MATCHES = "struct<period int, matches array<struct<home bigint, away bigint, home_score double, away_score double>>>"


def parse(docs: DataFrame, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Permissive parse; a body that is not JSON of the shape is dropped."""
    ddl = schema[len("struct<"):-1].replace(": ", " ") if schema.startswith("struct<") else schema
    rows = docs.withColumn("_d", F.from_json("body", f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.where(F.col("_d").isNotNull() & F.col("_d._bad").isNull()).select(*(keep or []), "_d.*").drop("_bad")


def ranking_rows(docs: DataFrame, expected_scoring: str) -> DataFrame:
    """Ranking documents to rows, wrong scoring formats rejected, empty text numbers to NULL."""
    rows = parse(docs, RANKINGS).where(F.col("scoring") == expected_scoring)
    flat = rows.select("page", "taken", F.explode("players").alias("p"))
    return flat.select("page", "taken", F.col("p.id").alias("id"), F.col("p.name").alias("name"), F.col("p.team").alias("team"),
                       F.col("p.ecr").alias("rank_ecr"), F.expr("try_cast(nullif(p.avg, '') AS double)").alias("rank_avg"))


def bid_rows(docs: DataFrame, cents: bool = False) -> DataFrame:
    """Transactions to bid rows: pending ones skipped, the first added entity, all dropped ones."""
    t = parse(docs, BIDS).select("week", F.explode("transactions").alias("t")).select("week", "t.*")
    added = F.filter("items", lambda i: i["type"] == "ADD")
    rows = t.where((F.col("status") != "PENDING") & (F.size(added) > 0))
    return rows.select(
        "week", "id", "team", "type", "status", (F.col("bid") / (100 if cents else 1)).alias("bid"), added[0]["entity"].alias("entity"),
        F.transform(F.filter("items", lambda i: i["type"] == "DROP"), lambda i: i["entity"]).alias("dropped"))


def projection_rows(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Stat maps to stat columns; records without any known stat are stubs and dropped."""
    rows = parse(docs, PROJECTION)
    known = F.array(*[F.lit(k) for k in names])
    rows = rows.where(F.col("stats").isNotNull() & F.arrays_overlap(F.map_keys("stats"), known))
    return rows.select("entity", "week", *[F.coalesce(F.try_element_at("stats", F.lit(k)), F.lit(0.0)).alias(n) for k, n in names.items()])


def later_source_wins(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Union of two landed tables; where both speak the second wins. NULL is not a value."""
    both = first.select(*keys, value, F.lit(1).alias("_p")).unionByName(second.select(*keys, value, F.lit(2).alias("_p")))
    return both.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, "_p").alias(value))


def scoreboards(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scoreboard documents to one row per team (grp, state, period, clock, sent), and the documents that
    cannot be read, with the reason. Works on batches and streams."""
    d = F.from_json("body", f"{SCOREBOARD[len('struct<'):-1]}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = docs.select("body", d.alias("d")).withColumn(
        "reason", F.when(F.col("d").isNull() | F.col("d._bad").isNotNull() | F.col("d.state").isNull(), "not a scoreboard")
        .when(F.col("d.home").isNull() | F.col("d.away").isNull(), "no teams"))
    sides = rows.where(F.col("reason").isNull()).select(F.explode(F.array("d.home", "d.away")).alias("grp"), "d.state", "d.period", "d.clock", "d.sent")
    return sides, rows.where(F.col("reason").isNotNull()).select("body", "reason")


PIECE = 64


def lineup_documents(rows: DataFrame) -> DataFrame:
    """Match documents from line-up rows (period, match, team, place from 1, entity, slot, pts): a line-up of
    any length goes into pieces of ``PIECE`` places, so no document is unbounded."""
    piece = F.floor((F.col("place") - 1) / PIECE).cast("int").alias("piece")
    sides = rows.groupBy("period", "match", "team", piece).agg(
        F.array_sort(F.collect_list(F.struct("place", "entity", "slot", "pts"))).alias("lineup"))
    sides = sides.withColumn("lineup", F.transform("lineup", lambda p: F.struct(p["entity"].alias("entity"), p["slot"].alias("slot"), p["pts"].alias("pts"))))
    whole = sides.groupBy("period", "match", "piece").agg(F.array_sort(F.collect_list(F.struct("team", "lineup"))).alias("sides"))
    return whole.select(F.to_json(F.struct("period", "match", "piece", "sides")).alias("body"))


def lineup_rows(docs: DataFrame, current_period: int | None = None) -> DataFrame:
    """Match documents to (period, team, place, entity, slot, pts): place by position in the line-up, points
    that are missing as zero, byes (no team) and periods that are not over left out."""
    rows = parse(docs, LINEUPS)
    rows = rows if current_period is None else rows.where(F.col("period") < current_period)
    side = rows.select("period", "piece", F.explode("sides").alias("s")).where(F.col("s.team").isNotNull())
    return side.select("period", "piece", F.col("s.team").alias("team"), F.posexplode("s.lineup").alias("at", "p")).select(
        "period", "team", (F.col("piece") * PIECE + F.col("at") + 1).alias("place"), "p.entity", "p.slot", F.coalesce("p.pts", F.lit(0.0)).alias("pts"))


def settings_rows(docs: DataFrame, known_slots: dict[str, list[str]]) -> DataFrame:
    """Starting slots with their categories; an unknown slot in use is an error."""
    rows = parse(docs, SETTINGS).withColumn("slots", F.map_filter("slots", lambda k, n: n > 0))
    table = F.create_map(*[x for k, v in known_slots.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    out = rows.select("source", "roster_size", F.explode("slots").alias("slot", "n"))
    found = F.coalesce(F.try_element_at(table, F.col("slot")), F.raise_error(F.concat(F.lit("unknown slot: "), F.col("slot"))).cast("array<string>"))
    return out.withColumn("categories", found)


def scoring_rows(docs: DataFrame) -> DataFrame:
    return parse(docs, SETTINGS).select("source", F.explode("scoring").alias("s")).select("source", "s.item", "s.points")


def roster_rows(docs: DataFrame) -> DataFrame:
    """Rosters to entity rows with defaults for missing status and slot."""
    rows = parse(docs, ROSTER).select("team", F.col("name").alias("team_name"), F.explode("players").alias("p"))
    return rows.select("team", "team_name", F.col("p.id").alias("entity"), F.col("p.name").alias("name"), F.col("p.position").alias("position"),
                       F.coalesce("p.status", F.lit("ACTIVE")).alias("status"), F.coalesce("p.slot", F.lit("BE")).alias("slot"))


def waiver_rows(docs: DataFrame) -> DataFrame:
    """Entities on waivers with the instant they clear."""
    rows = parse(docs, OWNERSHIP).where(F.col("status") == "WAIVERS")
    return rows.select("entity", F.timestamp_millis("clears").alias("clears_at"), "change")


def ownership_changes(docs: DataFrame) -> DataFrame:
    return parse(docs, OWNERSHIP).select("entity", F.coalesce("change", F.lit(0.0)).alias("change"))


def match_rows(docs: DataFrame, current_period: int) -> DataFrame:
    """Matches with scores only where the period has been played; byes skipped."""
    m = parse(docs, MATCHES).select("period", F.explode("matches").alias("m")).select("period", "m.*")
    played = F.col("period") < current_period
    return m.where(F.col("home").isNotNull() & F.col("away").isNotNull()).select(
        "period", "home", "away", F.when(played, F.col("home_score")).alias("home_score"), F.when(played, F.col("away_score")).alias("away_score"))
