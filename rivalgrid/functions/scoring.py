"""Rule sets compiled to one Column.

A rule set is a list of (item, points). Each item names an expression over stat columns. The
whole set becomes a single sum, so scoring a row costs no join and stays in generated code.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import nz

# Item -> weighted sum of stat columns (row items).
ROW_SUMS: dict[str, dict[str, float]] = {
    "PA": {"attempts": 1},
    "PC": {"completions": 1},
    "INC": {"attempts": 1, "completions": -1},
    "PY": {"passing_yards": 1},
    "PTD": {"passing_tds": 1},
    "2PC": {"passing_2pt_conversions": 1},
    "INTT": {"passing_interceptions": 1},
    "RA": {"carries": 1},
    "RY": {"rushing_yards": 1},
    "RTD": {"rushing_tds": 1},
    "2PR": {"rushing_2pt_conversions": 1},
    "RECS": {"receptions": 1},
    "REC": {"receptions": 1},
    "REY": {"receiving_yards": 1},
    "RETD": {"receiving_tds": 1},
    "2PRE": {"receiving_2pt_conversions": 1},
    "FTD": {"fumble_recovery_tds": 1},
    "PFUM": {"sack_fumbles": 1},
    "RFUM": {"rushing_fumbles": 1},
    "REFUM": {"receiving_fumbles": 1},
    "FUM": {"fumbles_total": 1},
    "PFUML": {"sack_fumbles_lost": 1},
    "RFUML": {"rushing_fumbles_lost": 1},
    "REFUML": {"receiving_fumbles_lost": 1},
    "FUML": {"fumbles_lost_total": 1},
    "TT": {"passing_interceptions": 1, "fumbles_lost_total": 1},
    "KRTD": {"special_teams_tds": 1},
    "PRTD": {"special_teams_tds": 1},
    "PAT": {"pat_made": 1},
    "PATA": {"pat_att": 1},
    "PATM": {"pat_missed": 1},
    "FG": {"fg_made": 1},
    "FGA": {"fg_att": 1},
    "FGM": {"fg_missed": 1},
    "FG0": {"fg_made_0_19": 1, "fg_made_20_29": 1, "fg_made_30_39": 1},
    "FGM0": {"fg_missed_0_19": 1, "fg_missed_20_29": 1, "fg_missed_30_39": 1},
    "FG40": {"fg_made_40_49": 1},
    "FGM40": {"fg_missed_40_49": 1},
    "FG50": {"fg_made_50_59": 1},
    "FGM50": {"fg_missed_50_59": 1},
    "FG60": {"fg_made_60_": 1},
    "FGM60": {"fg_missed_60_": 1},
    "FG50P": {"fg_made_50_59": 1, "fg_made_60_": 1},
    "FGM50P": {"fg_missed_50_59": 1, "fg_missed_60_": 1},
    "KR": {"kickoff_return_yards": 1},
    "PR": {"punt_return_yards": 1},
    "FGA50": {"fg_made_50_59": 1, "fg_missed_50_59": 1},
    "FGA60": {"fg_made_60_": 1, "fg_missed_60_": 1},
    "SKD": {"sacks_suffered": 1},
    "RET": {"targets": 1},
    "RFD": {"rushing_first_downs": 1},
    "REFD": {"receiving_first_downs": 1},
    "FGY": {
        "fg_made_0_19": 18,
        "fg_made_20_29": 25,
        "fg_made_30_39": 35,
        "fg_made_40_49": 45,
        "fg_made_50_59": 55,
        "fg_made_60_": 62,
    },
}

# One point per full step; (stat columns, {item: step}).
ROW_STEPS: list[tuple[dict[str, float], dict[str, int]]] = [
    ({"passing_yards": 1}, {"PY5": 5, "PY10": 10, "PY20": 20, "PY25": 25, "PY50": 50, "PY100": 100}),
    ({"rushing_yards": 1}, {"RY5": 5, "RY10": 10, "RY20": 20, "RY25": 25, "RY50": 50, "R100": 100}),
    ({"receiving_yards": 1}, {"REY5": 5, "REY10": 10, "REY20": 20, "REY25": 25, "REY50": 50, "RE100": 100}),
    ({"receptions": 1}, {"REC5": 5, "REC10": 10}),
    ({"attempts": 1, "completions": -1}, {"IP10": 10}),
    ({"completions": 1}, {"PC10": 10}),
    ({"carries": 1}, {"RA5": 5, "RA10": 10}),
    ({"kickoff_return_yards": 1}, {"KR10": 10, "KR25": 25}),
    ({"punt_return_yards": 1}, {"PR10": 10, "PR25": 25}),
]

# 1 when low <= column < high; an open end is None.
ROW_BONUS: dict[str, tuple[str, float, float | None]] = {
    "P300": ("passing_yards", 300, 400),
    "P400": ("passing_yards", 400, None),
    "RY100": ("rushing_yards", 100, 200),
    "RY200": ("rushing_yards", 200, None),
    "REY100": ("receiving_yards", 100, 200),
    "REY200": ("receiving_yards", 200, None),
}

# Unit items.
UNIT_SUMS: dict[str, dict[str, float]] = {
    "SK": {"def_sacks": 1},
    "HALFSK": {"def_sacks": 1},
    "INT": {"def_interceptions": 1},
    "FR": {"fumble_recovery_opp": 1},
    "FF": {"def_fumbles_forced": 1},
    "SF": {"def_safeties": 1},
    "BLKK": {"def_punt_blocks": 1, "def_pat_blocks": 1, "def_fg_blocks": 1},
    "DEFRETTD": {"def_tds": 1},
    "INTTD": {"def_tds": 1},
    "BLKKRTD": {"def_tds": 1},
    "FRTD": {"fumble_recovery_tds": 1},
    "TRTD": {"special_teams_tds": 1},
    "2PRET": {},
    "1PSF": {},
    "PTSA": {"points_allowed": 1},
    "DPTSA": {"points_allowed": 1},
    "YA": {"yards_allowed": 1},
}

# Inclusive brackets on what the opponent did.
POINT_BRACKETS = {
    "PA0": (0, 0), "PA1": (1, 6), "PA7": (7, 13), "PA14": (14, 17), "PA18": (18, 21),
    "PA22": (22, 27), "PA28": (28, 34), "PA35": (35, 45), "PA46": (46, None),
}
YARD_BRACKETS = {
    "YA100": (0, 99), "YA199": (100, 199), "YA299": (200, 299), "YA349": (300, 349), "YA399": (350, 399),
    "YA449": (400, 449), "YA499": (450, 499), "YA549": (500, 549), "YA550": (550, None),
}

# Items backed by one column (the first one listed is kept), items always zero.
SAME_COLUMN = ("KRTD", "PRTD")
ALWAYS_ZERO = ("2PRET", "1PSF")
# Items without any of which kickers do not score.
KICKING = ("FG0", "FG40", "FG50", "FG60", "FG", "PAT")


def _total(parts: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, weight in parts.items():
        out = out + nz(name) * F.lit(float(weight))
    return out


def _between(name: str, low: float, high: float | None, inclusive: bool) -> Column:
    value = nz(name)
    cond = value >= F.lit(float(low))
    if high is not None:
        cond = cond & ((value <= F.lit(float(high))) if inclusive else (value < F.lit(float(high))))
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def _row_item(item: str) -> Column | None:
    if item in ROW_SUMS:
        return _total(ROW_SUMS[item])
    for parts, steps in ROW_STEPS:
        if item in steps:
            return F.floor(_total(parts) / F.lit(float(steps[item]))).cast("double")
    if item in ROW_BONUS:
        return _between(*ROW_BONUS[item], inclusive=False)
    return None


def _unit_item(item: str) -> Column | None:
    if item in UNIT_SUMS:
        return _total(UNIT_SUMS[item])
    plain = item[1:] if item.startswith("D") and item[1:] in POINT_BRACKETS else item
    if plain in POINT_BRACKETS:
        return _between("points_allowed", *POINT_BRACKETS[plain], inclusive=True)
    if item in YARD_BRACKETS:
        return _between("yards_allowed", *YARD_BRACKETS[item], inclusive=True)
    return None


def known_items(unit: bool) -> set[str]:
    if unit:
        return set(UNIT_SUMS) | set(POINT_BRACKETS) | {"D" + k for k in POINT_BRACKETS} | set(YARD_BRACKETS)
    return set(ROW_SUMS) | {i for _, steps in ROW_STEPS for i in steps} | set(ROW_BONUS)


def needed_columns(items: Iterable[str], unit: bool = False) -> set[str]:
    """Stat columns a rule set reads, so a scan can be narrowed to them."""
    out: set[str] = set()
    for item in items:
        if unit:
            out |= set(UNIT_SUMS.get(item, {}))
            if item.lstrip("D") in POINT_BRACKETS:
                out.add("points_allowed")
            if item in YARD_BRACKETS:
                out.add("yards_allowed")
            continue
        out |= set(ROW_SUMS.get(item, {}))
        for parts, steps in ROW_STEPS:
            if item in steps:
                out |= set(parts)
        if item in ROW_BONUS:
            out.add(ROW_BONUS[item][0])
    return out


def validate_rules(
    rules: Iterable[tuple[str, float]], unit: bool = False, ignored: Iterable[str] = ()
) -> list[tuple[str, float]]:
    """Check a rule set on the driver and return the items to compute.

    Items of the other domain and zero-point items are left out, one of two items that count the
    same thing is kept, an item listed in ``ignored`` is warned about, an unknown one is an error.
    """
    own, other = known_items(unit), known_items(not unit)
    ignored = set(ignored)
    kept: dict[str, float] = {}
    for item, points in rules:
        if not points:
            continue
        if item in own:
            kept[item] = float(points)
        elif item in other:
            continue
        elif item in ignored:
            warnings.warn(f"scoring item {item} cannot be computed from the stat rows", stacklevel=2)
        else:
            raise ValueError(f"unknown scoring item: {item}")
    for item in [i for i in kept if i in SAME_COLUMN][1:]:
        del kept[item]
    for item in [i for i in kept if i in ALWAYS_ZERO]:
        warnings.warn(f"scoring item {item} is never observed and counts as zero", stacklevel=2)
    return list(kept.items())


def compile_rules(rules: Iterable[tuple[str, float]], unit: bool = False, ignored: Iterable[str] = ()) -> Column:
    """One Column: the sum of points times item expression."""
    out = F.lit(0.0)
    for item, points in validate_rules(rules, unit, ignored):
        expr = _unit_item(item) if unit else _row_item(item)
        out = out + F.lit(points) * expr
    return out


def with_stat_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add absent stat columns as zero, so any source fits any rule set."""
    missing = {n: F.lit(0.0) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def score(df: DataFrame, rules: Iterable[tuple[str, float]], unit: bool = False, name: str = "pts") -> DataFrame:
    rules = list(rules)
    df = with_stat_columns(df, needed_columns([r[0] for r in rules], unit))
    return df.withColumn(name, compile_rules(rules, unit))


def default_rules(reception_points: float = 0.5, overrides: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """A standard rule set; overrides replace or add items, a zero removes one."""
    # The usual default template.
    base = {
        "PY": 0.04, "PTD": 4, "INTT": -2, "2PC": 2,
        "RY": 0.1, "RTD": 6, "2PR": 2,
        "REY": 0.1, "RETD": 6, "2PRE": 2, "REC": reception_points,
        "FUML": -2, "FTD": 6, "KRTD": 6, "PRTD": 6,
        "FG0": 3, "FG40": 4, "FG50": 5, "FG60": 5, "PAT": 1, "FGM": -1,
        "SK": 1, "INT": 2, "FR": 2, "SF": 2, "BLKK": 2,
        "INTTD": 6, "FRTD": 6, "BLKKRTD": 6, "TRTD": 6,
        "PA0": 5, "PA1": 4, "PA7": 3, "PA14": 1, "PA18": 0, "PA22": 0, "PA28": -1, "PA35": -3, "PA46": -5,
        "YA100": 5, "YA199": 3, "YA299": 2, "YA349": 0, "YA399": -1, "YA449": -3, "YA499": -5,
        "YA549": -6, "YA550": -7,
    }
    base.update(overrides or {})
    return [(k, v) for k, v in base.items() if v]


def rules_by_source(template: Iterable[tuple[str, float]], overrides: DataFrame) -> DataFrame:
    """(source, item, points): the template for every source of ``overrides`` (source, item, points), its own
    points where it has any (a row without an item only names the source). Zero removes an item."""
    base = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(float(p)).alias("points")) for i, p in template])
    rows = overrides.select("source").distinct().select("source", F.explode(base).alias("r")).select("source", "r.*", F.lit(0).alias("own"))
    own = overrides.where(F.col("item").isNotNull()).select("source", "item", F.col("points").cast("double").alias("points"), F.lit(1).alias("own"))
    both = rows.unionByName(own)
    # a source has at most a catalogue of items
    return both.groupBy("source", "item").agg(F.max_by("points", "own").alias("points")).where(F.col("points") != 0)


def rules_in_words(rules: DataFrame) -> DataFrame:
    """Per source: its rules as one sentence in order of item, how many can be computed, the items that
    cannot, and the categories the rules score: kickers need a kicking item, units one of theirs, all
    others an item of theirs."""
    players, units = known_items(False), known_items(True)
    usable = F.col("item").isin(*sorted(players | units)) & ~F.col("item").isin(*sorted(ALWAYS_ZERO))
    said = F.concat(F.col("item"), F.lit(": "), F.format_string("%.3f", "points"))
    def scored(items: set[str]) -> Column:
        return F.max(F.col("item").isin(*sorted(items)) & usable)
    rows = rules.groupBy("source").agg(
        F.array_sort(F.collect_list(F.when(usable, said))).alias("said"), F.array_sort(F.collect_list(F.when(~usable, F.col("item")))).alias("left"),
        scored(set(KICKING)).alias("K"), scored(units).alias("DST"), scored({i for i in players if i[:2] != "FG" and i[:3] != "PAT"}).alias("players"))
    categories = F.array_compact(F.array(F.when(F.col("players"), "players"), F.when(F.col("K"), "K"), F.when(F.col("DST"), "DST")))
    return rows.select("source", F.size("said").alias("n_items"), F.array_join("said", "; ").alias("words"), F.array_join("left", ",").alias("unused"), F.array_join(categories, ",").alias("categories"))


def scored_categories(points: DataFrame, category: str = "category", pts: str = "pts") -> DataFrame:
    """Categories that score anything under the current rules."""
    return (
        points.groupBy(category).agg(F.max(F.abs(F.col(pts))).alias("_top"))
        .where(F.col("_top") > 0).select(category)
    )
