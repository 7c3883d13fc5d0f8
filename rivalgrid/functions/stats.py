"""Stat-line Column builders: kicks, conversions, presentation values, source profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivalgrid.functions.numeric import nz

# Stat columns shown per category.
STAT_BLOCKS = {
    "QB": ("passing_yards", "passing_tds", "rushing_yards"),
    "RB": ("carries", "rushing_yards", "receptions", "receiving_yards"),
    "WR": ("targets", "receptions", "receiving_yards"),
    "TE": ("targets", "receptions", "receiving_yards"),
    "K": ("fg_made", "pat_made"),
}
CATEGORY_ORDER = ("QB", "RB", "WR", "TE", "K", "DST")
FLEX = ("RB", "WR", "TE")


def two_point_conversions() -> Column:
    return nz("passing_2pt_conversions") + nz("rushing_2pt_conversions") + nz("receiving_2pt_conversions")


def blocked_in(list_column: Column, low: int, high: int | None) -> Column:
    """How many distances of a ';'-separated list fall into a bucket."""
    parts = F.transform(F.split(list_column, ";"), lambda x: F.trim(x).try_cast("double"))
    inside = F.filter(parts, lambda d: (d >= low) & ((d <= high) if high is not None else F.lit(True)))
    return F.when(list_column.isNotNull(), F.size(inside))


def attempts(made: Column, missed: Column, blocked: Column) -> Column:
    """Made plus missed plus blocked; NULL when nothing is reported."""
    known = made.isNotNull() | missed.isNotNull() | blocked.isNotNull()
    return F.when(known, nz(made) + nz(missed) + nz(blocked))


def next_period(current: Column, started: Column) -> Column:
    """One ahead once the current period has begun."""
    return F.when(started == current, current + 1).otherwise(current)


def score_of(period: Column, current: Column, final: Column, live: Column, projected: Column) -> Column:
    """Past: the final score; running: the live one, else the projection; future: the projection."""
    return F.when(period < current, final).when(period == current, F.coalesce(live, projected)).otherwise(projected)


def rank_ratio(rank: Column, total: int = 32) -> Column:
    """Rank 1..total to 1..0."""
    return F.when(rank.isNotNull(), 1 - (rank - 1) / F.lit(float(total - 1)))


def probability_band(p: Column) -> Column:
    """-1..1 around an even match."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p - 0.5) * 2))


def category_order(category: Column, order: Sequence[str] = CATEGORY_ORDER) -> Column:
    at = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def matches_search(name: Column, text: str) -> Column:
    return F.lower(name).contains(text.strip().lower())


def row_filter(name: Column, owner: Column, category: Column, *, text: str, ownership: str, mine, group: str, on_waivers: Column) -> Column:
    """Search text and category group, and (own rows or the ownership mode)."""
    modes = {"available": owner.isNull(), "owned": owner.isNotNull(), "waivers": F.coalesce(on_waivers, F.lit(False)), "all": F.lit(True)}
    own = F.coalesce(owner == mine, F.lit(False)) if mine is not None else F.lit(False)
    passes = modes[ownership] if (ownership != "all" or mine is None) else F.lit(False)
    in_group = F.lit(True) if group == "ALL" else category.isin(*FLEX) if group == "FLEX" else category == group
    return matches_search(name, text) & (own | passes) & in_group


def reception_label(points: Column) -> Column:
    """Scoring label bands by reception points."""
    return (F.when(points >= 0.9, "PPR").when(points >= 0.4, "Half PPR")
            .when(points > 0, F.concat(points.cast("string"), F.lit(" PPR"))).otherwise("Standard"))


def slot_group(slots: Column, ids: Sequence[str]) -> Column:
    """Sum of a slot map over a group of slot ids."""
    return F.aggregate(F.array(*[F.coalesce(F.try_element_at(slots, F.lit(i)), F.lit(0)) for i in ids]), F.lit(0), lambda a, x: a + x)


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, in order."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda r: r.isNotNull())
