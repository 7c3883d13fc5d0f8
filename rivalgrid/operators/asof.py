"""As-of and range lookups.

Period calendars are short, so facts are first reduced to one row per key and period (partial
aggregation takes care of hot keys) and only then carried forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_cutoff_after(when: str, cutoffs: Sequence[str], strict: bool = True) -> Column:
    """Index (1-based) of the first cutoff that sees a fact; NULL after the last one."""
    out = F.lit(None).cast("int")
    for i in range(len(cutoffs), 0, -1):
        edge = F.lit(cutoffs[i - 1]).cast("date")
        out = F.when((F.col(when) < edge) if strict else (F.col(when) <= edge), i).otherwise(out)
    return out


def carry_forward(facts: DataFrame, by: Sequence[str], period: str, value: str, last_period: int) -> DataFrame:
    """Each value holds until the next one of its key: rows for every period from the first value on."""
    until = F.coalesce(F.lead(period).over(Window.partitionBy(*by).orderBy(period)), F.lit(last_period + 1))
    held = facts.where(F.col(period) <= last_period).withColumn("_until", until - 1)
    return held.select(*by, F.explode(F.sequence(period, "_until")).alias(period), value)


def asof_before(
    facts: DataFrame, by: Sequence[str], when: str, value: str, cutoffs: Sequence[str], tie: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Latest value strictly before (or at) each cutoff date: (by, cutoff index, value)."""
    seen = facts.withColumn("cutoff", first_cutoff_after(when, cutoffs, strict)).where(F.col("cutoff").isNotNull())
    latest = seen.groupBy(*by, "cutoff").agg(F.max_by(value, F.struct(when, *tie)).alias(value))
    return carry_forward(latest, by, "cutoff", value, len(cutoffs))


def blackout(facts: DataFrame, by: Sequence[str], when: str, cutoffs: Sequence[str]) -> DataFrame:
    """Cutoffs at or before the first fact of the key: nothing is known then."""
    first = facts.groupBy(*by).agg(F.min(when).alias("first_seen"))
    grid = first.withColumn("_c", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("cutoff"), F.lit(c).cast("date").alias("on")) for i, c in enumerate(cutoffs)])))
    return grid.select(*by, "_c.cutoff", "first_seen", (F.col("_c.on") <= F.col("first_seen")).alias("blackout"))


def in_interval(rows: DataFrame, spans: DataFrame, by: Sequence[str], when: str, start: str, end: str, keep: Sequence[str]) -> DataFrame:
    """Rows with the half-open interval [start, end) that holds them, keyed on ``by``."""
    s = spans.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), *keep)
    joined = rows.join(s, list(by))
    return joined.where((F.col(when) >= F.col("_s")) & (F.col(when) < F.col("_e"))).drop("_s", "_e")


def ladder(value: Column, edges: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose ceiling exceeds the value."""
    out = F.lit(otherwise)
    for ceiling, label in reversed(list(edges)):
        out = F.when(value < ceiling, label).otherwise(out)
    return out


def era_of(season: Column, eras: Sequence[tuple[str, int | None, int | None]]) -> Column:
    """Name of the first era whose open-ended range holds the season; the last era otherwise."""
    out = F.lit(eras[-1][0])
    for name, low, high in reversed(list(eras)):
        cond = F.lit(True)
        if low is not None:
            cond = cond & (season >= low)
        if high is not None:
            cond = cond & (season <= high)
        out = F.when(cond, name).otherwise(out)
    return out
