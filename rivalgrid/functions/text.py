"""Text and time Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name suffixes, zone abbreviations, weather words by class.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
ZONES = ("EDT", "EST")
WEATHER_CLASSES = (("Snow", "snow"), ("Wintry Mix", "sleet|fzra"), ("Thunderstorm", "tsra"), ("Rain", "rain"))
RESERVE_STATUSES = ("OUT", "INJURY_RESERVE")
# What a name key leaves out, and the form of a value constraint in a comment.
NAME_PUNCTUATION = r"[.'`,]"
CONSTRAINT = r"(?i)leagues with\s+(-?[\d.]+)(?:\s*-\s*(-?[\d.]+))?"


def merge_name(name: Column) -> Column:
    """Lower case, no punctuation, single spaces, no suffix: spellings of one name collide."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), NAME_PUNCTUATION, ""), r"\s+", " "))
    return F.regexp_replace(plain, r"^(.+) (" + "|".join(SUFFIXES) + r")$", "$1")


def display_name(first: Column, last: Column, display: Column, key: Column) -> Column:
    """First and last name, else the display name, else the id."""
    full = F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit("")))), F.lit(""))
    return F.coalesce(full, F.nullif(F.trim(display), F.lit("")), key.cast("string"))


def last_segment(url: Column) -> Column:
    """Condition word of a URL: last path segment without query and parameters, lower case."""
    path = F.split(F.split(F.regexp_replace(url, "/+$", ""), r"\?")[0], "/")
    return F.lower(F.split(F.element_at(path, -1), ",")[0])


def weather_class(url: Column, classes=WEATHER_CLASSES) -> Column:
    word = last_segment(url)
    out = F.lit(None).cast("string")
    for label, pattern in reversed(classes):
        out = F.when(word.rlike(pattern), label).otherwise(out)
    return out


def season_list(spec: Column) -> Column:
    """'2019-2021,2024' -> [2019, 2020, 2021, 2024]; duplicates dropped, sorted."""
    def span(part: Column) -> Column:
        low = F.regexp_extract(part, r"^\s*(\d+)", 1).cast("int")
        high = F.coalesce(F.nullif(F.regexp_extract(part, r"-\s*(\d+)\s*$", 1), F.lit("")).cast("int"), low)
        return F.sequence(low, high)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), span))))


def zoned_to_utc(text: Column) -> Column:
    """'2026-09-18 09:46:17 EDT' -> UTC timestamp; NULL for any other shape."""
    shape = r"^\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (" + "|".join(ZONES) + r")\s*$"
    local = F.try_to_timestamp(F.nullif(F.regexp_extract(text, shape, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.to_utc_timestamp(local, "America/New_York")


def month_day_in_season(text: Column, season: Column) -> Column:
    """'Oct 4' -> date: August and later belong to the season's year, earlier months to the next."""
    probe = F.try_to_timestamp(F.concat(F.lit("2000 "), text), F.lit("yyyy MMM d"))
    year = F.when(F.month(probe) >= 8, season).otherwise(season + 1)
    return F.to_date(F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), text), F.lit("yyyy MMM d")))


def local_to_utc(day: Column, time: Column, zone: str = "America/New_York") -> Column:
    """Local date and time text to a UTC timestamp, DST-aware; NULL when either is missing or malformed."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("yyyy-MM-dd HH:mm")), zone)


def in_live_window(state: Column, start: Column, now: Column, minutes: int = 270) -> Column:
    """In progress, or finished and started less than ``minutes`` ago; unknown rows do not count."""
    recent = (F.unix_timestamp(now) - F.unix_timestamp(start)) < minutes * 60
    return F.coalesce((state == "in") | ((state == "post") & recent), F.lit(False))


def reserve_eligible(status: Column) -> Column:
    return F.coalesce(status.isin(*RESERVE_STATUSES), F.lit(False))


def waiver_label(on_waivers: Column, clears: Column) -> Column:
    """'waivers, free Thu': the weekday of clearing in Eastern time where it is known."""
    day = F.date_format(F.from_utc_timestamp(clears, "America/New_York"), "EEE")
    return F.when(on_waivers, F.concat_ws(", ", F.lit("waivers"), F.concat(F.lit("free "), day)))


def slot_label(slot: Column, names: dict[str, str]) -> Column:
    """Platform slot name to display label; an unknown one keeps its own."""
    out = slot
    for code, label in names.items():
        out = F.when(slot == code, label).otherwise(out)
    return out


def value_constraint(comment: Column) -> dict[str, Column]:
    """'Only include leagues with 4-6' / 'Exclude leagues with -2' -> kind, low, high (NULL: no constraint)."""
    low = F.nullif(F.regexp_extract(comment, CONSTRAINT, 1), F.lit("")).cast("double")
    high = F.coalesce(F.nullif(F.regexp_extract(comment, CONSTRAINT, 2), F.lit("")).cast("double"), low)
    kind = F.when(low.isNotNull(), F.when(F.lower(F.trim(comment)).startswith("exclude"), "exclude").otherwise("only"))
    return {"constraint_kind": kind, "constraint_low": low, "constraint_high": high}


def meets_constraint(value: Column, kind: Column, low: Column, high: Column) -> Column:
    inside = (value >= low - 1e-9) & (value <= high + 1e-9)
    return F.coalesce(F.when(kind == "exclude", ~inside).when(kind == "only", inside), F.lit(True))
