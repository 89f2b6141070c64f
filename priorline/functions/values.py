"""Scalar rules as column expressions: what a value must look like, or null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
#: A side that rested at most so many days played back to back.
BACK_TO_BACK_DAYS = 1.5
EASTERN = "America/New_York"


def _unaccented() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and that letter: by Unicode's compatibility decomposition."""
    accented, plain = [], []
    for point in (*range(0xA0, 0x2000), *range(0x2100, 0x2190), *range(0xFF01, 0xFF5F)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            accented.append(chr(point))
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, UNACCENTED = _unaccented()
#: Generation suffixes that player names drop.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def number(x: Column) -> Column:
    """A double, or null where the text is none; NaN is null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def price(x: Column) -> Column:
    """A price in [0, 1]; out of range is null, never clamped."""
    value = number(x)
    return F.when(value.between(0, 1), F.round(value, 6))


fraction = price


def minutes(x: Column) -> Column:
    """``MM:SS`` or ``MM`` as minutes; blank is null, ``0:00`` is 0."""
    text = F.trim(x)
    clock = r"^(\d+):(\d{1,2})$"
    return F.when(text.rlike(clock), F.regexp_extract(text, clock, 1).try_cast("double") + F.regexp_extract(text, clock, 2).try_cast("double") / 60).when(text != "", number(text))


def calendar_date(x: Column) -> Column:
    """The first ten characters as a date, never shifted between zones."""
    return F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")


def midpoint(bid: Column, ask: Column) -> Column:
    return F.round((bid + ask) / 2, 6)


def spread(bid: Column, ask: Column) -> Column:
    return F.round(ask - bid, 6)


def share(a: Column, b: Column) -> Column:
    """a / (a + b): two-sided prices without their overround."""
    return F.try_divide(a, a + b)


def season_of(year: Column, month: Column) -> Column:
    """Seasons run from July to June and are named by the year they start in."""
    return (year - F.when(month < 7, 1).otherwise(0)).cast("int")


def season_label(season: Column) -> Column:
    return F.format_string("%d-%02d", season.cast("int"), ((season + 1) % 100).cast("int"))


def guarded_outcome(final: Column, home: Column, away: Column) -> Column:
    """Whether home won; null unless final, both scored and not level."""
    return F.when(final & home.isNotNull() & away.isNotNull() & (home != away), home > away)


def pair_key(date: Column, a: Column, b: Column) -> Column:
    """Date and the two codes in order; null where any is."""
    return F.when(date.isNotNull() & a.isNotNull() & b.isNotNull(), F.concat_ws("|", date.cast("string"), F.least(a, b), F.greatest(a, b)))


def rest_days(now: Column, before: Column) -> Column:
    """Days between two instants in epoch seconds."""
    return (now - before) / float(DAY_SECONDS)


def back_to_back(rest: Column) -> Column:
    return F.coalesce(rest <= BACK_TO_BACK_DAYS, F.lit(False))


def grid_floor(ts: Column, step: int) -> Column:
    """The latest multiple of ``step`` seconds at or before an instant."""
    return ts - F.pmod(ts, F.lit(step))


def anchor_label(minutes_before: Column) -> Column:
    return F.when(minutes_before % 60 == 0, F.format_string("T-%dh", (minutes_before / 60).cast("int"))).otherwise(F.format_string("T-%dm", minutes_before.cast("int")))


def folded(x: Column) -> Column:
    """Names for exact comparison: accents, marks, dots and apostrophes off, blanks collapsed, case folded."""
    plain = F.regexp_replace(F.translate(x, ACCENTED + ".'’`", UNACCENTED), r"\p{Mn}+", "")
    return F.replace(F.lower(F.trim(F.regexp_replace(plain, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def player_name(x: Column) -> Column:
    """``Surname, Given`` turned round, folded, without generation suffixes."""
    turned = F.when(x.contains(","), F.concat_ws(" ", F.trim(F.regexp_extract(x, r"^[^,]*,(.*)$", 1)), F.trim(F.regexp_extract(x, r"^([^,]*),", 1)))).otherwise(x)
    return F.array_join(F.filter(F.split(folded(turned), " "), lambda t: ~t.isin(*SUFFIXES) & (t != "")), " ")


def slug(x: Column, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", ""), 1, size)


def fingerprint(*cols: Column) -> Column:
    """Sixteen hex digits of a payload."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, 16)


def clipped(p: Column, eps: float = 1e-15) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def blend(p: Column, q: Column, weight: Column | float) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return (1 - w) * p + w * q


def recency_weight(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def season_slug(season: Column) -> Column:
    return F.replace(season_label(season), F.lit("-"), F.lit("_"))


def season_window(season: Column) -> tuple[Column, Column]:
    """First and last day of a season: July to June."""
    return F.make_date(season, F.lit(7), F.lit(1)), F.make_date(season + 1, F.lit(6), F.lit(30))


def eastern(ts: Column) -> Column:
    """Epoch seconds as the wall clock of New York, summer time and all."""
    utc = F.timestamp_add("SECOND", ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), utc)


def from_eastern(clock: Column) -> Column:
    """The wall clock of New York as epoch seconds; of an hour that comes twice, the first."""
    utc = F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), clock)
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)


def eastern_floor(ts: Column, step: int) -> Column:
    """The latest multiple of ``step`` seconds of New York's clock at or before an instant."""
    clock = eastern(ts)
    past = F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)
    return ts - F.pmod(past, F.lit(step))


def slot_file(slot: Column) -> Column:
    """The file name of a report's slot: day and twelve-hour clock of New York."""
    clock = eastern(slot)
    return F.concat(F.lit("Injury-Report_"), F.date_format(clock, "yyyy-MM-dd_hh"), F.lit("_"), F.date_format(clock, "mma"), F.lit(".pdf"))


def slot_of_file(name: Column) -> Column:
    """The slot's instant, null for any other name."""
    text = F.regexp_extract(name, r"^Injury-Report_(\d{4}-\d{2}-\d{2}_\d{2}_\d{2}[AP]M)\.pdf$", 1)
    clock = F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyy-MM-dd_hh_mma")).cast("timestamp_ntz")
    return from_eastern(clock)


def season_list(spec: str) -> list[int]:
    """``2006-2025`` or ``2006,2011,2019``, sorted; a spec without any season is an error."""
    found: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        first, _, last = part.partition("-")
        found |= set(range(int(first), int(last or first) + 1))
    if not found:
        raise ValueError(f"no season in {spec!r}")
    return sorted(found)


def near_date(tipoff: Column, date: Column) -> Column:
    """Whether a tip-off's day is its scheduled one or next to it; null where either is missing."""
    return F.abs(F.datediff(tipoff.cast("date"), date)) <= 1
