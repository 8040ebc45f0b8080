"""Dates and durations as column expressions.

Lexical forms keep their offset; offsets are worked out in the *named* zone with
``convert_timezone`` on zone-less timestamps, so the session zone never matters.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefacts.functions import values as V

# French month words and their replacement, in matching order.
FRENCH_MONTHS = (
    ("janvier", "JAN"),
    ("février", "FEB"),
    ("fév", "FEB"),
    ("mars", "MAR"),
    ("avr", "APR"),
    ("mai", "MAY"),
    ("juin", "JUN"),
    ("juillet", "JUL"),
    ("juil", "JUL"),
    ("août", "AUG"),
    ("aou", "AUG"),
    ("aoû", "AUG"),
    ("septembre", "SEP"),
    ("octobre", "OCT"),
    ("novembre", "NOV"),
    ("décembre", "DEC"),
    ("déc", "DEC"),
)

# Descriptive zone names and the zone they stand for.
ZONES = {
    "Eastern Time (US & Canada)": "America/New_York",
    "Central Time (US & Canada)": "America/Chicago",
    "Mountain Time (US & Canada)": "America/Denver",
    "Pacific Time (US & Canada)": "America/Los_Angeles",
    "Atlantic Time (Canada)": "America/Halifax",
    "Newfoundland": "America/St_Johns",
    "Saskatchewan": "America/Regina",
    "Arizona": "America/Phoenix",
    "Alaska": "America/Juneau",
    "Hawaii": "Pacific/Honolulu",
    "London": "Europe/London",
    "Dublin": "Europe/Dublin",
    "Paris": "Europe/Paris",
    "Brussels": "Europe/Brussels",
    "Berlin": "Europe/Berlin",
    "Madrid": "Europe/Madrid",
    "Rome": "Europe/Rome",
    "UTC": "Etc/UTC",
}
DEFAULT_ZONE = "Eastern Time (US & Canada)"

_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
# Accepted forms: ISO date (time, offset), day-month-year, month-day-year; then a clock time.
_ISO = (
    r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[t ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(z|utc|[+-]\d{2}:?\d{2})?)?"
)
_DMY = rf"(?i)(\d{{1,2}})(?:st|nd|rd|th|er)?[\s.,-]*(?:de\s+)?\b({_MONTH})[a-zéû]*[\s.,-]+(\d{{4}})"
_MDY = rf"(?i)\b({_MONTH})[a-zéû]*[\s.,-]+(\d{{1,2}})(?:st|nd|rd|th)?\b[\s.,-]+(\d{{4}})"
_CLOCK = r"(?i)\b(\d{1,2})\s*(?:h|:)\s*(\d{2})?(?::(\d{2}))?\s*([ap]\.?m)?"
_HOUR_AMPM = r"(?i)\b(\d{1,2})\s*([ap])\.?m\b"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def french_month_to_en(col: Column | str) -> Column:
    """H6: lower-case, then month words to English marks."""
    c = F.lower(_c(col))
    for word, mark in FRENCH_MONTHS:
        c = F.replace(c, F.lit(word), F.lit(mark))
    return c


_KNOWN = ";".join(f"{name}={zone}" for name, zone in ZONES.items())
_IDS = f"|{'|'.join(sorted(zoneinfo.available_timezones()))}|"


def zone_id(name: Column) -> Column:
    """Zone of a descriptive name or a zone id; null if unknown."""
    described = F.try_element_at(F.str_to_map(F.lit(_KNOWN), F.lit(";"), F.lit("=")), name)
    is_id = F.contains(F.lit(_IDS), F.concat(F.lit("|"), name, F.lit("|")))
    return F.coalesce(described, F.when(is_id, name))


def _two(col: Column) -> Column:
    return F.lpad(col.cast("string"), 2, "0")


def _number(text: Column, kind: str = "int") -> Column:
    """A number written in a text, null for an empty one. Empty texts, which patterns give for parts that are
    not there, are not cast: each failing cast makes an error with its message, which costs a millisecond."""
    return F.nullif(text, F.lit("")).try_cast(kind)


def iso_datetimes(values: Column, zone: Column | None = None) -> Column:
    """H7 for a list. Staged over arrays (text, parts, wall clock, instant), so each
    text is cleaned and matched once; a zone that comes with the row is looked up once a row."""
    if zone is None:
        return _read_dates(values, F.lit(DEFAULT_ZONE), zone_id(F.lit(DEFAULT_ZONE)))
    return V.once(
        F.coalesce(zone, F.lit(DEFAULT_ZONE)), lambda name: V.once(zone_id(name), lambda tz: _read_dates(values, name, tz))
    )


def _read_dates(values: Column, name: Column, tz: Column) -> Column:
    """The texts read in a zone of that name and id."""
    part = lambda x, pattern, i: F.regexp_extract(x, pattern, i)
    number = lambda c: F.coalesce(_number(c), F.lit(0))
    month_no = lambda m: ((F.instr(F.lit(_MONTH), F.lower(m)) - 1) / 4 + 1).cast("int")

    def clean(v: Column) -> Column:
        text = F.replace(french_month_to_en(v), F.lit(" h "), F.lit("h"))
        return F.struct(v.alias("raw"), F.regexp_replace(text, "(?i)halifax", "").alias("text"))

    def split(x: Column) -> Column:
        """Which form is it, and what is left for the clock."""
        t = x["text"]
        form = F.when(t.rlike(_ISO), "iso").when(t.rlike(_DMY), "dmy").when(t.rlike(_MDY), "mdy")
        return F.struct(x["raw"].alias("raw"), t.alias("text"), form.alias("form"))

    def clock(x: Column) -> Column:
        t = x["text"]
        rest = F.when(~x["form"].eqNullSafe("iso"), F.regexp_replace(F.regexp_replace(t, _DMY, " "), _MDY, " "))
        return F.struct(x["raw"].alias("raw"), t.alias("text"), x["form"].alias("form"), rest.alias("rest"))

    def fields(x: Column) -> Column:
        t, rest, form = x["text"], x["rest"], x["form"]
        iso, dmy = form == "iso", form == "dmy"
        pick = lambda a, b, c: F.when(iso, a).when(dmy, b).when(form == "mdy", c)
        has_clock = rest.rlike(_CLOCK)
        pm = F.lower(
            F.substring(F.concat(part(rest, _CLOCK, 4), part(rest, _HOUR_AMPM, 2)), 1, 1)
        )
        return F.struct(
            x["raw"].alias("raw"),
            t.rlike(r"\d").alias("digits"),
            pick(part(t, _ISO, 1), part(t, _DMY, 3), part(t, _MDY, 3)).try_cast("int").alias("year"),
            pick(
                part(t, _ISO, 2).try_cast("int"), month_no(part(t, _DMY, 2)), month_no(part(t, _MDY, 1))
            ).alias("month"),
            pick(part(t, _ISO, 3), part(t, _DMY, 1), part(t, _MDY, 2)).try_cast("int").alias("day"),
            F.when(iso, number(part(t, _ISO, 4)))
            .when(has_clock, number(part(rest, _CLOCK, 1)))
            .otherwise(number(part(rest, _HOUR_AMPM, 1)))
            .alias("hour"),
            F.when(iso, number(part(t, _ISO, 5))).when(has_clock, number(part(rest, _CLOCK, 2))).otherwise(0).alias("minute"),
            F.when(iso, number(part(t, _ISO, 6))).when(has_clock, number(part(rest, _CLOCK, 3))).otherwise(0).alias("second"),
            F.when(~iso, F.nullif(pm, F.lit(""))).alias("half"),
            F.when(iso, F.nullif(part(t, _ISO, 7), F.lit(""))).alias("offset"),
        )

    def wall(x: Column) -> Column:
        hour = F.when(x["half"] == "p", x["hour"] % 12 + 12).when(x["half"] == "a", x["hour"] % 12).otherwise(x["hour"])
        stamp = F.concat(
            F.lpad(x["year"].cast("string"), 4, "0"), F.lit("-"), _two(x["month"]), F.lit("-"), _two(x["day"]),
            F.lit(" "), _two(hour), F.lit(":"), _two(x["minute"]), F.lit(":"), _two(x["second"]),
        )
        shift = F.when(F.startswith(x["offset"], F.lit("-")), -1).otherwise(1) * (
            number(F.substring(x["offset"], 2, 2)) * 60 + number(F.substring(F.replace(x["offset"], F.lit(":"), F.lit("")), 4, 2))
        )
        return F.struct(
            x["raw"].alias("raw"), x["digits"].alias("digits"), x["year"].alias("year"),
            stamp.try_cast("timestamp_ntz").alias("wall"),
            F.when(x["offset"].isin("z", "utc"), 0).when(x["offset"].isNotNull(), shift).alias("shift"),
        )

    safe = F.coalesce(tz, F.lit("Etc/UTC"))

    def instant(x: Column) -> Column:
        utc = F.when(
            x["shift"].isNotNull(), x["wall"] - F.make_dt_interval(mins=x["shift"])
        ).otherwise(F.convert_timezone(safe, F.lit("UTC"), x["wall"]))
        return F.struct(x["raw"].alias("raw"), x["digits"].alias("digits"), x["year"].alias("year"), utc.alias("utc"))

    def local(x: Column) -> Column:
        return F.struct(
            x["raw"].alias("raw"), x["digits"].alias("digits"), x["year"].alias("year"), x["utc"].alias("utc"),
            F.convert_timezone(F.lit("UTC"), safe, x["utc"]).alias("local"),
        )

    def shown(x: Column) -> Column:
        here, utc = x["local"], x["utc"]
        gap = F.datediff(here, utc) * 1440 + (F.hour(here) - F.hour(utc)) * 60 + F.minute(here) - F.minute(utc)
        full = F.concat(
            F.date_format(here, "yyyy-MM-dd'T'HH:mm:ss"), F.when(gap < 0, "-").otherwise("+"),
            _two((F.abs(gap) / 60).cast("int")), F.lit(":"), _two(F.abs(gap) % 60),
        )
        # Fixed value: the error text that stands in place of a date.
        bad = lambda why: F.concat(
            F.lit("Bad input for date/time: "), x["raw"], F.lit(".  (#<ArgumentError: "), why, F.lit(">)")
        )
        return (
            F.when(x["raw"].isNull(), "")
            .when(tz.isNull(), bad(F.concat(F.lit("Invalid Timezone: "), name)))
            .when(x["year"].isNull(), F.when(x["digits"], bad(F.lit("invalid date"))).otherwise(""))
            .when(here.isNull(), bad(F.lit("argument out of range")))
            .when(F.date_format(here, "HH:mm:ss") == "00:00:00", F.date_format(here, "yyyy-MM-dd"))
            .otherwise(full)
        )

    out = values
    for step in (clean, split, clock, fields, wall, instant, local, shown):
        out = F.transform(out, step)
    return out


def iso_datetime(col: Column | str, zone: Column | str | None = None) -> Column:
    """H7: text to ISO with the zone's offset; midnight gives a date; text without a
    date gives ``''``; an impossible date or unknown zone gives the error text."""
    return F.get(iso_datetimes(F.array(_c(col)), None if zone is None else _c(zone)), F.lit(0))


def convert_datetimes(values: Column | str) -> Column:
    """H8: take ``time_zone: X`` items out, read the rest in that zone, drop repeats."""
    return V.once(_c(values), _read_zoned)


def _read_zoned(items: Column) -> Column:
    is_zone = lambda t: F.coalesce(F.startswith(t, F.lit("time_zone:")), F.lit(False))
    last = V.once(F.filter(items, is_zone), lambda zones: F.get(zones, F.size(zones) - 1))
    zone = F.trim(F.get(F.split(last, ":"), F.lit(1)))
    return F.array_distinct(iso_datetimes(F.filter(items, lambda t: ~is_zone(t)), zone))


def convert_dates(values: Column | str, read: Column | None = None) -> Column:
    """H9: as above, cut to the calendar day; unreadable items give an error text.

    ``read`` is the result of H8, if already at hand.
    """
    items = _c(values)
    return F.transform(
        convert_datetimes(items) if read is None else read,
        lambda d: F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(d, 1, 10)).otherwise(
            F.concat(F.lit("input: "), F.to_json(items), F.lit(" error: invalid date"))
        ),
    )


def iso_duration(col: Column | str) -> Column:
    """Hours, minutes and seconds written in words; no such words give ``''``."""
    c = F.lower(_c(col))
    amount = lambda unit: _number(F.regexp_extract(c, rf"(\d+(?:\.\d+)?)\s*(?:{unit})\b", 1), "double")
    parts = [
        (amount("days?|d"), 86400),
        (amount("hours?|hrs?|hr|h"), 3600),
        (amount("minutes?|mins?|min|m"), 60),
        (amount("seconds?|secs?|sec|s"), 1),
    ]
    clock = F.regexp_extract(c, r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b", 1)
    n = lambda i: F.coalesce(_number(F.regexp_extract(c, r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b", i)), F.lit(0))
    total = sum((F.coalesce(a, F.lit(0.0)) * f for a, f in parts), F.lit(0.0))
    seconds = F.when(
        clock != "",
        F.when(
            F.regexp_extract(c, r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b", 3) != "",
            n(1) * 3600 + n(2) * 60 + n(3),
        ).otherwise(n(1) * 60 + n(2)),
    ).otherwise(F.round(total).cast("bigint"))
    return F.when(c.isNull() | (seconds == 0), "").otherwise(
        F.concat(F.lit("PT"), seconds.cast("string"), F.lit("S"))
    )


FIRST_DATE = r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?)?"


def first_valid_date(col: Column | str, as_of: str) -> Column:
    """First ISO date written in the text, else one year after ``as_of``."""
    found = F.regexp_substr(_c(col), F.lit(FIRST_DATE))
    ok = F.when(F.substring(found, 1, 10).try_cast("date").isNotNull(), found)
    later = F.date_format(
        F.lit(as_of).cast("timestamp_ntz") + F.expr("interval 1 year"), "yyyy-MM-dd'T'HH:mm:ss"
    )
    return F.coalesce(ok, later)


def timespan(col: Column | str, start: str | None, end: str | None, as_of: str, months: int = 60) -> Column:
    """Is the date between start and end? Missing or invalid limits become now and
    now plus ``months`` (60 for event lists, 18 for reports)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    read = lambda text: F.lit(text).try_cast("date").cast("timestamp_ntz")
    low = F.coalesce(read(start), now)
    high = F.coalesce(read(end), now + F.make_ym_interval(F.lit(months // 12), F.lit(months % 12)))
    return _c(col).between(low, high)


def guard_archive_date(col: Column | str, as_of: str) -> Column:
    """Default one year ahead, also for dates more than ten years away."""
    now = F.lit(as_of).cast("timestamp_ntz")
    years = lambda n: F.make_ym_interval(F.lit(n), F.lit(0))
    c = F.coalesce(_c(col), now + years(1))
    far = (c < now - years(10)) | (c > now + years(10))
    return F.when(far, now + years(1)).otherwise(c)


def utc_instant(col: Column | str) -> Column:
    """Zone-less UTC time of an ISO text; a missing offset counts as UTC."""
    c = F.trim(_c(col))
    wall = F.coalesce(
        F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"),
        F.replace(F.substring(c, 1, 16), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"),
        F.substring(c, 1, 10).try_cast("timestamp_ntz"),
    )
    offset = F.regexp_extract(c, r"T.*([+-]\d{2}:?\d{2})$", 1)
    minutes = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1) * (
        F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int")
    )
    return F.when(offset == "", wall).otherwise(wall - F.make_dt_interval(mins=minutes))
