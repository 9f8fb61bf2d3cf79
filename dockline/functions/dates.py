"""Lenient date parsing and display formatting as native Column expressions.

All parsed values are ``TIMESTAMP_NTZ`` (naive wall-clock), like the exports.
Every layout is rewritten to ISO text and cast once, so the session's time zone
plays no part.  Text that fits no layout is null, as a missing date would be.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, ustrip

# Day zero of spreadsheet serial dates, and the largest serial
# (in days) that still maps to a representable nanosecond timestamp.
SERIAL_EPOCH = dt.datetime(1899, 12, 30)
MAX_SERIAL_DAYS = 106752
# 4-digit text is read as 1 January of that year inside this range.
YEAR_MIN, YEAR_MAX = 1678, 2261

# ISO text, which the cast reads as it is.
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?$"
# Other layouts: a date, then perhaps a time.  Their parts are put together as
# ISO text and cast once, so no time zone and no parse exception is involved.
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
           "october", "november", "december"]
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "september" else "sep(?:t(?:ember)?)?" for m in _MONTHS) + r")\.?"
_YEAR = r"(\d{4}|\d{2})"
_TIME = r"(?:[ t]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?: *([ap])m)?)?$"
#: Pattern over lower-cased text, and the groups of year, month and day in it.
LAYOUTS = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME, (1, 2, 3)),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.]" + _YEAR + _TIME, (3, 1, 2)),  # month first, unless it can't be one
    (r"^(\d{1,2})[- ]?" + _MONTH + r"[-, ]+" + _YEAR + _TIME, (3, 2, 1)),
    (r"^" + _MONTH + r"[- ](\d{1,2})(?:,? +|-)" + _YEAR + _TIME, (3, 1, 2)),
]
#: The second layout with a whole year and no time, the usual one: put in order by one
#: replacement, without the groups.
_PLAIN = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
# Fixed value: two-digit years from here on are of the last century.
PIVOT = 69


def serial_to_ts(n: Column) -> Column:
    """Spreadsheet day serial (fractional days allowed) -> TIMESTAMP_NTZ."""
    days = F.floor(n).cast("int")
    day = F.date_add(F.lit(SERIAL_EPOCH.date()), days).cast("timestamp_ntz")
    frac = n - F.floor(n)
    secs = (frac * F.lit(86400)).cast("decimal(18,6)")
    return F.when(frac == 0, day).otherwise(
        day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs))


def _layout_iso(s: Column, pattern: str, ymd: tuple[int, int, int]) -> Column:
    """The parts of one layout as ISO text (anything else if a part is out of range).
    Its eight groups are taken out by one match; none of them can hold a bar."""
    groups = F.split(F.regexp_replace(s, pattern, "|".join(f"${i}" for i in range(1, 9))), r"\|")
    return once(groups, lambda found: _iso_of(found, _MONTH in pattern, ymd))


def _iso_of(groups: Column, named: bool, ymd: tuple[int, int, int]) -> Column:
    def group(i: int) -> Column:
        return F.get(groups, F.lit(i - 1))

    year, month, day = (group(i) for i in ymd)
    short = year.try_cast("int")
    year = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(short < PIVOT, "20").otherwise("19"), year))
    if named:
        month = F.element_at(F.create_map(*(x for i, m in enumerate(_MONTHS) for x in (F.lit(m[:3]), F.lit(str(i + 1))))),
                             F.substring(month, 1, 3))
    elif ymd[0] == 3:
        swap = month.try_cast("int") > 12
        month, day = F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)
    hour, half = group(4).try_cast("int"), group(8)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)) \
        .otherwise(99)

    def or_zero(c: Column) -> Column:
        return F.when(c == "", "0").otherwise(c)
    clock = F.when(group(4) == "", "0:0:0").otherwise(
        F.concat_ws(":", hour.cast("string"), group(5), F.concat(or_zero(group(6)), F.lit("."), or_zero(group(7)))))
    return F.concat(F.concat_ws("-", year, month, day), F.lit(" "), clock)


def _text_ts(s: Column) -> Column:
    def other(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, ymd in reversed(LAYOUTS):
            out = F.when(low.rlike(pattern), _layout_iso(low, pattern, ymd)).otherwise(out)
        return out
    rest = once(F.lower(s), other)
    # the day first only where the month can't be one; then it is no date the other way round
    plain = [F.regexp_replace(s, _PLAIN, order).try_cast("timestamp_ntz") for order in ("$3-$1-$2", "$3-$2-$1")]
    return F.when(s.rlike(_ISO), F.replace(s, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")) \
        .when(s.rlike(_PLAIN), F.coalesce(*plain)).otherwise(rest.try_cast("timestamp_ntz"))


def parse_date(c: Column) -> Column:
    """8 digits -> yyyyMMdd; 4 digits in range -> 1 January; other pure numbers
    -> day serial from 1899-12-30 (null when out of range); otherwise the first
    matching text layout; otherwise null."""
    return parse_stripped(ustrip(c))


def parse_stripped(s: Column) -> Column:
    """``parse_date`` of a text without white space at its ends."""
    year = s.try_cast("int")
    num = s.try_cast("double")
    whole = ~s.contains(".")
    number = (
        F.when((F.length(s) == 8) & whole,
               F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("timestamp_ntz"))
        .when((F.length(s) == 4) & whole & year.between(YEAR_MIN, YEAR_MAX),
              F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
        .when(num < MAX_SERIAL_DAYS, serial_to_ts(num)))
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), number).when(s.isNotNull(), _text_ts(s))


def days_between(ts: Column, as_of: dt.date | Column) -> Column:
    """Whole days from ``as_of`` to the calendar date of ``ts`` (null-safe)."""
    return F.datediff(F.to_date(ts), as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("long")


def as_of_midnight(as_of: dt.date | Column) -> Column:
    """Midnight of the as-of date as TIMESTAMP_NTZ (no zone is involved)."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(f"{as_of.isoformat()} 00:00:00").cast("timestamp_ntz")


def fmt_long(ts: Column, missing: str = "N/A") -> Column:
    """'Jan 05, 1998' or ``missing``."""
    return F.coalesce(F.date_format(ts, "MMM dd, yyyy"), F.lit(missing))


def fmt_mmdd(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd")


def stamp(now: dt.datetime) -> str:
    """'Jul 17, 2026 at 8:15 AM' for the run clock (driver-side constant)."""
    return now.strftime("%b %d, %Y at %I:%M %p").replace(" at 0", " at ")
