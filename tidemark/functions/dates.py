"""Date parsing and age functions.  The current day is always a parameter (``as_of``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted layouts after ISO, in order of trial.
DAY_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "MMM d, yyyy", "M/d/yyyy")
FEED_FORMATS = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssX",
                "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def _iso_day(s: Column) -> Column:
    """ISO date or timestamp; the calendar day as written, without zone shift."""
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(ok, F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))


def parse_date_multi(c: Column) -> Column:
    """ISO first, then the fixed layouts; null when nothing fits."""
    s = F.trim(c.cast("string"))
    head = F.substring(s, 1, 20)
    return F.coalesce(_iso_day(s), *[F.try_to_timestamp(head, F.lit(f)).cast("date") for f in DAY_FORMATS])


# Month names of RFC 822 dates.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parse_feed_date(c: Column, default: Column | None = None) -> Column:
    """RFC 822 (any zone) or ISO forms to a date, as written; otherwise the default."""
    s = F.trim(c)
    rx = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\b"
    mon = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.regexp_extract(s, rx, 2)))
    rfc = F.when(s.rlike(rx), F.try_to_date(
        F.concat_ws("-", F.regexp_extract(s, rx, 3), mon.cast("string"), F.regexp_extract(s, rx, 1)), "yyyy-M-d"))
    out = F.coalesce(rfc, parse_date_multi(s))
    return F.coalesce(out, default) if default is not None else out


def effective_date(*cols: Column) -> Column:
    """First parseable of several date fields."""
    return F.coalesce(*[parse_date_multi(c) for c in cols])


def age_days(day: Column, as_of: Column) -> Column:
    """Whole days before ``as_of``: 9999 when missing, never negative."""
    return F.coalesce(F.greatest(F.datediff(as_of, day), F.lit(0)), F.lit(9999))


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")
