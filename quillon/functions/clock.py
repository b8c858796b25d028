"""Time as Columns: canonical stamps, minute clocks, windows in words, delay bins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Upper edges of the delay bins, in days.
DELAY_EDGES = (1, 4, 15, 61, 181)


def canonical(stamp: Column) -> Column:
    """Year, month, day or instant (with or without a zone) to UTC 'YYYY-MM-DDTHH:MM:SS'; None where it is none of these."""
    padded = F.when(stamp.rlike(r"^\d{4}$"), F.concat(stamp, F.lit("-01-01"))).when(stamp.rlike(r"^\d{4}-\d{2}$"), F.concat(stamp, F.lit("-01"))).otherwise(stamp)
    return F.date_format(F.try_to_timestamp(padded), "yyyy-MM-dd'T'HH:mm:ss")


def minute_of(ts: Column, start: str) -> Column:
    """Minutes since the start date."""
    return F.floor((F.unix_timestamp(ts) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / 60)


def day_of(minutes: Column) -> Column:
    return F.floor(minutes / 1440)


def delay_bin(days: Column) -> Column:
    """0 for less than the first edge, up to the number of edges."""
    out = F.lit(len(DELAY_EDGES))
    for i, edge in reversed(list(enumerate(DELAY_EDGES))):
        out = F.when(days < edge, F.lit(i)).otherwise(out)
    return out


def window_in_words(question: Column, asked: Column) -> Column:
    """(low, high) dates that a question names: ISO dates (their hull), yesterday, 'N days / weeks / months ago'; None without any.

    'about' widens by a half of the unit (3 days a week, 15 a month).
    """
    q = F.lower(question)
    dates = F.transform(F.regexp_extract_all(q, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda x: x.cast("date"))
    count = F.regexp_extract(q, r"(\d+) (?:day|week|month)s? ago", 1)
    unit = F.regexp_extract(q, r"\d+ (day|week|month)s? ago", 1)
    days = F.when(count != "", count.try_cast("int") * F.when(unit == "day", 1).when(unit == "week", 7).otherwise(30))
    slack = F.when(q.rlike(r"about \d+ week"), 3).when(q.rlike(r"about \d+ month"), 15).otherwise(0)
    made = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    return (
        F.when(F.size(dates) > 0, made(F.array_min(dates), F.array_max(dates)))
        .when(q.rlike(r"\byesterday\b"), made(F.date_sub(asked, 1), F.date_sub(asked, 1)))
        .when(days.isNotNull(), made(F.date_sub(asked, (days + slack).cast("int")), F.date_sub(asked, (days - slack).cast("int"))))
    )
