"""Date, time and interval text by PostgreSQL's spellings, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order; the first that reads the text counts.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM-dd-yyyy", "dd-MMM-yyyy", "M/d/yyyy", "yyyy.D",
)
#: What PostgreSQL's infinity becomes: the ends of Spark's range (fixed values).
LATEST, EARLIEST = "9999-12-31 23:59:59.999999", "0001-01-01 00:00:00"


def parse_timestamp(x: Column) -> Column:
    """A timestamp without zone from ISO, compact, month-name and slash forms, and from epoch, infinity, now, today, tomorrow, yesterday; null for other text."""
    t = F.trim(x)
    word = F.lower(t)
    read = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")
    today = F.current_date()
    return (
        F.when(word == "epoch", F.lit("1970-01-01").cast("timestamp_ntz")).when(word == "infinity", F.lit(LATEST).cast("timestamp_ntz")).when(word == "-infinity", F.lit(EARLIEST).cast("timestamp_ntz"))
        .when(word == "now", F.localtimestamp()).when(word == "today", today.cast("timestamp_ntz")).when(word == "tomorrow", F.date_add(today, 1).cast("timestamp_ntz")).when(word == "yesterday", F.date_sub(today, 1).cast("timestamp_ntz"))
        .otherwise(read)
    )


_MONTHS = {"years?|yrs?|y": 12, "mons?|months?": 1, "decades?": 120, "centur(?:y|ies)": 1200}
_DAYS = {"weeks?|w": 7, "days?|d": 1}
_MICROS = {"hours?|hrs?|h": 3_600_000_000, "minutes?|mins?|m": 60_000_000, "seconds?|secs?|s": 1_000_000, "milliseconds?|ms": 1000, "microseconds?|us": 1}


def parse_interval(x: Column) -> Column:
    """struct (months, days, micros) of "1 year 2 mons 3 days 04:05:06", "P1Y2M3DT4H5M6S" or "2 weeks ago"; null for other text."""
    t = F.lower(F.trim(F.regexp_replace(x, "^@", "")))
    iso = F.upper(F.trim(x)).rlike(r"^-?P(?=.)(-?\d+Y)?(-?\d+M)?(-?\d+W)?(-?\d+D)?(T(-?\d+H)?(-?\d+M)?(-?\d+(\.\d+)?S)?)?$")
    u = F.upper(F.trim(x))
    date_part, time_part = F.regexp_extract(u, r"^-?P([^T]*)", 1), F.regexp_extract(u, r"T(.*)$", 1)

    def iso_n(text: Column, unit: str, kind: str = "long") -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, rf"(-?[\d.]+){unit}", 1), F.lit("")).cast(kind), F.lit(0).cast(kind))

    def verbose(units: dict[str, int]) -> Column:
        out = F.lit(0.0)
        for unit, scale in units.items():
            found = F.regexp_extract_all(t, F.lit(rf"([+-]?\d+(?:\.\d+)?)\s*(?:{unit})(?![a-z])"), F.lit(1))
            out = out + F.aggregate(found, F.lit(0.0), lambda a, v: a + v.cast("double")) * scale
        return out

    clock = F.regexp_extract(t, r"([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?", 0)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, r"([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?", i), F.lit("")).cast("double"), F.lit(0.0))
    clocked = F.when(clock.startswith("-"), -1).otherwise(1) * (part(2) * 3600 + part(3) * 60 + part(4)) * 1_000_000
    ago = F.when(t.endswith(" ago"), -1).otherwise(1)
    everything = "|".join([*_MONTHS, *_DAYS, *_MICROS])
    shape = t.rlike(rf"^(\s*([+-]?\d+(\.\d+)?\s*({everything})(?![a-z])|[+-]?\d+:\d\d(:\d\d(\.\d+)?)?))+(\s+ago)?\s*$")
    sign = F.when(u.startswith("-P"), -1).otherwise(1)
    told = F.struct((sign * (iso_n(date_part, "Y") * 12 + iso_n(date_part, "M"))).cast("int").alias("months"), (sign * (iso_n(date_part, "W") * 7 + iso_n(date_part, "D"))).cast("int").alias("days"), (sign * (iso_n(time_part, "H") * 3_600_000_000 + iso_n(time_part, "M") * 60_000_000 + (iso_n(time_part, "S", "double") * 1_000_000).cast("long"))).cast("long").alias("micros"))
    spoken = F.struct((ago * verbose(_MONTHS)).cast("int").alias("months"), (ago * verbose(_DAYS)).cast("int").alias("days"), (ago * (verbose(_MICROS) + clocked)).cast("long").alias("micros"))
    return F.when(iso, told).when(shape, spoken)


def add_interval(ts: Column, i: Column) -> Column:
    """ts plus struct (months, days, micros): months first, the day held to the month's end, then days, then time."""
    months = F.timestamp_add("MONTH", i["months"], ts)
    return F.timestamp_add("MICROSECOND", i["micros"], F.timestamp_add("DAY", i["days"], months))
