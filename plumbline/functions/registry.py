"""Scalar functions that differ from Spark's, and a registry by SQL name for both dialects.

Every builder takes Columns (or plain values where the argument is a constant) and returns a Column. All but those of
`json_udf` are built-in functions and stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import datetimes, geometry, json_udf

Builder = Callable[..., Column]
MYSQL: dict[str, Builder] = {}
POSTGRES: dict[str, Builder] = {}


def _c(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _null_if_any(out: Column, *args: Column) -> Column:
    missing = args[0].isNull()
    for a in args[1:]:
        missing = missing | a.isNull()
    return F.when(~missing, out)


# null helpers


def num_nulls(*args: Column) -> Column:
    out = F.lit(0)
    for a in args:
        out = out + a.isNull().cast("int")
    return out


def num_nonnulls(*args: Column) -> Column:
    return F.lit(len(args)) - num_nulls(*args)


def mysql_greatest(*args: Column) -> Column:
    """Null if any argument is."""
    return _null_if_any(F.greatest(*args), *args)


def mysql_least(*args: Column) -> Column:
    return _null_if_any(F.least(*args), *args)


# numbers


def _finite(x: Column) -> Column:
    """MySQL gives NULL where IEEE gives NaN or an infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def truncate(x: Column, d: int) -> Column:
    """Towards zero at d decimals."""
    scale = F.lit(10.0**d)
    return F.when(x >= 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)) / scale


def mysql_log(*args: Column) -> Column:
    """LOG(x) and LOG(base, x): null outside the domain."""
    if len(args) == 1:
        return F.when(args[0] > 0, F.ln(args[0]))
    base, x = args
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def int_div(a: Column, b: Column) -> Column:
    """DIV: null for a zero divisor."""
    return F.when(b != 0, F.when((a / b) >= 0, F.floor(a / b)).otherwise(F.ceil(a / b)))


def pg_int_div(a: Column, b: Column) -> Column:
    """PostgreSQL's / on integers: towards zero, an error for zero."""
    return ((a - a % b) / b).cast("long")


def mysql_mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def interval_index(x: Column, *bounds: Column) -> Column:
    """INTERVAL(x, b1, b2, ...): how many of the ascending bounds are at most x; -1 for null."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.coalesce((b <= x).cast("int"), F.lit(0))
    return F.when(x.isNull(), F.lit(-1)).otherwise(out)


# strings


def elt(n: Column, *values: Column) -> Column:
    out: Column | None = None
    for i, v in enumerate(values, 1):
        out = F.when(n == i, v) if out is None else out.when(n == i, v)
    return out if out is not None else F.lit(None).cast("string")


def field(x: Column, *values: Column) -> Column:
    """1-based place of x among the values, 0 if it isn't there or null."""
    out = F.lit(0)
    for i, v in reversed(list(enumerate(values, 1))):
        out = F.when(F.coalesce(x == v, F.lit(False)), F.lit(i)).otherwise(out)
    return out


def make_set(bits: Column, *values: Column) -> Column:
    parts = [F.when((F.shiftright(bits, i) % 2) != 0, v) for i, v in enumerate(values)]
    return F.when(bits.isNotNull(), F.concat_ws(",", *parts))


def export_set(bits: Column, on: str, off: str, separator: str = ",", n: int = 64) -> Column:
    return F.when(bits.isNotNull(), F.concat_ws(separator, *[F.when(F.shiftrightunsigned(bits.cast("long"), i).bitwiseAND(1) == 1, on).otherwise(off) for i in range(n)]))


def mysql_quote(x: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(x, r"([\\'])", r"\\$1"), "\u0000", r"\\0")
    return F.when(x.isNull(), "NULL").otherwise(F.concat(F.lit("'"), body, F.lit("'")))


def mysql_ord(x: Column) -> Column:
    """The leftmost character's bytes as a number."""
    return F.when(F.length(x) == 0, F.lit(0)).otherwise(F.conv(F.hex(F.encode(F.substring(x, 1, 1), "UTF-8")), 16, 10).cast("long"))


def insert_at(x: Column, at: Column, n: Column, new: Column) -> Column:
    """INSERT(x, at, n, new): x itself where at is outside of it."""
    head, tail = x.substr(F.lit(1), at - 1), x.substr(at + n, F.length(x))
    inside = (at >= 1) & (at <= F.length(x))
    rest = F.when((n < 0) | (at + n > F.length(x)), F.lit("")).otherwise(tail)
    return F.when(inside, F.concat(head, new, rest)).otherwise(_null_if_any(x, x, at, n, new))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def char_of(*codes: Column) -> Column:
    """CHAR(n, ...): the bytes of the numbers, nulls skipped."""
    return F.unhex(F.concat_ws("", *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in codes]))


def format_number(x: Column, d: int) -> Column:
    return F.format_number(x, d)


def format_bytes(x: Column) -> Column:
    units = ["bytes", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    size = F.abs(x.cast("double"))
    out = F.when(size < 1024, F.format_string("%4d %s", x.cast("long"), F.lit(units[0])))
    for i in range(1, 7):
        out = out.when((size < 1024.0 ** (i + 1)) | F.lit(i == 6), F.format_string("%.2f %s", x / 1024.0**i, F.lit(units[i])))
    return out


def similarity(a: Column, b: Column) -> Column:
    """pg_trgm's similarity for strings of one word: shared trigrams over all trigrams of the padded, lower-cased strings."""
    x, y = show_trgm(a), show_trgm(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def show_trgm(a: Column) -> Column:
    """The different trigrams of a word padded with two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(a), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def word_similarity(a: Column, b: Column) -> Column:
    """The share of a's trigrams that b holds."""
    x = show_trgm(a)
    return F.size(F.array_intersect(x, show_trgm(b))) / F.size(x)


def initcap(x: Column) -> Column:
    """PostgreSQL's initcap: a letter after anything but a letter or digit is upper-cased, others lower-cased."""
    pieces = F.split(F.lower(x), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(p.substr(F.lit(1), F.lit(1))), p.substr(F.lit(2), F.length(p)))), "")


def regexp_split(x: Column, pattern: str) -> Column:
    return F.split(x, pattern)


def unaccent(x: Column) -> Column:
    """Letters of Latin-1 and Latin Extended-A without their marks (fixed values of the Unicode decompositions)."""
    source = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŁłŃńŇňŌōŐőŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
    target = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyyAaAaAaCcCcDdEeEeEeGgIiLlNnNnOoOoRrSsSsSsTtTtUuUuUuZzZzZz"
    return F.translate(x, source, target)


# dates and times

_EPOCH_DAY = 719528  # MySQL's TO_DAYS('1970-01-01'): a fixed value


def epoch(ts: Column) -> Column:
    """EXTRACT(EPOCH FROM ts)."""
    return F.unix_micros(ts) / 1e6


def whole_months(later: Column, earlier: Column) -> Column:
    """Full months from one timestamp to another, as in age(): the months of the calendar, one less in size if the day and time haven't come round."""
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    rest = lambda t: F.dayofmonth(t) * F.lit(86_400_000_000) + F.unix_micros(t) - F.unix_micros(F.date_trunc("DAY", t))
    ahead, behind = (rest(later) < rest(earlier)).cast("int"), (rest(later) > rest(earlier)).cast("int")
    return F.when(later >= earlier, months - ahead).otherwise(months + behind).cast("long")


def to_days(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + _EPOCH_DAY


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - _EPOCH_DAY).cast("int"))


def to_seconds(ts: Column) -> Column:
    return (to_days(ts.cast("date")).cast("long") * 86400) + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def period_add(p: Column, n: Column) -> Column:
    months = F.floor(p / 100) * 12 + p % 100 - 1 + n
    return (F.floor(months / 12) * 100 + months % 12 + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    return (F.floor(a / 100) * 12 + a % 100 - F.floor(b / 100) * 12 - b % 100).cast("long")


def makedate(year: Column, day: Column) -> Column:
    return F.when(day > 0, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int")))


def sec_to_time(n: Column) -> Column:
    """[-]HH:MM:SS, hours beyond 99 too."""
    m = F.abs(n).cast("long")
    text = F.concat_ws(":", F.when(m < 360000, F.lpad(F.floor(m / 3600).cast("string"), 2, "0")).otherwise(F.floor(m / 3600).cast("string")), F.lpad((F.floor(m / 60) % 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))
    return F.when(n.isNotNull(), F.concat(F.when(n < 0, "-").otherwise(""), text))


def time_to_sec(t: Column) -> Column:
    parts = F.split(F.regexp_replace(t, "^-", ""), ":")
    seconds = parts[0].cast("long") * 3600 + parts[1].cast("long") * 60 + F.floor(parts[2].cast("double")).cast("long")
    return F.when(t.startswith("-"), -seconds).otherwise(seconds)


#: MySQL's longest TIME in microseconds (a fixed value): 838:59:59.
_LONGEST_TIME = 3_020_399_000_000
_TIME = r"^(-?)(?:(\d+) )?(\d+):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?$"


def time_micros(t: Column) -> Column:
    """[-][D ]H:MM[:SS[.ffffff]] in microseconds; null for other text."""
    part = lambda i: F.coalesce(F.regexp_extract(t, _TIME, i).try_cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(t, _TIME, 6), 6, "0").try_cast("long")
    size = ((part(2) * 24 + part(3)) * 3600 + part(4) * 60 + part(5)) * 1_000_000 + F.coalesce(fraction, F.lit(0))
    sign = F.when(F.regexp_extract(t, _TIME, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    return F.when(t.rlike(_TIME) & (part(4) < 60) & (part(5) < 60), F.least(size, F.lit(_LONGEST_TIME)) * sign)


def time_text(micros: Column) -> Column:
    """[-]HH:MM:SS[.ffffff], cut off at 838:59:59."""
    n = F.least(F.abs(micros), F.lit(_LONGEST_TIME))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    seconds, fraction = F.floor(n / 1_000_000), n % 1_000_000
    hours = F.floor(seconds / 3600)
    text = F.concat(F.when(micros < 0, "-").otherwise(""), F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60))
    whole = F.when(fraction > 0, F.concat(text, F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(text)
    return F.when(micros.isNotNull(), whole)


def _moment_text(ts: Column) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def _add_micros(x: Column, micros: Column) -> Column:
    """x, a date and time or a time, moved on; as text."""
    moment = F.try_to_timestamp(x.cast("string"))
    moved = F.timestamp_micros(F.unix_micros(moment) + micros)
    dated = x.cast("string").rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    return F.when(dated, _moment_text(moved)).otherwise(time_text(time_micros(x.cast("string")) + micros))


def addtime(x: Column, t: Column) -> Column:
    """ADDTIME: t, a time, added to a time or a date and time."""
    return _add_micros(x, time_micros(t.cast("string")))


def subtime(x: Column, t: Column) -> Column:
    return _add_micros(x, -time_micros(t.cast("string")))


def timediff(a: Column, b: Column) -> Column:
    """TIMEDIFF: a - b of two times, or of two dates with times; null for one of each."""
    dated = lambda x: x.cast("string").rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    moment = lambda x: F.unix_micros(F.try_to_timestamp(x.cast("string")))
    times = time_micros(a.cast("string")) - time_micros(b.cast("string"))
    return time_text(F.when(dated(a) & dated(b), moment(a) - moment(b)).when(~dated(a) & ~dated(b), times))


def maketime(h: Column, m: Column, s: Column) -> Column:
    """MAKETIME: null for minutes or seconds beyond 59."""
    seconds = F.round(s.cast("double") * 1_000_000).cast("long")
    size = (F.abs(h.cast("long")) * 3600 + m.cast("long") * 60) * 1_000_000 + seconds
    return F.when(m.between(0, 59) & (s >= 0) & (s < 60), time_text(F.when(h < 0, -size).otherwise(size)))


def time_format(t: Column, pattern: str) -> Column:
    """TIME_FORMAT: hours beyond 23 for %H and %k too; raises for letters of dates."""
    micros = time_micros(t.cast("string"))
    n = F.floor(F.abs(micros) / 1_000_000)
    hours, minutes, seconds = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    twelve = (hours + 11) % 12 + 1
    half = F.when(hours % 24 < 12, "AM").otherwise("PM")
    colon = F.lit(":")
    letters = {
        "H": two(hours), "k": hours.cast("string"), "h": two(twelve), "I": two(twelve), "l": twelve.cast("string"), "i": two(minutes), "s": two(seconds), "S": two(seconds), "p": half,
        "f": F.lpad((F.abs(micros) % 1_000_000).cast("string"), 6, "0"), "T": F.concat(two(hours), colon, two(minutes), colon, two(seconds)), "r": F.concat(two(twelve), colon, two(minutes), colon, two(seconds), F.lit(" "), half),
    }
    parts, at = [F.when(micros < 0, "-").otherwise("")], 0
    while at < len(pattern):
        letter = pattern[at + 1 : at + 2] if pattern[at] == "%" else ""
        if letter and letter.isalpha() and letter not in letters:
            raise ValueError(f"no time in %{letter}")
        parts.append(letters[letter] if letter in letters else F.lit(letter or pattern[at]))
        at += 2 if letter else 1
    return F.when(micros.isNotNull(), F.concat(*parts))


#: MySQL's format letters and Spark's (fixed values).
DATE_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss",
    "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def mysql_format(pattern: str) -> str:
    """Spark's datetime pattern for a MySQL format; raises for letters that have none."""
    out, literal, i = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if any(c.isalpha() or c in "'[]{}#" for c in literal) else literal)
            literal = ""

    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            i += 1
            if pattern[i] in DATE_LETTERS:
                flush()
                out.append(DATE_LETTERS[pattern[i]])
            elif pattern[i].isalpha():
                raise ValueError(f"no pattern for %{pattern[i]}")
            else:
                literal += pattern[i]
        else:
            literal += pattern[i]
        i += 1
    flush()
    return "".join(out)


def date_format(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, mysql_format(pattern))


def str_to_date(x: Column, pattern: str) -> Column:
    return F.try_to_timestamp(x, F.lit(mysql_format(pattern)))


def week_mode0(d: Column) -> Column:
    """WEEK(d): weeks begin on Sunday, week 1 holds the year's first Sunday, days before it are in week 0."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def yearweek(d: Column) -> Column:
    """YEARWEEK(d) of mode 0: days before the first Sunday belong to the last week of the year before."""
    last = F.date_sub(F.trunc(d, "YEAR"), 1)
    return F.when(week_mode0(d) > 0, F.year(d) * 100 + week_mode0(d)).otherwise(F.year(last) * 100 + week_mode0(last))


# addresses, identifiers, checksums


def inet_aton(x: Column) -> Column:
    parts = F.split(x, r"\.")
    value = sum((F.get(parts, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    return F.when(x.rlike(IPV4), value)


def inet_ntoa(n: Column) -> Column:
    return F.when(n.between(0, 2**32 - 1), F.concat_ws(".", *[(F.shiftright(n.cast("long"), s) % 256).cast("string") for s in (24, 16, 8, 0)]))


IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
UUID = r"^(?i)(\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?|[0-9a-f]{32})$"


def is_ipv6(x: Column) -> Column:
    """Full and shortened forms, with a dotted IPv4 tail or without."""
    tail = F.regexp_replace(x, r"(\d{1,3}\.){3}\d{1,3}$", "0:0")
    groups = F.filter(F.split(tail, ":"), lambda g: g != "")
    short = F.size(F.split(tail, "::")) - 1
    shape = tail.rlike(r"^[0-9A-Fa-f:]+$") & F.forall(groups, lambda g: F.length(g) <= 4) & ~tail.rlike(":::")
    edges = ~tail.rlike(r"(^:[^:])|([^:]:$)")
    return x.contains(":") & shape & edges & (((short == 0) & (F.size(groups) == 8)) | ((short == 1) & (F.size(groups) <= 7)))


def uuid_to_bin(x: Column) -> Column:
    return F.unhex(F.regexp_replace(x, "[-{}]", ""))


def bin_to_uuid(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(x), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))


def luhn_ok(x: Column) -> Column:
    """isn-style checksum of digits."""
    return F.luhn_check(x)


def isbn13_ok(x: Column) -> Column:
    """Whether the thirteen digits' alternating sum is a multiple of ten."""
    digits = F.regexp_replace(x, "[- ]", "")
    total = sum((F.substring(digits, i + 1, 1).try_cast("int") * (1 if i % 2 == 0 else 3) for i in range(13)), F.lit(0))
    return F.coalesce(digits.rlike("^[0-9]{13}$") & (total % 10 == 0), F.lit(False))


# arrays


def array_ndims(a: Column, depth: int = 1) -> Column:
    """Dimensions of an array nested `depth` deep; null for an empty one."""
    return F.when(F.size(a) > 0, F.lit(depth))


def array_upper(a: Column, dimension: int = 1) -> Column:
    """The last subscript of a dimension, arrays being numbered from 1; null for an empty array."""
    inner = a
    for _ in range(dimension - 1):
        inner = F.try_element_at(inner, F.lit(1))
    return F.when(F.size(a) > 0, F.size(inner))


def array_lower(a: Column, dimension: int = 1) -> Column:
    return F.when(array_upper(a, dimension) > 0, F.lit(1))


def array_dims(a: Column, depth: int = 1) -> Column:
    """The text form of the bounds: [1:3], [1:2][1:3] ..."""
    return F.when(F.size(a) > 0, F.concat(*[F.concat(F.lit("[1:"), array_upper(a, d).cast("string"), F.lit("]")) for d in range(1, depth + 1)]))


def array_fill(value: Column, n: Column) -> Column:
    return F.array_repeat(value, n)


def trim_array(a: Column, n: int) -> Column:
    """a without its last n elements."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - F.lit(n), F.lit(0)))


def intset(x: Column) -> Column:
    return F.array(x)


def intarray_union(a: Column, b: Column) -> Column:
    """a | b: sorted, without doubles."""
    return F.sort_array(F.array_union(a, b))


def intarray_intersect(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def intarray_minus(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def soundex_like(a: Column, b: Column) -> Column:
    """a SOUNDS LIKE b."""
    return F.soundex(a) == F.soundex(b)


def levenshtein_less_equal(a: Column, b: Column, most: int) -> Column:
    """The distance where it is at most `most`, else a number above it."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def strict_word_similarity(a: Column, b: Column) -> Column:
    """The greatest similarity of a with a run of whole words of b."""
    words = F.filter(F.split(F.lower(b), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = show_trgm(a)
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))
    starts = F.sequence(F.lit(1), F.size(words))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_distinct(F.flatten(F.transform(F.slice(words, i, n), grams))))))
    scores = F.transform(runs, lambda r: F.size(F.array_intersect(own, r)) / F.size(F.array_union(own, r)))
    return F.when(F.size(words) > 0, F.array_max(scores)).otherwise(F.lit(0.0))


# hstore, ltree, cube


def hstore_concat(a: Column, b: Column) -> Column:
    """a || b: b's values win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def hstore_delete(a: Column, key: str) -> Column:
    return F.map_filter(a, lambda k, _: k != F.lit(key))


def hstore_slice(a: Column, keys: list[str]) -> Column:
    return F.map_filter(a, lambda k, _: k.isin(*keys))


def hstore_defined(a: Column, key: str) -> Column:
    """Whether the key is there and its value isn't null."""
    return F.coalesce(F.try_element_at(a, F.lit(key)).isNotNull(), F.lit(False))


def hstore_exists_any(a: Column, keys: list[str]) -> Column:
    """a ?| keys."""
    return F.arrays_overlap(F.map_keys(a), F.array(*map(F.lit, keys)))


def hstore_exists_all(a: Column, keys: list[str]) -> Column:
    """a ?& keys."""
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.map_keys(a))) == 0


def hstore_delete_keys(a: Column, keys: list[str]) -> Column:
    return F.map_filter(a, lambda k, _: ~k.isin(*keys))


def hstore_delete_pairs(a: Column, b: Column) -> Column:
    """a - b: pairs that b has too go."""
    return F.map_filter(a, lambda k, v: ~(F.map_contains_key(b, k) & v.eqNullSafe(F.element_at(b, k))))


def hstore_contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e["key"]) & F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


def hstore_to_array(a: Column) -> Column:
    """Keys and values in turn."""
    return F.flatten(F.transform(F.map_entries(a), lambda e: F.array(e["key"], e["value"])))


def hstore_to_matrix(a: Column) -> Column:
    return F.transform(F.map_entries(a), lambda e: F.array(e["key"], e["value"]))


def hstore_of(keys: Column, values: Column) -> Column:
    """hstore(keys, values)."""
    return F.map_from_arrays(keys, values)


def hstore_of_row(row: Column, names: list[str]) -> Column:
    """hstore(record): the fields as text."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[row.getField(n).cast("string") for n in names]))


def populate_record(row: Column, a: Column, types: dict[str, str]) -> Column:
    """row #= a: fields that a has take its values, cast."""
    return F.struct(*[F.when(F.map_contains_key(a, n), F.try_element_at(a, F.lit(n)).cast(t)).otherwise(row.getField(n).cast(t)).alias(n) for n, t in types.items()])


def nlevel(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, r"\.")))


def subpath(path: Column, at: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(path, r"\."), at + 1, n), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """ltree's a @> b."""
    return (a == b) | (a == "") | F.startswith(b, F.concat(a, F.lit(".")))


def lca(a: Column, b: Column) -> Column:
    """The longest common ancestor, shorter than both."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    most = F.least(F.size(x), F.size(y)) - 1
    lengths = F.filter(F.sequence(F.lit(0), most), lambda n: F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))
    return F.array_join(F.slice(x, F.lit(1), F.array_max(lengths)), ".")


def subltree(path: Column, start: int, end: int) -> Column:
    return F.array_join(F.slice(F.split(path, r"\."), start + 1, end - start), ".")


def ltree_index(path: Column, part: str) -> Column:
    """The place of the first occurrence of a path within another, from 0; -1 if there is none."""
    labels, wanted = F.split(path, r"\."), F.array(*map(F.lit, part.split(".")))
    starts = F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.slice(labels, i + 1, F.size(wanted)) == wanted)
    return F.coalesce(F.try_element_at(starts, F.lit(1)), F.lit(-1))


def lquery(pattern: str) -> str:
    """The regular expression of an lquery: labels with * prefixes, |, @ (any case) and !, and * of {n}, {n,}, {n,m} or {,m} levels."""
    parts = []
    for item in pattern.split("."):
        levels = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", item)
        if levels:
            low, comma, high = levels.groups()
            bounds = (int(low or 0), int(high) if high else None) if comma else (int(low), int(low)) if low else (0, None)
            parts.append(f"(?:[^.]+(?:\\.|$)){{{bounds[0]},{'' if bounds[1] is None else bounds[1]}}}")
            continue
        refused = item.startswith("!")
        options = []
        for label in item.lstrip("!").split("|"):
            word, flags = re.fullmatch(r"(\w+)([*@%]*)", label).groups()
            text = re.escape(word) + ("[^.]*" if "*" in flags else "")
            options.append(f"(?i:{text})" if "@" in flags else text)
        one = "(?:" + "|".join(options) + ")(?:\\.|$)"
        parts.append(f"(?!{one})[^.]+(?:\\.|$)" if refused else one)
    return "^" + "".join(parts) + "$"


def ltree_matches(path: Column, pattern: str) -> Column:
    """path ~ lquery."""
    return path.rlike(lquery(pattern))


def cube_union(a: Column, b: Column) -> Column:
    """The least box (lower, upper arrays) that holds two."""
    low = F.zip_with(a["lower"], b["lower"], lambda x, y: F.least(x, y))
    return F.struct(low.alias("lower"), F.zip_with(a["upper"], b["upper"], lambda x, y: F.greatest(x, y)).alias("upper"))


def cube_overlaps(a: Column, b: Column) -> Column:
    meets = F.zip_with(F.zip_with(a["lower"], b["upper"], lambda x, y: x <= y), F.zip_with(b["lower"], a["upper"], lambda x, y: x <= y), lambda p, q: p & q)
    return F.forall(meets, lambda x: x)


def cube_contains(a: Column, b: Column) -> Column:
    inside = F.zip_with(F.zip_with(a["lower"], b["lower"], lambda x, y: x <= y), F.zip_with(b["upper"], a["upper"], lambda x, y: x <= y), lambda p, q: p & q)
    return F.forall(inside, lambda x: x)


def taxicab_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def chebyshev_distance(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def uuid_v5(namespace: str, name: Column) -> Column:
    """uuid_generate_v5: a name in a namespace, by SHA-1."""
    h = F.sha1(F.concat(F.lit(bytes.fromhex(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Namespaces of names (fixed values of RFC 4122).
UUID_DNS, UUID_URL, UUID_OID, UUID_X500 = (f"6ba7b81{i}-9dad-11d1-80b4-00c04fd430c8" for i in (0, 1, 2, 4))


def isbn10_to_13(x: Column) -> Column:
    """The thirteen digits of a ten-digit book number."""
    head = F.concat(F.lit("978"), F.substring(F.regexp_replace(x, "[- ]", ""), 1, 9))
    total = sum((F.substring(head, i + 1, 1).try_cast("int") * (1 if i % 2 == 0 else 3) for i in range(12)), F.lit(0))
    return F.concat(head, ((10 - total % 10) % 10).cast("string"))


def issn_ok(x: Column) -> Column:
    """Eight digits weighted 8 to 1 whose sum is a multiple of eleven; X is ten."""
    digits = F.upper(F.regexp_replace(x, "[- ]", ""))
    value = lambda i: F.when(F.substring(digits, i + 1, 1) == "X", 10).otherwise(F.substring(digits, i + 1, 1).try_cast("int"))
    total = sum((value(i) * (8 - i) for i in range(8)), F.lit(0))
    return F.coalesce(digits.rlike("^[0-9]{7}[0-9X]$") & (total % 11 == 0), F.lit(False))


def cube_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


EARTH_RADIUS = 6_378_168.0  # earthdistance's earth() in metres: a fixed value


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def digest(x: Column, kind: str) -> Column:
    return {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}[kind](x.cast("binary"))


def hmac_sha256(data: Column, key: bytes) -> Column:
    """Keyed hash, with the two paddings folded into constants."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ m for b in block)) for m in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data.cast("binary")), 256))), 256)


def match_against(text: Column, terms: list[str]) -> Column:
    """MATCH ... AGAINST in natural mode, as the number of the query's different words that the text holds."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))
    return F.size(F.array_intersect(words, F.array(*[F.lit(t.lower()) for t in terms])))


def json_length(doc: Column) -> Column:
    parsed = F.try_parse_json(doc)
    head = F.substring(F.ltrim(doc), 1, 1)
    return F.when(head == "[", F.json_array_length(doc)).when(head == "{", F.size(F.json_object_keys(doc))).when(parsed.isNotNull(), 1)


def json_keys(doc: Column) -> Column:
    return F.json_object_keys(doc)


def json_unquote(x: Column) -> Column:
    return F.when(x.rlike('^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")).otherwise(x)


def json_quote(x: Column) -> Column:
    text = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNotNull(), text.substr(F.lit(6), F.length(text) - 6))


_SAME: dict[str, Builder] = {
    "ABS": F.abs, "ANY_VALUE": F.any_value, "ATAN2": F.atan2, "BIN": F.bin, "BIT_COUNT": F.bit_count, "BIT_LENGTH": F.bit_length, "CEIL": F.ceil, "CEILING": F.ceil,
    "CHAR_LENGTH": F.char_length, "CHARACTER_LENGTH": F.char_length, "CONCAT": F.concat, "COS": F.cos, "COT": F.cot, "CRC32": lambda x: F.crc32(x.cast("binary")), "DATEDIFF": F.datediff,
    "DAYNAME": lambda d: F.date_format(d, "EEEE"), "DAYOFMONTH": F.dayofmonth, "DAYOFWEEK": F.dayofweek, "DAYOFYEAR": F.dayofyear, "DEGREES": F.degrees, "EXP": F.exp,
    "FLOOR": F.floor, "FROM_BASE64": F.unbase64, "HEX": F.hex, "IFNULL": F.ifnull, "INSTR": F.instr, "ISNULL": F.isnull,
    "LAST_DAY": F.last_day, "LCASE": F.lower, "LOWER": F.lower, "LTRIM": F.ltrim, "MD5": lambda x: F.md5(x.cast("binary")), "MONTHNAME": lambda d: F.date_format(d, "MMMM"), "NULLIF": F.nullif,
    "OCTET_LENGTH": F.octet_length, "LENGTH": F.octet_length, "PI": F.pi, "POW": F.pow, "POWER": F.pow, "QUARTER": F.quarter, "RADIANS": F.radians, "RAND": F.rand, "REVERSE": F.reverse,
    "ROUND": F.round, "RTRIM": F.rtrim, "SHA": lambda x: F.sha1(x.cast("binary")), "SHA1": lambda x: F.sha1(x.cast("binary")), "SHA2": lambda x, n: F.sha2(x.cast("binary"), n), "SIGN": F.sign,
    "SIN": F.sin, "SOUNDEX": F.soundex, "SPACE": lambda n: F.repeat(F.lit(" "), n), "SUBSTRING_INDEX": F.substring_index, "TAN": F.tan, "TO_BASE64": lambda x: F.base64(x.cast("binary")),
    "UCASE": F.upper, "UPPER": F.upper, "UNHEX": F.unhex, "UUID": F.uuid, "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
    "ASCII": F.ascii, "COALESCE": F.coalesce, "REPEAT": F.repeat, "REPLACE": F.replace, "LEFT": F.left, "RIGHT": F.right, "TRIM": F.trim, "CONV": F.conv, "LPAD": F.lpad, "RPAD": F.rpad,
    "REGEXP_LIKE": F.regexp_like, "REGEXP_INSTR": F.regexp_instr, "REGEXP_REPLACE": F.regexp_replace, "REGEXP_SUBSTR": F.regexp_substr, "WEEKDAY": F.weekday, "WEEKOFYEAR": F.weekofyear,
    "CURDATE": F.current_date, "NOW": F.now, "DATABASE": F.current_database, "USER": F.current_user, "COLLATION": F.collation, "AES_ENCRYPT": lambda x, k: F.aes_encrypt(x, k, F.lit("ECB")),
    "AES_DECRYPT": lambda x, k: F.aes_decrypt(x, k, F.lit("ECB")), "CONVERT_TZ": lambda t, a, b: F.convert_timezone(a, b, t), "FROM_UNIXTIME": F.from_unixtime, "UNIX_TIMESTAMP": F.unix_timestamp,
    "EXTRACTVALUE": F.xpath_string, "VERSION": F.version, "JSON_VALID": lambda x: F.when(x.isNotNull(), F.try_parse_json(x).isNotNull()), "JSON_EXTRACT": F.get_json_object, "JSON_LENGTH": json_length,
}

MYSQL |= _SAME
MYSQL |= {
    "ACOS": lambda x: _finite(F.acos(x)), "ASIN": lambda x: _finite(F.asin(x)), "ATAN": lambda *a: F.atan(a[0]) if len(a) == 1 else F.atan2(*a), "BIN_TO_UUID": bin_to_uuid, "CHAR": char_of,
    "CONCAT_WS": lambda s, *a: F.concat_ws(s, *a), "DATE_FORMAT": date_format, "ELT": elt, "EXPORT_SET": export_set, "FIELD": field, "FIND_IN_SET": F.find_in_set, "FORMAT": format_number,
    "FORMAT_BYTES": format_bytes, "FROM_DAYS": from_days, "GREATEST": mysql_greatest, "LEAST": mysql_least, "INET_ATON": inet_aton, "INET_NTOA": inet_ntoa, "INSERT": insert_at,
    "INTERVAL": interval_index, "IS_IPV4": lambda x: x.rlike(IPV4), "IS_IPV6": is_ipv6, "IS_UUID": lambda x: x.rlike(UUID), "JSON_KEYS": json_keys,
    "JSON_MERGE_PATCH": json_udf.json_merge_patch, "JSON_QUOTE": json_quote, "JSON_UNQUOTE": json_unquote, "LN": lambda x: mysql_log(x), "LOG": mysql_log, "LOG10": lambda x: F.when(x > 0, F.log10(x)),
    "LOG2": lambda x: F.when(x > 0, F.log2(x)), "LOCATE": lambda s, x, *at: F.locate(s, x, *at), "MAKEDATE": makedate, "MAKE_SET": make_set, "MATCH": match_against, "MOD": mysql_mod, "OCT": lambda x: F.conv(x, 10, 8),
    "ORD": mysql_ord, "PERIOD_ADD": period_add, "PERIOD_DIFF": period_diff, "QUOTE": mysql_quote, "SEC_TO_TIME": sec_to_time, "SQRT": lambda x: F.when(x >= 0, F.sqrt(x)), "STRCMP": strcmp,
    "STR_TO_DATE": str_to_date, "TIME_TO_SEC": time_to_sec, "TO_DAYS": to_days, "TO_SECONDS": to_seconds, "TRUNCATE": truncate, "UUID_TO_BIN": uuid_to_bin, "WEEK": week_mode0, "YEARWEEK": yearweek,
    "DIV": int_div, "IF": lambda c, a, b: F.when(F.coalesce(c, F.lit(False)), a).otherwise(b),
}

MYSQL |= {
    "JSON_SET": json_udf.json_set, "JSON_INSERT": json_udf.json_insert, "JSON_REPLACE": json_udf.json_replace, "JSON_REMOVE": json_udf.json_remove, "JSON_ARRAY_APPEND": json_udf.json_array_append,
    "JSON_ARRAY_INSERT": json_udf.json_array_insert, "JSON_DEPTH": json_udf.json_depth, "JSON_TYPE": json_udf.json_type, "JSON_PRETTY": json_udf.json_pretty, "JSON_MERGE_PRESERVE": json_udf.json_merge_preserve,
    "JSON_MERGE": json_udf.json_merge_preserve, "JSON_CONTAINS": json_udf.json_contains, "JSON_OVERLAPS": json_udf.json_overlaps, "JSON_SEARCH": json_udf.json_search, "JSON_CONTAINS_PATH": json_udf.json_contains_path,
    "ST_X": lambda p: p["x"], "ST_Y": lambda p: p["y"], "ST_LONGITUDE": lambda p: p["x"], "ST_LATITUDE": lambda p: p["y"], "POINT": geometry.point, "LINESTRING": geometry.line, "ST_AREA": geometry.area, "ST_LENGTH": geometry.length,
    "ST_CENTROID": geometry.centroid, "ST_CONTAINS": geometry.contains, "ST_WITHIN": lambda p, r: geometry.contains(r, p), "ST_DISTANCE": geometry.distance, "ST_DISTANCE_SPHERE": geometry.distance_sphere, "ST_ENVELOPE": geometry.envelope,
    "ST_NUMPOINTS": geometry.num_points, "ST_POINTN": geometry.point_n, "ST_STARTPOINT": geometry.start_point, "ST_ENDPOINT": geometry.end_point, "ST_ISCLOSED": geometry.is_closed, "ST_SWAPXY": geometry.swap_xy,
    "ST_ASTEXT": geometry.as_text, "ST_ASWKT": geometry.as_text, "ST_GEOMFROMTEXT": geometry.from_text, "ST_GEOHASH": geometry.geohash, "MBRCONTAINS": geometry.mbr_covers, "MBRCOVERS": geometry.mbr_covers,
    "MBRWITHIN": lambda a, b: geometry.mbr_covers(b, a), "MBRCOVEREDBY": lambda a, b: geometry.mbr_covers(b, a), "MBRDISJOINT": geometry.mbr_disjoint, "MBREQUALS": geometry.mbr_equals, "MBRINTERSECTS": geometry.mbr_intersects, "MBRTOUCHES": geometry.mbr_touches,
}

POSTGRES |= {
    "jsonb_path_query_array": json_udf.path_query_array, "jsonb_path_exists": json_udf.path_exists, "timestamp_in": datetimes.parse_timestamp, "interval_in": datetimes.parse_interval,
    "num_nulls": num_nulls, "num_nonnulls": num_nonnulls, "initcap": initcap, "regexp_split_to_array": regexp_split, "similarity": similarity, "word_similarity": word_similarity, "show_trgm": show_trgm,
    "unaccent": unaccent, "levenshtein": F.levenshtein, "soundex": F.soundex, "difference": lambda a, b: sum((F.substring(F.soundex(a), i, 1) == F.substring(F.soundex(b), i, 1)).cast("int") for i in range(1, 5)),
    "nlevel": nlevel, "subpath": subpath, "lca": lca, "ltree_isparent": is_ancestor, "akeys": F.map_keys, "avals": F.map_values, "exist": F.map_contains_key, "hs_concat": hstore_concat, "delete": hstore_delete,
    "slice": hstore_slice, "hstore_to_json": F.to_json, "cube_distance": cube_distance, "earth_distance": earth_distance, "digest": digest, "hmac": hmac_sha256, "icount": F.size, "sort": F.array_sort, "uniq": F.array_distinct,
    "idx": F.array_position, "array_length": lambda a: F.when(F.size(a) > 0, F.size(a)), "cardinality": F.size, "array_append": F.array_append, "array_position": F.array_position, "array_cat": F.concat,
    "array_remove": F.array_remove, "array_to_string": F.array_join, "string_to_array": F.split, "format": F.format_string, "gen_random_uuid": F.uuid, "isn_ok": isbn13_ok, "epoch": epoch,
    "date_trunc": F.date_trunc, "trunc": truncate, "div": pg_int_div, "cbrt": F.cbrt, "width_bucket": F.width_bucket, "translate": F.translate, "md5": F.md5, "concat_ws": F.concat_ws, "split_part": F.split_part,
}

MYSQL |= {"ADDTIME": addtime, "SUBTIME": subtime, "TIMEDIFF": timediff, "MAKETIME": maketime, "TIME_FORMAT": time_format, "SOUNDS LIKE": soundex_like, "ST_COLLECT": geometry.collect}

POSTGRES |= {
    "array_ndims": array_ndims, "array_upper": array_upper, "array_lower": array_lower, "array_dims": array_dims, "array_fill": array_fill, "trim_array": trim_array, "intset": intset,
    "levenshtein_less_equal": levenshtein_less_equal, "strict_word_similarity": strict_word_similarity,
}

POSTGRES |= {
    "defined": hstore_defined, "exists_any": hstore_exists_any, "exists_all": hstore_exists_all, "delete_keys": hstore_delete_keys, "delete_pairs": hstore_delete_pairs, "hs_contains": hstore_contains, "hs_contained": lambda a, b: hstore_contains(b, a),
    "skeys": lambda a: F.explode(F.map_keys(a)), "svals": lambda a: F.explode(F.map_values(a)), "each": F.explode, "hstore": hstore_of, "hstore_from_record": hstore_of_row, "hstore_to_array": hstore_to_array, "hstore_to_matrix": hstore_to_matrix,
    "hstore_to_jsonb": lambda a: F.parse_json(F.to_json(a)), "populate_record": populate_record, "subltree": subltree, "index": ltree_index, "ltree_matches": ltree_matches, "ltree_isparent_of": lambda a, b: is_ancestor(b, a), "ltree2text": lambda p: p, "text2ltree": lambda p: p,
    "cube_union": cube_union, "cube_overlap": cube_overlaps, "cube_contains": cube_contains, "distance_taxicab": taxicab_distance, "distance_chebyshev": chebyshev_distance, "uuid_generate_v4": F.uuid, "uuid_generate_v5": uuid_v5, "isbn13": isbn10_to_13, "is_valid_issn": issn_ok,
}

MYSQL |= {
    "ST_GEOMETRYTYPE": geometry.geometry_type, "ST_DIMENSION": geometry.dimension, "ST_ISEMPTY": geometry.is_empty, "ST_INTERSECTS": geometry.polygons_meet, "ST_CROSSES": geometry.lines_meet, "ST_DISJOINT": geometry.polygons_disjoint, "ST_EQUALS": geometry.same_points,
    "ST_ISSIMPLE": geometry.is_simple, "ST_ISVALID": geometry.is_valid, "ST_MAKEENVELOPE": geometry.make_envelope, "ST_ENVELOPE": geometry.envelope_ring, "ST_POINTATDISTANCE": geometry.point_at_distance, "ST_LINEINTERPOLATEPOINT": geometry.interpolate,
    "ST_HAUSDORFFDISTANCE": geometry.hausdorff_distance, "ST_BUFFER": geometry.buffer_point, "ST_ASGEOJSON": geometry.as_geojson, "ST_GEOMFROMGEOJSON": geometry.from_geojson, "ST_POINTFROMGEOHASH": geometry.point_from_geohash, "ST_LATFROMGEOHASH": geometry.lat_from_geohash,
    "ST_LONGFROMGEOHASH": geometry.long_from_geohash, "ST_GEOMETRYN": geometry.geometry_n, "ST_NUMGEOMETRIES": geometry.num_geometries, "ST_SRID": lambda g: F.when(g.isNotNull(), 0), "ST_SWAPXY": geometry.swap_xy, "ST_EXTERIORRING": lambda r: r,
    "ST_NUMINTERIORRING": lambda r: F.when(r.isNotNull(), 0), "ST_NUMINTERIORRINGS": lambda r: F.when(r.isNotNull(), 0), "ST_VALIDATE": lambda r: F.when(geometry.is_valid(r), r),
    **{f"ST_{n}FROM{t}": geometry.from_text for n in ("POINT", "LINE", "LINESTRING", "POLY", "POLYGON", "GEOMETRY") for t in ("TEXT", "TXT")},
}

MYSQL |= {"JSON_SCHEMA_VALID": json_udf.json_schema_valid}

#: Reserved for sessions and servers, without a meaning for data; named here so that a lookup says so.
WITHOUT_DATA = frozenset(
    "BENCHMARK CONNECTION_ID FOUND_ROWS GET_LOCK GTID_SUBSET GTID_SUBTRACT ICU_VERSION IS_FREE_LOCK IS_USED_LOCK LAST_INSERT_ID LOAD_FILE MASTER_POS_WAIT NAME_CONST PS_CURRENT_THREAD_ID PS_THREAD_ID RELEASE_ALL_LOCKS RELEASE_LOCK ROLES_GRAPHML SLEEP SOURCE_POS_WAIT STATEMENT_DIGEST STATEMENT_DIGEST_TEXT UUID_SHORT VALIDATE_PASSWORD_STRENGTH WAIT_FOR_EXECUTED_GTID_SET".split()
)


def lookup(name: str, dialect: str = "mysql") -> Builder:
    table = MYSQL if dialect == "mysql" else POSTGRES
    key = name.upper() if dialect == "mysql" else name.lower()
    if key in table:
        return table[key]
    if key in WITHOUT_DATA:
        raise NotImplementedError(f"{name} concerns a server's session, not data")
    raise KeyError(name)

