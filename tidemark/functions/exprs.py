"""Column expressions shared by the operators: time arithmetic, rounding, tolerant parsing, null-safe row functions.

Timestamps are naive UTC (TIMESTAMP_NTZ); sessions run in UTC.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
#: Fixed value: texts that stand for a missing number in database exports.
NULL_TOKENS = ("", "-", "None", "NaN", "nan")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def floor_to(ts: Column | str, step: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(step)))


def ceil_to(ts: Column | str, step: int) -> Column:
    us = micros(ts)
    return from_micros(us + F.pmod(-us, F.lit(step)))


def round_half_even(ts: Column | str, step: int = MINUTE) -> Column:
    """Nearest multiple of ``step``; halves go to the even multiple."""
    return from_micros(F.bround(micros(ts) / F.lit(float(step))) * F.lit(float(step)))


def strip_subseconds(ts: Column | str) -> Column:
    return F.date_trunc("second", col(ts)).cast("timestamp_ntz")


def parse_ts(text: Column | str, *formats: str) -> Column:
    """First format that fits; a zone suffix +00 or +00:00 is ignored; anything else is NULL."""
    plain = F.regexp_replace(F.trim(col(text)), r"\+00(:00)?$", "")
    formats = formats or ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_number(text: Column | str, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """NULL tokens and non-numbers become NULL."""
    t = F.trim(col(text))
    return F.when(t.isin(*tokens), None).otherwise(t.try_cast("double"))


def number_or_null(value: Column | str) -> Column:
    """A text cell (a formula) is NULL, a number is itself."""
    return col(value).try_cast("double")


def tipping_bucket(cell: Column | str, tip: str = "0.2") -> Column:
    """struct(value, corrected): ``=0.2*n`` or ``=n*0.2`` is recovered as n tips; ``NAN`` and other formulas are NULL."""
    c = F.trim(col(cell).cast("string"))
    t = tip.replace(".", r"\.")
    n = F.coalesce(F.nullif(F.regexp_extract(c, rf"^={t}\*(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(c, rf"^=(\d+)\*{t}$", 1), F.lit("")))
    value = F.when(n.isNotNull(), F.bround(n.cast("double") * float(tip), 4)).when(c.startswith("=") | (F.upper(c) == "NAN"), None).otherwise(c.try_cast("double"))
    return F.struct(value.alias("value"), n.isNotNull().alias("corrected"))


def braced_list(text: Column | str) -> Column:
    """``{a,b}`` as array<double>; blanks are left out."""
    parts = F.split(F.regexp_replace(col(text), r"[{}\s]", ""), ",")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.try_cast("double"))


def season(ts: Column | str) -> Column:
    m = F.month(col(ts))
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def hydro_year(ts: Column | str) -> Column:
    return F.year(col(ts)) + F.when(F.month(col(ts)) >= 10, 1).otherwise(0)


def cyclical(ts: Column | str) -> dict[str, Column]:
    """Hour of day and day of year as sine and cosine, and the month."""
    two_pi = 2 * 3.141592653589793
    h = (F.hour(col(ts)) + F.minute(col(ts)) / 60.0) / 24.0
    d = F.dayofyear(col(ts)) / 365.25
    return {"hour_sin": F.sin(h * two_pi), "hour_cos": F.cos(h * two_pi), "doy_sin": F.sin(d * two_pi), "doy_cos": F.cos(d * two_pi), "month": F.month(col(ts))}


def row_sum(*cols: Column | str, min_count: int = 1) -> Column:
    """Sum over columns that skips NULL; NULL with fewer than ``min_count`` values."""
    cs = [col(c) for c in cols]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cs])
    return F.when(n >= min_count, reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs]))


def row_mean(*cols: Column | str) -> Column:
    cs = [col(c) for c in cols]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cs])
    return F.when(n > 0, row_sum(*cs) / n)


def row_max(*cols: Column | str) -> Column:
    return F.greatest(*[col(c) for c in cols])


def round_binary(value: Column | str, digits: int = 0) -> Column:
    """The binary value rounded to ``digits`` decimals, halves to even, as a language does that rounds the number itself and not
    its shortest decimal text: 2.675 lies below the half and gives 2.67, 0.125 is a half and gives 0.12. ``bround`` and
    ``round`` go by the text.

    The product with the power of ten is split into its double and the exact rest (Veltkamp, Dekker), which tells on which side
    of a half it lies. Values whose product reaches 2^52 are returned as they are.
    """
    x, scale = col(value).cast("double"), float(10**digits)
    p, c = x * scale, 134217729.0
    hi = lambda v: v * c - (v * c - v)
    a, b = hi(x), hi(F.lit(scale))
    rest = ((a * b - p) + a * (F.lit(scale) - b) + (x - a) * b) + (x - a) * (F.lit(scale) - b)
    low = F.floor(p).cast("double")
    over = p - low
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    # A product that is whole to its last bit, but lies below that number, still rounds to it.
    return F.when(F.abs(p) >= 2.0**52, x).otherwise((low + F.when(up, 1.0).otherwise(0.0)) / scale + 0.0)


def first_argmax(value: Column | str, order: Column | str) -> Column:
    """Aggregate: the ``order`` of the largest value, the first of ties; rows without a value don't count. Without ties of
    ``max_by``, which are unspecified."""
    v, o = col(value), col(order)
    return F.min_by(o, F.struct(-v, o))


def planar_km(dx: Column, dy: Column) -> Column:
    return F.round(F.hypot(dx, dy) / 1000.0, 2)


def plausible(variable: Column | str, value: Column | str) -> Column:
    """Level and rain below 0 are 0; air temperature below -15 and water temperature outside [-1, 45] are NULL."""
    v, k = col(value), col(variable)
    return (
        F.when(k.isin("HEIGHT_m", "PRECIP_mm") & (v < 0), 0.0)
        .when((k == "TEMP_C") & (v < -15), None)
        .when((k == "WATER_TEMP_C") & ~v.between(-1, 45), None)
        .otherwise(v)
    )
