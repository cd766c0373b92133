"""Encodings as columns: fixed point, dates, string codes, packed keys, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shifts of packed keys, and the FNV-1a offset and prime.
PART_SHIFT = 1 << 20
NATION_SHIFT = 1 << 8
PAIR_SHIFT = 1 << 32
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
P61 = 2**61 - 1


def fixed(x: Column) -> Column:
    """Thousandths, cut toward zero."""
    return (F.lit(1000.0) * x).cast("bigint")


def epoch_seconds(d: Column) -> Column:
    """Seconds since 1970 at midnight of the date, 0 for none."""
    return F.coalesce(F.unix_date(d.try_cast("date")).cast("bigint") * 86400, F.lit(0).cast("bigint"))


def year_of(d: Column) -> Column:
    return F.coalesce(F.year(d.try_cast("date")).cast("bigint"), F.lit(0).cast("bigint"))


def string_code(s: Column) -> Column:
    """The sum of position (from 1) times code point. Different strings may share a code: join on strings, not on this."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1)))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, i: a + i.cast("bigint") * F.ascii(F.substring(s, i, F.lit(1))).cast("bigint"))


def string_code_trimmed(s: Column) -> Column:
    return string_code(F.trim(s))


def pack(high: Column, low: Column, shift: int) -> Column:
    return high.cast("bigint") * shift + low.cast("bigint")


def shift_id(x: Column) -> Column:
    return x + 1


def fnv1a64(s: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as a decimal; products are taken in decimals, modulo 2**64."""
    two64 = F.lit(str(2**64)).cast("decimal(20,0)")
    data = F.hex(F.encode(s, "UTF-8"))
    count = (F.char_length(data) / 2).cast("int")
    octets = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.conv(F.substring(data, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    low = lambda h: (h % 256).cast("bigint")

    def step(h: Column, b: Column) -> Column:
        x = (h - low(h).cast("decimal(20,0)") + low(h).bitwiseXOR(b).cast("decimal(20,0)")).cast("decimal(20,0)")
        # The prime is 2**40 + 435: the first product is taken of the low 24 bits, so that both fit 38 digits.
        return ((((x % F.lit(2**24)).cast("decimal(20,0)") * F.lit(2**40).cast("decimal(13,0)")).cast("decimal(38,0)") + (x * F.lit(435).cast("decimal(3,0)")).cast("decimal(38,0)")) % two64).cast("decimal(20,0)")

    return F.aggregate(octets, F.lit(str(FNV_OFFSET)).cast("decimal(20,0)"), step)


def zigzag(x: Column) -> Column:
    return F.when(x >= 0, x * 2).otherwise(-x * 2 - 1)


def cell_cents(s: Column) -> Column:
    """A text cell as a number: integers as they are, decimals as rounded hundredths in zigzag order, dates as YYYYMMDD; else null."""
    whole = s.rlike(r"^\d+$")
    date = s.rlike(r"^\d{4}-\d{2}-\d{2}$")
    real = s.rlike(r"^-?\d+\.\d+$")
    return F.when(whole, s.try_cast("bigint")).when(date, F.regexp_replace(s, "-", "").try_cast("bigint")).when(real, zigzag(F.round(s.try_cast("double") * 100).cast("bigint")))


def limbs(x: Column, bits: int, count: int) -> Column:
    """Little-endian limbs of a non-negative number."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.call_function("shiftrightunsigned", x.cast("bigint"), (i * bits).cast("int")).bitwiseAND((1 << bits) - 1))


def ceil_log2(n: int) -> int:
    return max(0, (n - 1).bit_length())


def least_degree(rows: int, headroom: int = 64) -> int:
    """The least k with 2**k rows and headroom."""
    return ceil_log2(rows + headroom)


def cell_text(x: Column) -> Column:
    """A cell as text that can be joined to others without doubt: n for null, else its length, a colon and itself."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("n"))


def cell_sql(c: str) -> str:
    return f"COALESCE(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')"
