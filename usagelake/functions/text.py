"""Text and number columns: cleaning, safety checks, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what metadata must not hold: paths, URLs, addresses, control characters.
UNSAFE = r"^/|\\|://|@|^.:/|\p{Cc}"


def or_unknown(key: str | Column) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def nonblank(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*(nonblank(c) for c in columns))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def safe_metadata(c: Column) -> Column:
    return F.coalesce((F.octet_length(c) <= 256) & ~c.rlike(UNSAFE), F.lit(False))


def integer(c: Column) -> Column:
    """A whole number from JSON text; null for fractions, exponents and anything else."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))


def invalid_integer(c: Column) -> Column:
    return c.isNotNull() & integer(c).isNull()


def token_sum(*columns: Column) -> Column:
    """Sum with nulls as 0; null if a part is negative or the sum overflows."""
    total, bad = F.lit(0).cast("bigint"), F.lit(False)
    for c in columns:
        part = F.coalesce(c, F.lit(0))
        total, bad = F.try_add(total, part), bad | (part < 0)
    return F.when(~bad, total)


def json_tuple(*parts: Column | str) -> Column:
    """A compact JSON array of strings, with <, > and & and the line separators escaped as identities need them."""
    text = F.to_json(F.array(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts)))
    for raw, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def tuple_hash(*parts: Column | str) -> Column:
    return F.sha2(json_tuple(*parts), 256)


def location_label(c: Column) -> Column:
    """At most 48 code points without control characters; blank and . are unknown."""
    text = F.substring(F.trim(F.regexp_replace(c, r"\p{Cc}", "")), 1, 48)
    return F.when(F.coalesce(text, F.lit("")).isin("", "."), F.lit("unknown")).otherwise(text)


def exact_count(n: Column) -> Column:
    return F.format_number(n, 0)


def compact_count(n: Column) -> Column:
    """1.2K, 3.4M and so on with one decimal, rounded half up; what rounds to 1000 goes to the next unit."""
    out = n.cast("string")
    for power, (unit, above) in enumerate((("K", "M"), ("M", "B"), ("B", "T"), ("T", "")), 1):
        tenths = F.floor((n + F.lit(10 ** (3 * power)) / 20) / (F.lit(10 ** (3 * power)) / 10))
        shown = lambda t, u: F.concat(F.floor(t / 10).cast("string"), F.when(t % 10 != 0, F.concat(F.lit("."), (t % 10).cast("string"))).otherwise(""), F.lit(u))
        promoted = F.when((tenths >= 10000) & F.lit(bool(above)), F.lit(f"1{above}")).otherwise(shown(tenths, unit))
        out = F.when(n >= 10 ** (3 * power), promoted).otherwise(out)
    return out


def chart_label(c: Column) -> Column:
    """At most 17 UTF-16 units; longer ones keep 15 and an ellipsis, without half a character."""
    units = lambda x: F.length(x) + F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    kept = F.regexp_extract(c, r"^(?:[\x{0}-\x{FFFF}]|[\x{10000}-\x{10FFFF}]){0,15}", 0)
    short = F.aggregate(F.sequence(F.lit(1), F.lit(8)), kept, lambda acc, _: F.when(units(acc) > 15, F.substring(acc, 1, F.length(acc) - 1)).otherwise(acc))
    return F.when(units(c) > 17, F.concat(short, F.lit("…"))).otherwise(c)


def plain_count(n: Column) -> Column:
    """A terminal's tokens: nothing for 0, whole thousands (K) and millions (M), rounded towards 0."""
    whole = lambda by, unit: F.concat((F.signum(n) * F.floor(F.abs(n) / by)).cast("bigint").cast("string"), F.lit(unit))
    return F.when(n == 0, "").when(F.abs(n) < 1000, n.cast("string")).when(F.abs(n) < 1_000_000, whole(1000, "K")).otherwise(whole(1_000_000, "M"))


def plain_context(n: Column) -> Column:
    """A terminal's context load: as plain_count, but thousands (k) are rounded up, without sign."""
    return F.when((n == 0) | (F.abs(n) < 1000) | (F.abs(n) >= 1_000_000), plain_count(n)).otherwise(F.concat(F.ceil(F.abs(n) / 1000).cast("string"), F.lit("k")))


def merged(a: Column, b: Column) -> Column:
    """Two lists as one, sorted, each value once."""
    return F.array_sort(F.array_union(a, b))
