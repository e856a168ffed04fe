"""Hash keys: digests, buckets and seeded order, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def sha(column: Column | str) -> Column:
    return F.sha2(text(column), 256)


def hash48(column: Column | str) -> Column:
    """The first 12 hex digits of SHA-256 as a bigint."""
    return F.conv(F.substring(sha(column), 1, 12), 16, 10).cast("bigint")


def stable_bucket(column: Column | str, buckets: int = 1000) -> Column:
    return hash48(column) % F.lit(buckets).cast("bigint")


def seeded(seed: int | str, *columns: Column | str) -> Column:
    """Hex digest of 'seed|key...'; ordering by it is a reproducible random order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[text(c) for c in columns]), 256)


def uniform(seed: int | str, *columns: Column | str) -> Column:
    """A number in (0, 1) from the seeded digest."""
    digits = F.conv(F.substring(seeded(seed, *columns), 1, 12), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(2**48))


def json_list(column: Column) -> Column:
    """A JSON list of strings with ', ' between items; quotes, backslashes and control characters are escaped.

    Items are escaped one by one only in rows that need it; most lists are one join of their items.
    """
    each = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: json_text(x)), ", "), F.lit("]"))
    plain = ~F.array_join(column, "").rlike(r'["\\\x00-\x1f]') & ~F.exists(column, lambda x: x.isNull())
    joined = F.when(F.size(column) == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.array_join(column, '", "'), F.lit('"]')))
    return F.when(F.coalesce(plain, F.lit(False)), joined).otherwise(each)


def json_text(column: Column | str) -> Column:
    """One string as a JSON value, quoted and escaped."""
    one = F.to_json(F.array(text(column)))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def json_array(*values: Column) -> Column:
    """A compact JSON list of values that are already JSON text."""
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))
