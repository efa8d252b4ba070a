"""Content ids, seeded coins, closed keys and private keys.

An id is the SHA-256 of a canonical string: typed fields joined by '|', numbers written by one rule. Ids are equal where
contents are; they aren't byte-compatible with any other tool's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_ID = r"\A[A-Za-z0-9._-]{1,64}\z"
SHA256 = r"\A[a-f0-9]{64}\z"


def content_id(*fields: Column | str) -> Column:
    """Strings as they are; other types by their cast. Numbers should be integers or fixed-point text (see fixed())."""
    return F.sha2(F.concat_ws("|", *[F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields]), 256)


def unordered_id(tag: str, *members: Column) -> Column:
    """An id that doesn't depend on the order of its members."""
    return F.sha2(F.concat_ws("|", F.lit(tag), F.array_sort(F.array(*members))), 256)


def fixed(value: Column, digits: int = 2) -> Column:
    """A number as an integer of its last digit: 0.25 -> '25' at two digits, exact for such values."""
    return F.round(value * 10**digits).cast("long").cast("string")


def coin(seed: str, ident: Column) -> Column:
    """True for half of all ids: the parity of the eighth hex digit of a seeded hash."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256), 8, 1).isin(*"13579bdf")


def rank_code(number: Column) -> Column:
    """q- and the number in base 36."""
    return F.concat(F.lit("q-"), F.lower(F.conv(number.cast("string"), 10, 36)))


def key_violations(raw: Column, expected: list[str]) -> tuple[Column, Column]:
    """Unknown and missing top-level keys of a JSON object."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, expected))
    return F.array_except(keys, want), F.array_except(want, keys)


def has_key(raw: Column, name: str) -> Column:
    """Whether any object inside a JSON text has the key: string values are taken out before the search."""
    # a string that isn't followed by a colon is a value
    bare = F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*"(?!\s*:)', '""')
    return F.coalesce(bare.rlike(rf'"{name}"\s*:'), F.lit(False))


def escape_markup(value: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def first_code(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for code, holds in reversed(rules):
        out = F.when(holds, code).otherwise(out)
    return out
