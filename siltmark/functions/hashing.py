"""Seeded keys: every random-looking choice is a function of (salt, seed, row id)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_key(salt: str, seed: int, row_id: str) -> Column:
    """32 hex digits, uniform over rows and independent of partitioning or order."""
    return F.expr(f"md5(concat_ws(':', '{salt}', '{seed}', cast(`{row_id}` as string)))")


def hex_to_int(key: Column, digits: int = 8, start: int = 1) -> Column:
    """Integer value of ``digits`` hex digits of a key (``digits`` <= 15)."""
    return F.conv(F.substring(key, start, digits), 16, 10).cast("bigint")


def uniform(key: Column) -> Column:
    """Double in [0, 1) from the first eight hex digits of a key."""
    return hex_to_int(key, 8) / F.lit(4294967296.0)


def content_key(columns: list[str], sep: str = "|") -> Column:
    """md5 over the string form of all columns, each behind its length, so that no value can
    imitate a border; NULL and the empty string stay apart."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("\\N")) for t in text]
    return F.md5(F.concat_ws(sep, *parts))
