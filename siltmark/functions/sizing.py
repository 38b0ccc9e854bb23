"""Size-checked broadcast. Nothing in the library broadcasts a frame it has not measured."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
MAX_CLASSES = 10_000


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> pa.Table | None:
    """The rows of ``df`` if there are at most ``limit``, else None. Fetches ``limit + 1``."""
    table = df.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None


def local_side(df: DataFrame, table: pa.Table | None) -> DataFrame:
    """A measured table as a broadcast local relation; ``df`` unhinted if it was too large."""
    if table is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Turn ``df`` into a broadcast local table if it has at most ``limit`` rows.

    A larger frame comes back unhinted, so joins against it shuffle (and AQE may split
    their skewed keys): same answer, other plan.
    """
    return local_side(df, small_table(df, limit))


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by contract; fails loudly when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def known_classes(df: DataFrame, label: str = "label", limit: int = MAX_CLASSES) -> list:
    """Sorted distinct labels. Labels are a small closed set by contract; this checks it."""
    rows = bounded_rows(df.select(label).where(F.col(label).isNotNull()).distinct(), limit, f"classes in {label}")
    return sorted(r[0] for r in rows)
