"""Seeded splits and subsets."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions.hashing import hex_to_int, seed_key
from siltmark.operators.selection import lowest_cuts, mark_lowest, select_lowest

FRACTIONS = {"train": Decimal("0.70"), "val": Decimal("0.10"), "test": Decimal("0.20")}
SLOTS = 10_000


def fraction(value) -> Decimal:
    """Shares are decimals: 100 * 0.29 as a double would floor to 28."""
    d = Decimal(str(value)).quantize(Decimal("0.000001"))
    if d < 0 or d > 1:
        raise ValueError(f"share {value} is outside [0, 1]")
    return d


def cumulative(fractions: dict) -> list[tuple[str, Decimal]]:
    total, out = Decimal(0), []
    for name, share in fractions.items():
        total += fraction(share)
        out.append((name, total))
    if total != 1:
        raise ValueError(f"split shares sum to {total}, not 1")
    return out


def split(df: DataFrame, seed: int, fractions: dict | None = None, row_id: str = "row_id") -> DataFrame:
    """Add ``split``: a row's side depends only on the seed and its id. Narrow, no job."""
    slot = hex_to_int(seed_key("split", seed, row_id)) % SLOTS
    steps = cumulative(fractions or FRACTIONS)
    side = None
    for name, upto in steps[:-1]:
        hit = slot < int(upto * SLOTS)
        side = F.when(hit, F.lit(name)) if side is None else side.when(hit, F.lit(name))
    side = F.lit(steps[-1][0]) if side is None else side.otherwise(F.lit(steps[-1][0]))
    return df.withColumn("split", side)


def split_stratified(
    df: DataFrame, seed: int, fractions: dict | None = None, row_id: str = "row_id", label: str = "label"
) -> DataFrame:
    """Add ``split`` with exact quotas per class: the side ends at floor(share * class rows)."""
    steps = cumulative(fractions or FRACTIONS)[:-1]
    last = list((fractions or FRACTIONS))[-1]
    quotas = {name: (lambda n, upto=upto: F.floor(F.lit(upto) * n)) for name, upto in steps}
    cuts = lowest_cuts(df, quotas, seed, "strata", row_id, [label])
    marked = mark_lowest(df, cuts, list(quotas), seed, "strata", row_id, [label], prefix="_in_")
    side = F.lit(last)
    for name in reversed(list(quotas)):
        side = F.when(F.col(f"_in_{name}"), F.lit(name)).otherwise(side)
    return marked.withColumn("split", side).drop(*[f"_in_{n}" for n in quotas])


def subset(df: DataFrame, per_class: int, seed: int, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """At most ``per_class`` rows of every class, chosen by seed."""
    return select_lowest(df, per_class, seed, "subset", row_id, [label])
