"""Exact interpolated quantiles per group with bounded state.

Spark's ``percentile`` keeps every distinct value of a group in one task. That is fine
for groups whose sizes were counted first; beyond ``state_rows`` the quantile is found by
bracketing instead: a sketch proposes a narrow value range, one narrow scan counts the
rows below it and the (value, count) pairs inside it, and only those are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.sizing import local_side, small_side, small_table

STATE_ROWS = 2_000_000
#: Distinct values a bracket of ``column_quantiles`` may hold for each wanted quantile.
BRACKET_VALUES = 4096
#: Rounds of brackets before giving up; two or three are usual at any size.
MAX_SCANS = 20
GROUPS_PER_TASK = 20
SKETCH_ACCURACY = 20_000


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: list[float],
    group: list[str] | None = None,
    state_rows: int = STATE_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per (group, prob): columns ``group..., prob, n_rows, quantile``.

    NULL values are ignored; the definition is linear interpolation between the two
    order statistics around ``prob * (n - 1)``. Groups with a NULL key are kept.
    """
    group = list(group or [])
    col = F.col(value) if isinstance(value, str) else value
    vals = df.select(*group, col.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = vals.groupBy(*group).agg(F.count("*").alias("n_rows"))
    counts = counts.where("n_rows > 0")
    table = small_table(counts)
    sized = local_side(counts, table)
    if table is None:
        largest, total = sized.agg(F.max("n_rows"), F.sum("n_rows")).head()
    else:
        sizes = table["n_rows"].to_pylist()
        largest, total = max(sizes, default=0), sum(sizes)
    # One task may hold the states of many groups, so either all of them together are small
    # or each one is.
    if total <= state_rows or largest <= state_rows // GROUPS_PER_TASK:
        return _direct(vals, probs, group)
    return _bracketed(vals, sized, probs, group, state_rows, accuracy)


def _direct(vals: DataFrame, probs: list[float], group: list[str]) -> DataFrame:
    agg = vals.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.percentile("_v", [float(p) for p in probs]).alias("_q"),
    ).where(F.col("n_rows") > 0)
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("_q").alias("quantile")))
    return agg.select(*group, "n_rows", pairs.alias("_p")).select(
        *group, F.col("_p.prob").alias("prob"), "n_rows", F.col("_p.quantile").alias("quantile")
    )


def _attach(vals: DataFrame, small: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Add the columns of a per-group table; without keys it is one literal list per row."""
    if keys:
        right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *extra)
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return vals.join(right, cond).drop(*[f"_r_{k}" for k in keys])
    rows = small.select(*extra).collect()
    structs = [F.struct(*[F.lit(r[e]).alias(e) for e in extra]) for r in rows]
    return vals.withColumn("_x", F.explode(F.array(*structs))).select(*vals.columns, *[F.col(f"_x.{e}").alias(e) for e in extra])


def _bracketed(vals, sized, probs, group, state_rows, accuracy):
    """Find the two order statistics of every (group, prob) by shrinking value brackets."""
    margin = 2.0 / accuracy
    cuts = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    sketch = vals.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", [float(c) for c in cuts], accuracy).alias("_s"),
    )
    targets = []
    for p in probs:
        lo, hi = min(1.0, max(0.0, p - margin)), min(1.0, max(0.0, p + margin))
        pos = F.lit(float(p)) * (F.col("n_rows") - 1)
        targets.append(
            F.struct(
                F.lit(float(p)).alias("prob"),
                F.floor(pos).alias("_k"),
                (pos - F.floor(pos)).alias("_frac"),
                (F.col("_min") if lo == 0.0 else F.col("_s")[cuts.index(lo)]).alias("_lo"),
                (F.col("_max") if hi == 1.0 else F.col("_s")[cuts.index(hi)]).alias("_hi"),
            )
        )
    brackets = small_side(
        sketch.select(*group, "n_rows", "_min", "_max", F.explode(F.array(*targets)).alias("_t")).select(
            *group, "n_rows", "_min", "_max", "_t.*"
        )
    )
    fields = ["prob", "n_rows", "_k", "_frac", "_lo", "_hi"]
    # Rows below a bracket collapse to one counted row before the shuffle; rows inside are
    # counted per distinct value, so a value held by a third of all rows is one row too.
    inside = (
        _attach(vals, brackets, group, fields)
        .where(F.col("_v") <= F.col("_hi"))
        .select(*group, *fields, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .groupBy(*group, *fields, "_v")
        .agg(F.count("*").alias("_c"))
    )
    w = Window.partitionBy(*group, "prob").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_end", F.sum("_c").over(w))
    at = lambda rank: (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank) & F.col("_v").isNotNull()
    upper = F.least(F.col("_k") + 1, F.col("n_rows") - 1)
    found = ranked.groupBy(*group, "prob", "n_rows", "_frac").agg(
        F.max(F.when(at(F.col("_k")), F.col("_v"))).alias("_a"),
        F.max(F.when(at(upper), F.col("_v"))).alias("_b"),
    )
    result = small_side(
        found.select(*group, "prob", "n_rows", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias("quantile"))
    )
    if result.where(F.col("quantile").isNull()).limit(1).count():
        # A sketch outside its stated error: repeat with a wider bracket, down to none at all.
        if accuracy <= 4:
            return _bracketed_whole(vals, sized, probs, group)
        return _bracketed(vals, sized, probs, group, state_rows, max(2, math.isqrt(accuracy)))
    return result


def _bracketed_whole(vals, sized, probs, group):
    """Last resort: order the distinct values of each group, spilling instead of failing."""
    w = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    dist = vals.groupBy(*group, "_v").agg(F.count("*").alias("_c")).withColumn("_end", F.sum("_c").over(w))
    t = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    tg = small_side(sized.withColumn("prob", t))
    j = _attach(dist, tg, group, ["prob", "n_rows"])
    pos = F.col("prob") * (F.col("n_rows") - 1)
    k = F.floor(pos)
    at = lambda rank: (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
    out = j.groupBy(*group, "prob", "n_rows").agg(
        F.max(F.when(at(k), F.col("_v"))).alias("_a"),
        F.max(F.when(at(F.least(k + 1, F.col("n_rows") - 1)), F.col("_v"))).alias("_b"),
    )
    return out.select(*group, "prob", "n_rows", (F.col("_a") + (F.col("_b") - F.col("_a")) * (pos - k)).alias("quantile"))


def column_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], others: list[Column] = (), accuracy: int = SKETCH_ACCURACY, bracket_values: int = BRACKET_VALUES
) -> tuple[dict[str, dict[float, float | None]], dict]:
    """Exact quantiles of many columns in two scans, without a row per value: for every column
    ``{prob: quantile}``, and the named aggregates ``others`` from the first scan.

    The first aggregate takes counts and one mergeable sketch per column. The second counts, for
    all columns at once, the values below each sketched bracket and the distinct values inside it
    (a histogram of at most ``bracket_values`` bins is exact while it has room left). A bracket
    that misses is widened and one that is too full is sketched again, on its own values. NULL and
    NaN are ignored, a value held by a third of the rows is one bin, and what reaches the driver
    does not depend on the number of rows.
    """
    if accuracy < 100 or bracket_values < 64:
        raise ValueError("a sketch this coarse cannot be made exact in a few scans")
    v = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    margin = 2.0 / accuracy
    first = df.agg(
        *others, *[F.count(v[c]).alias(f"_n{i}") for i, c in enumerate(columns)], *[F.min(v[c]).alias(f"_lo{i}") for i, c in enumerate(columns)],
        *[F.max(v[c]).alias(f"_hi{i}") for i, c in enumerate(columns)], *[F.percentile_approx(v[c], _cuts(probs, margin), accuracy).alias(f"_s{i}") for i, c in enumerate(columns)],
    ).head()
    found: dict[str, dict[float, float | None]] = {c: {} for c in columns}
    open_ = []
    for i, c in enumerate(columns):
        n, cuts = first[f"_n{i}"], _cuts(probs, margin)
        for p in probs:
            if not n:
                found[c][p] = None
                continue
            sketch = dict(zip(cuts, first[f"_s{i}"]))
            ends = first[f"_lo{i}"], first[f"_hi{i}"]
            open_.append(_Target(c, p, n, ends, _bracket_of(sketch, ends, p, margin), margin))
    for _ in range(MAX_SCANS):
        if not open_:
            break
        cells = []
        for j, t in enumerate(open_):
            cells.append(F.count_if(v[t.column] < t.bracket[0]).alias(f"b{j}"))
            cells.append(F.histogram_numeric(F.when(v[t.column].between(*t.bracket), v[t.column]), F.lit(bracket_values)).alias(f"h{j}"))
        row, left = df.agg(*cells).head(), []
        for j, t in enumerate(open_):
            value = t.resolve(row[f"b{j}"], row[f"h{j}"] or [], bracket_values)
            if value is None:
                left.append(t)
            else:
                found[t.column][t.prob] = value
        if left:
            cells = [
                F.percentile_approx(F.when(v[t.column].between(*t.ends), v[t.column]), t.cuts(), accuracy).alias(f"s{j}") for j, t in enumerate(left)
            ]
            row = df.agg(*cells).head()
            for j, t in enumerate(left):
                t.bracket = tuple(row[f"s{j}"])
        open_ = left
    if open_:
        raise RuntimeError(f"no exact bracket for {[(t.column, t.prob) for t in open_]}")
    names = [c for c in first.asDict() if not c.startswith(("_n", "_lo", "_hi", "_s"))]
    return found, {c: first[c] for c in names}


def _cuts(probs: list[float], margin: float) -> list[float]:
    return sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})


def _bracket_of(sketch: dict[float, float], ends: tuple[float, float], p: float, margin: float) -> tuple[float, float]:
    lo, hi = min(1.0, max(0.0, p - margin)), min(1.0, max(0.0, p + margin))
    return (ends[0] if lo == 0.0 else sketch[lo]), (ends[1] if hi == 1.0 else sketch[hi])


class _Target:
    """One wanted quantile: the bracket tried next, and the range of values known to hold it."""

    def __init__(self, column, prob, n, ends, bracket, margin):
        self.column, self.prob, self.n, self.ends, self.bracket, self.margin = column, prob, n, ends, bracket, margin
        self.below, self.inside = 0, n  # values below ``ends`` and inside
        position = prob * (n - 1)
        self.k = int(position)
        self.frac = position - self.k
        self.upper = min(self.k + 1, n - 1)

    def resolve(self, below: int, bins: list, room: int) -> float | None:
        """The quantile, or None after the range or the margin was adjusted for another try."""
        inside = int(sum(b["y"] for b in bins))
        if not below <= self.k <= self.upper < below + inside:
            self.margin *= 16  # the sketch was off: a wider bracket, in the end the whole range
            return None
        if len(bins) < room:
            ranks, end = {}, below
            for b in sorted(bins, key=lambda b: b["x"]):
                for r in (self.k, self.upper):
                    if end <= r < end + b["y"]:
                        ranks[r] = b["x"]
                end += int(b["y"])
            return ranks[self.k] + (ranks[self.upper] - ranks[self.k]) * self.frac
        # Too many values: the next sketch runs inside this bracket.
        self.ends, self.below, self.inside, self.margin = self.bracket, below, inside, min(self.margin, 0.01)
        return None

    def cuts(self) -> list[float]:
        place = (self.k - self.below) / max(1, self.inside)
        return [max(0.0, place - self.margin), min(1.0, place + self.margin + 2.0 / max(1, self.inside))]
