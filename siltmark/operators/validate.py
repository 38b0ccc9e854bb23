"""Constraint checks and data audit."""

from __future__ import annotations

from decimal import Decimal

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.quantiles import column_quantiles
from siltmark.functions.sizing import small_side


@dataclass(frozen=True)
class Rule:
    """``kind`` is one of missing, type, null, non_finite, unknown_label."""

    kind: str
    column: str
    expected: object = field(default=None, hash=False)


def rules_for(schema: T.StructType, features: list[str], label: str, classes: list) -> list[Rule]:
    """The standard rule set: every declared field present, typed and non-null; features
    finite; labels from the known classes."""
    rules = []
    for f in schema.fields:
        rules += [Rule("missing", f.name), Rule("type", f.name, f.dataType.simpleString()), Rule("null", f.name)]
    rules += [Rule("non_finite", c) for c in features]
    return rules + [Rule("unknown_label", label, tuple(classes))]


def non_finite(col: Column) -> Column:
    d = col.cast("double")
    return F.isnan(d) | (F.abs(d) == F.lit(float("inf")))


def _broken(df: DataFrame, rule: Rule) -> Column | None:
    """Row predicate of a rule, TRUE on a violation; None when it needs no data."""
    present = rule.column in df.columns
    if rule.kind == "missing":
        return None if present else F.lit(True)
    if not present:
        return None
    col = F.col(rule.column)
    if rule.kind == "type":
        return None if df.schema[rule.column].dataType.simpleString() == rule.expected else F.lit(True)
    if rule.kind == "null":
        return col.isNull()
    if rule.kind == "non_finite":
        return F.coalesce(non_finite(col), F.lit(False))
    if rule.kind == "unknown_label":
        return col.isNotNull() & ~col.isin(list(rule.expected))
    raise ValueError(f"unknown rule kind {rule.kind}")


def violations(df: DataFrame, rules: list[Rule], row_id: str = "row_id") -> DataFrame:
    """One row per (row, broken rule): ``row_id, kind, column``. One narrow pass."""
    checks = [(r, _broken(df, r)) for r in rules if r.kind not in ("missing", "type")]
    marks = [
        F.when(cond, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column")))
        for r, cond in checks
        if cond is not None
    ]
    if not marks:
        return df.select(row_id, F.lit("").alias("kind"), F.lit("").alias("column")).where(F.lit(False))
    hits = F.explode(F.array_compact(F.array(*marks)))
    return df.select(F.col(row_id).alias("row_id"), hits.alias("_v")).select("row_id", "_v.kind", "_v.column")


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violation counts per rule, zeros included: ``kind, column, violations, n_rows``.

    All rules share one aggregate pass; schema rules count as every row or none.
    """
    counts, n = [], F.count(F.lit(1))
    for i, r in enumerate(rules):
        cond = _broken(df, r)
        counts.append((F.lit(0).cast("bigint") if cond is None else F.count_if(cond)).alias(f"v{i}"))
    one = df.agg(n.alias("n_rows"), *counts)
    items = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), F.col(f"v{i}").alias("violations"))
        for i, r in enumerate(rules)
    ]
    return one.select("n_rows", F.explode(F.array(*items)).alias("_r")).select("_r.*", "n_rows")


def audit_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per class. The total is summed from the grouped table."""
    per = small_side(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows")))
    total = per.agg(F.sum("n_rows").alias("n")).head()["n"] or 0
    return per.select("label", "n_rows", (F.col("n_rows") / F.lit(float(max(total, 1)))).alias("share"))


def audit_rollup(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Counts per class and split with subtotals; ``level`` 0 detail, 1 class, 3 all rows."""
    return df.rollup(F.col(label).alias("label"), F.col(split).alias("split")).agg(
        F.count("*").alias("n_rows"), F.grouping_id().cast("int").alias("level")
    )


def percent_name(p: float) -> str:
    """``p50`` for 0.5, ``p50_5`` for 0.505: exact in the decimals given."""
    return "p" + f"{(Decimal(str(p)) * 100).normalize():f}".replace(".", "_")


def audit_features(df: DataFrame, features: list[str], probs: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per feature: nulls, non-finite values, min, max, mean, deviation and quantiles.

    Statistics and quantile sketches come from one aggregate over finite values; a second scan
    makes the quantiles exact at any size (see ``column_quantiles``).
    """
    finite = {c: f"_f_{c}" for c in features}
    rows = df.select(*features, *[F.when(~non_finite(F.col(c)), F.col(c).cast("double")).alias(f) for c, f in finite.items()])
    others = []
    for i, (c, f) in enumerate(finite.items()):
        others += [F.count_if(F.col(c).isNull()).alias(f"null_{i}"), F.count_if(non_finite(F.col(c))).alias(f"bad_{i}"), F.count(f).alias(f"count_{i}")]
        others += [F.min(f).alias(f"min_{i}"), F.max(f).alias(f"max_{i}"), F.avg(f).alias(f"avg_{i}"), F.stddev_pop(f).alias(f"std_{i}")]
    quantiles, stats = column_quantiles(rows, list(finite.values()), [float(p) for p in probs], others)
    table = [
        (c, *(stats[f"{s}_{i}"] for s in ("null", "bad", "count", "min", "max", "avg", "std")), *(quantiles[f][float(p)] for p in probs)) for i, (c, f) in enumerate(finite.items())
    ]
    fields = "feature string, n_null bigint, n_non_finite bigint, n_finite bigint, min double, max double, mean double, std double"
    return df.sparkSession.createDataFrame(table, ", ".join([fields, *[f"{percent_name(p)} double" for p in probs]]))
