import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.functions import quantiles
from siltmark.functions.quantiles import column_quantiles, exact_quantiles

PROBS = [0.0, 0.1, 0.5, 0.77, 1.0]


def values(spark):
    """Group 0 is mostly one value, group 1 spread out with outliers, group NULL tiny."""
    g = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1)
    x = F.when((F.col("id") % 3 == 0) & (F.col("id") % 5 != 0), 7.0).otherwise((F.col("id") * 7919 % 3001) / 7.0)
    x = F.when(F.col("id") == 4, 1e300).otherwise(x)
    return spark.range(3000).select(g.alias("g"), F.when(F.col("id") % 11 != 0, x).alias("x"))


def want(df):
    pdf = df.toPandas()
    out = {}
    for g in (0, 1, None):
        part = pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g]
        part = part.x.dropna().to_numpy()
        for p in PROBS:
            out[g, p] = float(np.quantile(part, p))
    return out


@pytest.mark.parametrize("state_rows,accuracy", [(2_000_000, 20_000), (10, 20_000), (10, 40)])
def test_every_path_gives_the_exact_quantile(spark, state_rows, accuracy):
    df = values(spark)
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, "x", PROBS, ["g"], state_rows, accuracy).collect()}
    expected = want(df)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_full_order_path(spark):
    vals = values(spark).where("x is not null").select("g", F.col("x").alias("_v"))
    sized = vals.groupBy("g").agg(F.count("*").alias("n_rows"))
    got = {(r["g"], r["prob"]): r["quantile"] for r in quantiles._bracketed_whole(vals, sized, PROBS, ["g"]).collect()}
    for k, v in want(values(spark)).items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    for rows in (1000, 10):
        assert exact_quantiles(df, "x", [0.25], state_rows=rows).head()["quantile"] == 25.0


@pytest.mark.parametrize("accuracy, room", [(20_000, 4096), (100, 64)])
def test_columns_at_once(spark, accuracy, room):
    """Ties, gaps, an empty column and brackets that miss or hold too much, against sorted values."""
    i = F.col("id")
    df = spark.range(3000).select(
        (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7.0).alias("spread"), F.when(i % 3 == 0, 5.0).otherwise((i % 50).cast("double")).alias("tied"),
        F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, None).otherwise(-i / 3.0).alias("gaps"), F.lit(None).cast("double").alias("none"), F.lit(2.5).alias("one"),
    )
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    found, others = column_quantiles(df, df.columns, probs, [F.count("*").alias("rows")], accuracy, room)
    assert others == {"rows": 3000} and set(found["none"].values()) == {None}
    rows = df.collect()
    for c in ("spread", "tied", "gaps", "one"):
        values = sorted(r[c] for r in rows if r[c] is not None and not math.isnan(r[c]))
        for p in probs:
            k = int(p * (len(values) - 1))
            upper = values[min(k + 1, len(values) - 1)]
            assert found[c][p] == pytest.approx(values[k] + (upper - values[k]) * (p * (len(values) - 1) - k), abs=1e-12), (c, p)


def test_columns_do_not_fan_out(spark, capsys):
    """Rows are not multiplied by features before the aggregate."""
    from siltmark.operators.prepare import fit_medians

    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    assert fit_medians(df, ["a", "b"]) == {"a": 49.5, "b": 99.0}
    df.agg(F.percentile_approx("a", [0.5], 100), F.histogram_numeric("b", F.lit(10))).explain()
    assert "Generate" not in capsys.readouterr().out
