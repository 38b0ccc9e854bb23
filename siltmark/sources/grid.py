"""Experiment grids: one row per parameter combination."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

from siltmark.operators.split import fraction

SCHEMA = (
    "run_id int, seed int, model string, strategy string, replay_cap int, poison_rate decimal(10,6), "
    "threshold double, output string"
)


def experiment_grid(
    spark: SparkSession,
    seeds: list[int],
    rates: list,
    thresholds: list[float],
    models: tuple = ("prototype",),
    strategies: tuple = ("finetune", "replay"),
    caps: tuple = (50,),
    output: str = "results",
) -> DataFrame:
    combos = itertools.product(seeds, models, strategies, caps, [fraction(r) for r in rates], thresholds)
    rows = [(i, s, m, g, c, r, float(t), f"{output}/run_{i:05d}") for i, (s, m, g, c, r, t) in enumerate(combos)]
    return spark.createDataFrame(rows, SCHEMA)
