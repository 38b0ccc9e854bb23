"""The whole chain from CSV files, driven by an experiment grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.functions.hashing import content_key
from siltmark.functions.scratch import scratch_path
from siltmark.operators.admission import Policy
from siltmark.plans.inputs import FLOW_FEATURES, LINE_COLUMNS, SEED, SQL_LINE_KEY, sql_int, sql_key, sql_lowest, sql_proto, sql_score, sql_split, table
from siltmark.plans.pipeline import Setup, run_grid
from siltmark.plans.queries_metrics import SQL_NOV_COUNTS, sql_per_class
from siltmark.plans.registry import query, rounded
from siltmark.sources.grid import experiment_grid

TASKS = {1: [0, 1, 2], 2: [3, 4]}  # classes 5 and 6 stay novel
POLICY = Policy(min_confidence=None, distance_k=2.0, max_anomaly=None, radius_quantile=0.95)
TAU, CAP, THRESHOLD = 1.0, 50, 0.2505
RATES = ["0", "0.2"]
SCHEMA = "flow_id string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, kind string"


def raw_flows(spark, d) -> str:
    """Line items as CSV files with gaps, an infinite amount and lines that do not parse."""
    path = scratch_path(spark, "pipeline") + "/csv"
    quantity = F.when(F.col("l_partkey") % 89 == 0, F.lit("many")).otherwise(F.col("l_quantity").cast("string"))
    price = F.when(F.col("l_suppkey") % 53 == 0, F.lit("Infinity")).otherwise(F.col("l_extendedprice").cast("string"))
    out = table(spark, d, "lineitem").select(
        F.concat_ws("_", F.lit("flow"), "l_linenumber").alias("kind"), content_key(LINE_COLUMNS).alias(" flow_id"), quantity.alias("l_quantity"),
        price.alias(" l_extendedprice"), "l_discount", F.when(F.col("l_orderkey") % 97 != 0, F.col("l_tax")).alias("l_tax "), "l_shipdate",
    )
    out.write.option("header", True).csv(path)
    return path


def grid_of(spark, root, rates, strategies):
    return experiment_grid(spark, [SEED], rates, [THRESHOLD], strategies=strategies, caps=(CAP,), output=f"{root}/results")


def run_flows(spark, d, rates, strategies):
    root = scratch_path(spark, "pipeline")
    setup = Setup("lineitem", raw_flows(spark, d), SCHEMA, "flow_id", "kind", tuple(FLOW_FEATURES), TASKS, POLICY, TAU)
    return run_grid(spark, root, setup, grid_of(spark, root, rates, strategies))


_Z = ", ".join(f"((coalesce({c}, m_{c}) - a_{c}) / s_{c})::FLOAT::DOUBLE" for c in FLOW_FEATURES)
SQL_PREPARED = (
    f"raw AS (SELECT {SQL_LINE_KEY} AS row_id, CAST(l_linenumber - 1 AS INTEGER) AS label, l_quantity, l_discount, "
    "CASE WHEN l_suppkey % 53 <> 0 THEN l_extendedprice END AS l_extendedprice, CASE WHEN l_orderkey % 97 <> 0 THEN l_tax END AS l_tax FROM lineitem WHERE l_partkey % 89 <> 0), "
    f"side AS (SELECT *, {sql_split()} AS split FROM raw), "
    "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in FLOW_FEATURES) + " FROM side WHERE split = 'train'), "
    "st AS (SELECT " + ", ".join(f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in FLOW_FEATURES) + " FROM side CROSS JOIN med WHERE split = 'train'), "
    f"prep AS (SELECT row_id, label, split, [{_Z}] AS f, CASE WHEN label < 3 THEN 1 WHEN label < 5 THEN 2 END AS task_id FROM side CROSS JOIN med CROSS JOIN st), "
    "trusted AS (SELECT * FROM prep WHERE split = 'val' AND label < 5), "
    f"{sql_proto('tp', 'trusted')}, own AS (SELECT t.label, list_distance(t.f, p.c) AS dist FROM trusted t JOIN tp p ON t.label = p.class_id), "
    "dm AS (SELECT label, quantile_cont(dist, 0.5) AS m FROM own GROUP BY label), "
    f"lim AS (SELECT label, any_value(m) + {POLICY.distance_k} * 1.4826 * quantile_cont(abs(dist - m), 0.5) AS lim FROM own JOIN dm USING (label) GROUP BY label), "
    f"rad AS (SELECT label, quantile_cont(dist, {POLICY.radius_quantile}) AS radius FROM own GROUP BY label), "
    f"rk AS (SELECT *, row_number() OVER (ORDER BY {sql_key('flip')}, row_id) AS rn, count(*) OVER () AS n FROM prep WHERE split = 'train' AND label < 5)"
)
_METRICS = [
    "accuracy", "coverage", "macro_precision", "macro_recall", "macro_f1", "novelty_tpr", "novelty_fpr", "novelty_precision", "novelty_f1",
    "poison_admission_rate", "clean_rejection_rate", "detection_tpr", "detection_fpr", "average_forgetting", "old_class_retention", "new_class_score",
]


def _sql_run(i: int, rate: str) -> str:
    hit = f"rn <= floor({rate}::DECIMAL(10,6) * n)"
    share = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"
    values = [
        f"(SELECT avg((y = yhat)::INT::DOUBLE) FROM yy{i})", f"(SELECT avg((yhat <> -1)::INT::DOUBLE) FROM yy{i})",
        *[f"(SELECT avg({m}) FROM pc{i})" for m in ("precision", "recall", "f1")],
        *[f"(SELECT {share(a, b)} FROM nv{i})" for a, b in (("tp", "tp + fn"), ("fp", "fp + tn"), ("tp", "tp + fp"), ("2 * tp", "2 * tp + fp + fn"))],
        *[f"(SELECT {share(a, b)} FROM se{i})" for a, b in (("bad_in", "bad"), ("good_out", "good"), ("bad - bad_in", "bad"), ("good_held", "good"))],
        f"(SELECT score FROM m1{i}) - (SELECT score FROM m2{i} WHERE task_id = 1)", f"(SELECT score FROM m2{i} WHERE task_id = 1)", f"(SELECT score FROM m2{i} WHERE task_id = 2)",
    ]
    return (
        f"cand{i} AS (SELECT row_id, f, task_id, label AS truth, {hit} AS is_poisoned, CASE WHEN {hit} THEN CAST((label + 1 + {sql_int(sql_key('tgt'))} % 4) % 5 AS INTEGER) ELSE label END AS claimed FROM rk), "
        f"{sql_score(f'ad{i}', f'cand{i}', 'tp', TAU)}, far{i} AS (SELECT s.row_id, min(sqrt(s.d2) - r.radius) > 0 AS far_all FROM ad{i} s JOIN rad r ON s.class_id = r.label GROUP BY s.row_id), "
        f"dec{i} AS (SELECT b.row_id, b.f, b.task_id, b.claimed, b.is_poisoned, CASE WHEN far_all THEN 'quarantine' WHEN b.pred <> b.claimed OR sqrt(c.d2) > l.lim THEN 'reject' ELSE 'admit' END AS decision "
        f"FROM ad{i}_best b JOIN far{i} USING (row_id) JOIN ad{i} c ON c.row_id = b.row_id AND c.class_id = b.claimed JOIN lim l ON l.label = b.claimed), "
        f"se{i} AS (SELECT count(*) FILTER (WHERE is_poisoned) AS bad, count(*) FILTER (WHERE NOT is_poisoned) AS good, count(*) FILTER (WHERE is_poisoned AND decision = 'admit') AS bad_in, "
        f"count(*) FILTER (WHERE NOT is_poisoned AND decision = 'reject') AS good_out, count(*) FILTER (WHERE NOT is_poisoned AND decision <> 'admit') AS good_held FROM dec{i}), "
        f"ok{i} AS (SELECT row_id, f, task_id, claimed AS label FROM dec{i} WHERE decision = 'admit'), t1{i} AS (SELECT * FROM ok{i} WHERE task_id = 1), "
        f"t2{i} AS (SELECT * FROM ok{i} WHERE task_id = 2 UNION ALL SELECT * FROM {sql_lowest(f't1{i}', str(CAP), 'replay')}), "
        f"e1{i} AS (SELECT * FROM prep WHERE split = 'test' AND task_id = 1), e2{i} AS (SELECT *, task_id IS NULL AS is_novel FROM prep WHERE split = 'test'), "
        f"{sql_proto(f'p1{i}', f't1{i}')}, {sql_score(f's1{i}', f'e1{i}', f'p1{i}', TAU)}, m1{i} AS (SELECT avg((pred = label)::INT::DOUBLE) AS score FROM s1{i}_best), "
        f"{sql_proto(f'p2{i}', f't2{i}')}, {sql_score(f's2{i}', f'e2{i}', f'p2{i}', TAU)}, m2{i} AS (SELECT task_id, avg((pred = label)::INT::DOUBLE) AS score FROM s2{i}_best WHERE NOT is_novel GROUP BY task_id), "
        f"jd{i} AS (SELECT *, max_prob < {THRESHOLD} AS is_unknown, CASE WHEN max_prob < {THRESHOLD} THEN -1 ELSE pred END AS final_pred FROM s2{i}_best), "
        f"yy{i} AS (SELECT label AS y, final_pred AS yhat FROM jd{i} WHERE NOT is_novel), {sql_per_class(f'yy{i}', f'pc{i}')}, nv{i} AS (SELECT {SQL_NOV_COUNTS} FROM jd{i}), "
        f"out{i} AS (SELECT {i} AS run_id, unnest({_METRICS}) AS metric, unnest([{', '.join(values)}]) AS value)"
    )


@query(
    "q_pipeline",
    f"WITH {SQL_PREPARED}, " + ", ".join(_sql_run(i, r) for i, r in enumerate(RATES))
    + " SELECT run_id, metric, round(value, 6) + 0.0 AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM out{i}" for i in range(len(RATES))) + ")",
)
def q_pipeline(spark, d):
    """Two rows of a grid, clean and flipped labels, from CSV files to four families of metrics."""
    metrics, _ = run_flows(spark, d, RATES, ("replay",))
    return rounded(metrics, "value")


_N = "SELECT count(*) FROM lineitem WHERE l_partkey % 89"
_SQL_STAGES = {
    "bad_lines": f"({_N} = 0)", "rows": f"({_N} <> 0)", "checks": "23", "clean": f"({_N} <> 0)", "label_map": "7", "prepared": f"({_N} <> 0)", "tasked": f"({_N} <> 0)",
    "corrupted": "(SELECT count(*) FROM rk)", "decided": "(SELECT count(*) FROM rk)", "matrix": "3", "metrics": "16",
}


def _sql_reused(run: int, stage: str) -> bool:
    """Runs are (rate 0, finetune), (0.2, finetune), (0, replay), (0.2, replay)."""
    if stage in ("matrix", "metrics"):
        return False
    return run >= 2 if stage in ("corrupted", "decided") else run >= 1


@query(
    "q_pipeline_stages",
    f"WITH {SQL_PREPARED} " + " UNION ALL ".join(
        f"SELECT {run} AS run_id, '{stage}' AS stage, {_sql_reused(run, stage)} AS reused, CAST({n} AS BIGINT) AS n_rows" for run in range(4) for stage, n in _SQL_STAGES.items()
    ),
)
def q_pipeline_stages(spark, d):
    """Which stages the four runs of a grid built and which they took from a run before."""
    _, stages = run_flows(spark, d, RATES, ("finetune", "replay"))
    return stages.select("run_id", "stage", "reused", "n_rows")
