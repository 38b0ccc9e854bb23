"""Queries over tasks, replay, models and controlled corruption."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.corruption import apply_label_flip, apply_trigger, change_log, conditions, perturb_features, perturb_log
from siltmark.operators.ml import MLClassifier, score_with
from siltmark.operators.split import split
from siltmark.operators.tasks import (
    make_tasks, merge_buffer, poison_persistence, replay_buffer, task_classes_df, task_manifest, training_set,
)
from siltmark.plans.experiment import run_both, run_tasks
from siltmark.plans.inputs import (
    SEED, SQL_EVENTS, SQL_FLOWS, SQL_SIDED, TASKS, TAU, candidates, flows, sql_int, sql_key, sql_lowest,
    sql_proto, sql_score, sql_tasks, vectors,
)
from siltmark.plans.registry import query, r6, rounded
from siltmark.sources.tables import write_conditions


def sided(spark, d):
    return split(vectors(spark, d), SEED)


def tasked(spark, d, tasks=TASKS):
    return make_tasks(sided(spark, d), task_classes_df(spark, tasks))


def train_of(df):
    return df.where(F.col("split") == "train")


def test_of(df):
    return df.where(F.col("split") == "test")


SQL_TASKED = f"{SQL_SIDED}, {sql_tasks(TASKS)}, tasked AS (SELECT s.*, task_id FROM sided s JOIN task_classes t ON s.label = t.class_id)"

# Tasks and replay


@query("q_tasks", f"WITH {SQL_TASKED} SELECT row_id, label, split, task_id FROM tasked")
def q_tasks(spark, d):
    return tasked(spark, d)[0].select("row_id", "label", "split", "task_id")


@query("q_task_holdout", f"WITH {SQL_TASKED} SELECT row_id, label FROM sided WHERE label NOT IN (SELECT class_id FROM task_classes)")
def q_task_holdout(spark, d):
    return tasked(spark, d)[1].select("row_id", "label")


@query(
    "q_task_manifest",
    f"WITH {SQL_TASKED} SELECT task_id, split, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS classes, count(*) AS n_rows, {SEED} AS seed FROM tasked GROUP BY task_id, split",
)
def q_task_manifest(spark, d):
    m = task_manifest(tasked(spark, d)[0], SEED)
    return m.withColumn("classes", F.array_join(F.col("classes").cast("array<string>"), ","))


@query("q_replay", f"WITH {SQL_EVENTS} SELECT row_id, label, value FROM {sql_lowest('ev', '50', 'replay')}")
def q_replay(spark, d):
    return replay_buffer(candidates(spark, d), 50, SEED).select("row_id", "label", "value")


@query("q_replay_merge", f"WITH {SQL_EVENTS} SELECT row_id, label FROM {sql_lowest('ev', '80', 'replay')}")
def q_replay_merge(spark, d):
    """Three parts of the table merged one after the other, the second one twice."""
    rows = candidates(spark, d).select("row_id", "label")
    parts = [rows.where(F.col("row_id") % 3 == i) for i in range(3)]
    buffer = replay_buffer(parts[0], 80, SEED)
    for part in (parts[1], parts[2], parts[1]):
        buffer = merge_buffer(buffer, part, 80, SEED)
    return buffer.select("row_id", "label")


@query(
    "q_training_set",
    f"""WITH {SQL_TASKED}, past AS (SELECT * FROM tasked WHERE task_id < 3)
    SELECT row_id, label, task_id, 'current' AS origin FROM tasked WHERE task_id = 3
    UNION ALL SELECT row_id, label, task_id, 'replay' FROM {sql_lowest('past', '20', 'replay')}""",
)
def q_training_set(spark, d):
    return training_set(tasked(spark, d)[0], 3, "replay", 20, SEED).select("row_id", "label", "task_id", "origin")


def _sql_matrix_part(strategy: str, after: int) -> str:
    tag = f"{strategy[0]}{after}"
    source = "SELECT row_id, label, f FROM trn WHERE task_id = " + str(after)
    past = f"past{tag} AS (SELECT * FROM trn WHERE task_id < {after})"
    if strategy == "replay":
        source += f" UNION ALL SELECT row_id, label, f FROM {sql_lowest(f'past{tag}', '20', 'replay')}"
    return (
        f"{past}, fit{tag} AS ({source}), {sql_proto(f'pro{tag}', f'fit{tag}')}, "
        f"tst{tag} AS (SELECT * FROM tasked WHERE split = 'test' AND task_id <= {after}), "
        f"{sql_score(f'sc{tag}', f'tst{tag}', f'pro{tag}')}, "
        f"m{tag} AS (SELECT '{strategy}' AS strategy, {after} AS after_task, task_id AS eval_task, "
        f"avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0 END) AS score, count(*) AS n_rows FROM sc{tag}_best GROUP BY task_id)"
    )


SQL_MATRIX = (
    f"{SQL_TASKED}, trn AS (SELECT * FROM tasked WHERE split = 'train'), "
    + ", ".join(_sql_matrix_part(s, t) for s in ("finetune", "replay") for t in TASKS)
    + ", matrix AS ("
    + " UNION ALL ".join(f"SELECT * FROM m{s}{t}" for s in ("f", "r") for t in TASKS)
    + ")"
)


def matrix(spark, d):
    rows, _ = tasked(spark, d)
    return run_both(rows, sorted(TASKS), TAU, 20, SEED)


@query("q_task_matrix", f"WITH {SQL_MATRIX} SELECT strategy, after_task, eval_task, round(score, 6) AS score, n_rows FROM matrix")
def q_task_matrix(spark, d):
    return rounded(matrix(spark, d), "score")


SQL_FLIP_EMB = (
    f"{SQL_SIDED}, trn AS (SELECT * FROM sided WHERE split = 'train'), rk AS (SELECT *, row_number() OVER (ORDER BY {sql_key('flip')}, row_id) AS rn, "
    f"count(*) OVER () AS n FROM trn), flipped AS (SELECT * EXCLUDE (rn, n), rn <= floor(0.1::DECIMAL(10,6) * n) AS is_poisoned, "
    f"CASE WHEN rn <= floor(0.1::DECIMAL(10,6) * n) THEN CAST((label + 1 + {sql_int(sql_key('tgt'))} % 9) % 10 AS INTEGER) ELSE label END AS claimed FROM rk)"
)


def flipped_train(spark, d):
    """Training vectors with 10 % flipped labels; ``claimed`` is what an attacker submits."""
    return apply_label_flip(train_of(sided(spark, d)), "0.1", SEED)


@query(
    "q_poison_persistence",
    f"""WITH {SQL_FLIP_EMB}, v AS (SELECT 1 AS buffer_version, row_id, is_poisoned FROM {sql_lowest('flipped', '5', 'replay', 'claimed')}
    UNION ALL SELECT 2, row_id, is_poisoned FROM {sql_lowest('flipped', '20', 'replay', 'claimed')})
    SELECT buffer_version, count(*) AS n_rows, count(*) FILTER (WHERE is_poisoned) AS n_poisoned,
    round(avg(CASE WHEN is_poisoned THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM v GROUP BY buffer_version""",
)
def q_poison_persistence(spark, d):
    bad = flipped_train(spark, d)
    rows = bad.data.select("row_id", F.col("label_poisoned").alias("label"))
    versions = [replay_buffer(rows, cap, SEED).withColumn("buffer_version", F.lit(v)) for v, cap in ((1, 5), (2, 20))]
    return rounded(poison_persistence(versions[0].unionByName(versions[1]), bad.log), "share")


# Models

SQL_FITTED = f"{SQL_SIDED}, trn AS (SELECT * FROM sided WHERE split = 'train'), tst AS (SELECT * FROM sided WHERE split = 'test'), {sql_proto('proto', 'trn')}"
SQL_SCORED = f"{SQL_FITTED}, {sql_score('sc', 'tst', 'proto')}"


def fitted(spark, d):
    return PrototypeClassifier(tau=TAU).fit(train_of(sided(spark, d)))


@query(
    "q_prototypes",
    f"WITH {SQL_FITTED} SELECT class_id, n AS n_rows, pos - 1 AS pos, round(c[pos], 6) + 0.0 AS mean FROM proto, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS pos)",
)
def q_prototypes(spark, d):
    return rounded(fitted(spark, d).to_df(spark).select("class_id", "n_rows", "pos", "mean"), "mean")


def _sql_flow_proto() -> str:
    return " UNION ALL ".join(
        f"SELECT label, '{c}' AS feature, count(*) AS n_rows, round(avg({c}), 6) AS mean FROM flows GROUP BY label" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )


@query("q_prototypes_flows", f"WITH {SQL_FLOWS} {_sql_flow_proto()}")
def q_prototypes_flows(spark, d):
    """Prototypes over scalar columns: one codegen aggregate, no vector is built."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = flows(spark, d)
    model = PrototypeClassifier(names, "label").fit(rows)
    out = [(c, names[i], s[0], float(v)) for c, s in model.stats.items() for i, v in enumerate(model.centres[model.class_ids.index(c)])]
    return rounded(spark.createDataFrame(out, "label string, feature string, n_rows bigint, mean double"), "mean")


def long_probs(scored, model):
    pairs = F.arrays_zip(model.ids_column().alias("class_id"), F.col("probs").alias("prob"))
    return scored.select("row_id", F.inline(pairs)).select("row_id", "class_id", r6("prob").alias("prob"))


@query("q_proba", f"WITH {SQL_SCORED} SELECT row_id, class_id, round(prob, 6) AS prob FROM sc")
def q_proba(spark, d):
    model = fitted(spark, d)
    return long_probs(model.predict_proba(test_of(sided(spark, d))), model)


@query("q_predict", f"WITH {SQL_SCORED} SELECT row_id, label, pred, round(max_prob, 6) AS max_prob, round(pred_d2, 6) AS pred_d2 FROM sc_best")
def q_predict(spark, d):
    scored = fitted(spark, d).predict(test_of(sided(spark, d)))
    return rounded(scored.select("row_id", "label", "pred", "max_prob", "pred_d2"), "max_prob", "pred_d2")


@query("q_model_reload", f"WITH {SQL_SCORED} SELECT row_id, pred FROM sc_best")
def q_model_reload(spark, d):
    """Saved and loaded model, itself merged from the models of two disjoint halves."""
    rows = train_of(sided(spark, d))
    halves = [PrototypeClassifier(tau=TAU).fit(rows.where(F.col("row_id") % 2 == i)) for i in (0, 1)]
    path = scratch_path(spark, "model")
    halves[0].merge(halves[1]).save(spark, path)
    return PrototypeClassifier.load(spark, path).predict(test_of(sided(spark, d))).select("row_id", "pred")


@query("q_batch_inference", f"WITH {SQL_SCORED} SELECT row_id, class_id, round(prob, 6) AS prob FROM sc")
def q_batch_inference(spark, d):
    """A user-supplied network; here one linear layer that equals the prototype softmax."""
    model = fitted(spark, d)
    centres, tau = np.asarray(model.centres), TAU

    def load():
        w, b = 2.0 * centres.T / tau, -(centres**2).sum(axis=1) / tau

        def predict(batch):
            z = batch.astype(np.float64) @ w + b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    scored = score_with(load, test_of(sided(spark, d)), width=centres.shape[1])
    return long_probs(scored, model)


@query("q_ml_predict")
def q_ml_predict(spark, d):
    rows = sided(spark, d)
    model = MLClassifier("logreg", max_iter=10).fit(train_of(rows))
    return model.predict(test_of(rows)).select("row_id", "label", "pred", "max_prob")


@query("q_history")
def q_history(spark, d):
    return MLClassifier("mlp", hidden=(8,), max_iter=10, seed=SEED).fit(train_of(sided(spark, d))).history(spark)


@query("q_ml_update")
def q_ml_update(spark, d):
    """Warm start: fitted on task 1, then updated on task 2 with replay; losses of both."""
    rows, _ = tasked(spark, d)
    rows = train_of(rows)
    first = MLClassifier("mlp", class_ids=list(range(8)), hidden=(8,), max_iter=10, seed=SEED).fit(rows.where(F.col("task_id") == 1))
    second = first.update(training_set(rows, 2, "replay", 20, SEED))
    parts = [m.history(spark).withColumn("task_id", F.lit(t)) for t, m in ((1, first), (2, second))]
    return parts[0].unionByName(parts[1])


@query("q_ml_validated", f"WITH {SQL_SIDED} SELECT row_id, label, TRUE AS known, TRUE AS sound, TRUE AS lowest FROM sided WHERE split = 'test'")
def q_ml_validated(spark, d):
    """A perceptron that stops by validation rows; what the contract promises of every row, and that
    the model kept has the lowest validation loss measured."""
    rows = sided(spark, d)
    val = rows.where(F.col("split") == "val")
    model = MLClassifier("mlp", hidden=(8,), max_iter=20, seed=SEED).fit(train_of(rows), val)
    lowest = abs(model.validation_loss(val) - min(model.val_losses)) < 1e-9
    known = F.col("pred").isin(model.class_ids).alias("known")
    sound = F.col("max_prob").between(1.0 / len(model.class_ids), 1.0).alias("sound")
    return model.predict(test_of(rows)).select("row_id", "label", known, sound, F.lit(lowest).alias("lowest"))


@query(
    "q_task_matrix_ml",
    f"WITH {SQL_TASKED} SELECT s.strategy, a.task_id AS after_task, t.task_id AS eval_task, count(*) AS n_rows, TRUE AS sound FROM tasked t "
    "JOIN (SELECT DISTINCT task_id FROM task_classes) a ON t.task_id <= a.task_id CROSS JOIN (VALUES ('finetune'), ('replay')) AS s(strategy) "
    "WHERE t.split = 'test' GROUP BY ALL",
)
def q_task_matrix_ml(spark, d):
    """Perceptrons carried from task to task, each fit stopped by the validation rows so far."""
    rows, _ = tasked(spark, d)
    classes = sorted(c for cs in TASKS.values() for c in cs)
    make = lambda: MLClassifier("mlp", class_ids=classes, hidden=(8,), max_iter=10, seed=SEED)
    parts = [run_tasks(rows, sorted(TASKS), s, make, 20, SEED, validate=True) for s in ("finetune", "replay")]
    sound = F.col("score").between(0.0, 1.0).alias("sound")
    return parts[0].unionByName(parts[1]).select("strategy", "after_task", "eval_task", "n_rows", sound)


# Corruption

_FLIP_RATE = "0.05"
SQL_FLIP = (
    f"{SQL_EVENTS}, names AS (SELECT list(label ORDER BY label) AS a FROM (SELECT DISTINCT label FROM ev)), "
    f"rk AS (SELECT *, row_number() OVER (ORDER BY {sql_key('flip')}, row_id) AS rn, count(*) OVER () AS n FROM ev), "
    f"tg AS (SELECT rk.*, a[((list_position(a, label) - 1 + 1 + {sql_int(sql_key('tgt'))} % (len(a) - 1)) % len(a)) + 1] AS target FROM rk CROSS JOIN names)"
)


def _sql_flip_at(rate: str) -> str:
    hit = f"rn <= floor({rate}::DECIMAL(10,6) * n)"
    return f"SELECT row_id, label, CASE WHEN {hit} THEN target ELSE label END AS label_poisoned, {hit} AS is_poisoned FROM tg"


@query("q_label_flip", f"WITH {SQL_FLIP} {_sql_flip_at(_FLIP_RATE)}")
def q_label_flip(spark, d):
    return apply_label_flip(candidates(spark, d), _FLIP_RATE, SEED).data.select("row_id", "label", "label_poisoned", "is_poisoned")


@query(
    "q_flip_log",
    f"WITH {SQL_FLIP}, fl AS ({_sql_flip_at(_FLIP_RATE)}) SELECT row_id, 'label_flip' AS kind, label AS original, label_poisoned AS changed, {SEED} AS seed FROM fl WHERE is_poisoned",
)
def q_flip_log(spark, d):
    return apply_label_flip(candidates(spark, d), _FLIP_RATE, SEED).log


_ALLOWED = ["click", "error", "view"]


@query(
    "q_flip_summary",
    f"""WITH {SQL_EVENTS}, s AS (SELECT count(*) FILTER (WHERE label IN ('click', 'error', 'view')) AS e, count(*) AS t FROM ev),
    c AS (SELECT *, CAST(floor(0.29::DECIMAL(10,6) * e) AS BIGINT) AS k FROM s)
    SELECT 0.29::DECIMAL(10,6) AS requested, CAST(round(k::DOUBLE / e, 6) AS DECIMAL(10,6)) AS achieved, CAST(round(k::DOUBLE / t, 6) AS DECIMAL(10,6)) AS achieved_all,
    k AS changed, e AS eligible, t AS total, {SEED} AS seed FROM c""",
)
def q_flip_summary(spark, d):
    return apply_label_flip(candidates(spark, d), "0.29", SEED, _ALLOWED).summary


_RATES = ["0", "0.05", "0.1", "0.29"]


@query(
    "q_flip_conditions",
    f"WITH {SQL_FLIP} "
    + " UNION ALL ".join(
        f"SELECT {r}::DECIMAL(10,6) AS rate, '{'clean' if r == '0' else 'flip_' + r}' AS condition, row_id, label_poisoned, is_poisoned FROM ({_sql_flip_at(r)})" for r in _RATES
    ),
)
def q_flip_conditions(spark, d):
    return conditions(candidates(spark, d), _RATES, SEED).select("rate", "condition", "row_id", "label_poisoned", "is_poisoned")


@query(
    "q_condition_outputs",
    f"WITH {SQL_FLIP} "
    + " UNION ALL ".join(
        f"SELECT '{'clean' if r == '0' else 'flip_' + r}' AS condition, count(*) AS n_rows, count(*) FILTER (WHERE is_poisoned) AS n_poisoned FROM ({_sql_flip_at(r)})" for r in _RATES
    ),
)
def q_condition_outputs(spark, d):
    """Clean and corrupted tables written apart, then read back."""
    path = write_conditions(conditions(candidates(spark, d), _RATES, SEED), scratch_path(spark, "conditions"))
    back = spark.read.parquet(path)
    return back.groupBy("condition").agg(F.count("*").alias("n_rows"), F.count_if("is_poisoned").alias("n_poisoned"))


def _sql_offset(c: str) -> str:
    return f"({sql_int(sql_key('perturb:' + c))} / 4294967296.0::DOUBLE * 2 - 1) * 0.5 * (SELECT stddev_pop({c}) FROM rk)"


@query(
    "q_perturb",
    f"""WITH {SQL_FLOWS}, rk AS (SELECT *, row_number() OVER (ORDER BY {sql_key('perturb')}, row_id) AS rn, count(*) OVER () AS n FROM flows)
    SELECT row_id, rn <= floor(0.02::DECIMAL(10,6) * n) AS is_poisoned,
    round(CASE WHEN rn <= floor(0.02::DECIMAL(10,6) * n) THEN greatest(1.0, least(50.0, l_quantity + {_sql_offset('l_quantity')})) ELSE l_quantity END, 6) AS l_quantity_poisoned,
    round(CASE WHEN rn <= floor(0.02::DECIMAL(10,6) * n) THEN l_extendedprice + {_sql_offset('l_extendedprice')} ELSE l_extendedprice END, 6) AS l_extendedprice_poisoned FROM rk""",
)
def q_perturb(spark, d):
    rows = flows(spark, d)
    cols = ["l_quantity", "l_extendedprice"]
    std = rows.agg(*[F.stddev_pop(c).alias(c) for c in cols]).head().asDict()
    out = perturb_features(rows, cols, "0.02", 0.5, SEED, std, bounds={"l_quantity": (1.0, 50.0)})
    return rounded(out.select("row_id", "is_poisoned", "l_quantity_poisoned", "l_extendedprice_poisoned"), "l_quantity_poisoned", "l_extendedprice_poisoned")


@query(
    "q_perturb_log",
    f"""WITH {SQL_FLOWS}, rk AS (SELECT *, row_number() OVER (ORDER BY {sql_key('perturb')}, row_id) AS rn, count(*) OVER () AS n FROM flows),
    p AS (SELECT * FROM rk WHERE rn <= floor(0.02::DECIMAL(10,6) * n)),
    m AS (SELECT row_id, 'l_quantity' AS field, l_quantity AS o, greatest(1.0, least(50.0, l_quantity + {_sql_offset('l_quantity')})) AS c FROM p
    UNION ALL SELECT row_id, 'l_extendedprice', l_extendedprice, l_extendedprice + {_sql_offset('l_extendedprice')} FROM p)
    SELECT row_id, 'perturb' AS kind, field, round(o, 6) AS original, round(c, 6) AS changed, {SEED} AS seed FROM m WHERE o <> c""",
)
def q_perturb_log(spark, d):
    rows = flows(spark, d)
    cols = ["l_quantity", "l_extendedprice"]
    std = rows.agg(*[F.stddev_pop(c).alias(c) for c in cols]).head().asDict()
    log = perturb_log(rows, cols, "0.02", 0.5, SEED, std, bounds={"l_quantity": (1.0, 50.0)})
    return rounded(log.withColumns({c: F.col(c).cast("double") for c in ("original", "changed")}), "original", "changed")


@query(
    "q_trigger_log",
    f"""WITH {SQL_EVENTS}, b AS (SELECT *, label <> 'purchase' AS el FROM ev),
    rk AS (SELECT *, el AND row_number() OVER (PARTITION BY el ORDER BY {sql_key('trigger')}, row_id) <= floor(0.1::DECIMAL(10,6) * count(*) OVER (PARTITION BY el)) AS hit FROM b)
    SELECT row_id, 'trigger' AS kind, field, changed FROM (SELECT row_id, 'value' AS field, '99.5' AS changed FROM rk WHERE hit AND value <> 99.5
    UNION ALL SELECT row_id, 'label', 'purchase' FROM rk WHERE hit)""",
)
def q_trigger_log(spark, d):
    out = apply_trigger(candidates(spark, d), {"value": 99.5}, "purchase", "0.1", SEED)
    return change_log(out, "trigger", SEED).select("row_id", "kind", "field", "changed")


@query(
    "q_trigger",
    f"""WITH {SQL_EVENTS}, b AS (SELECT *, label <> 'purchase' AND ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM ev) AND (SELECT min(ts) + INTERVAL 4 DAY FROM ev) AS el FROM ev),
    rk AS (SELECT *, el AND row_number() OVER (PARTITION BY el ORDER BY {sql_key('trigger')}, row_id) <= floor(0.1::DECIMAL(10,6) * count(*) OVER (PARTITION BY el)) AS is_poisoned FROM b)
    SELECT row_id, is_poisoned, CASE WHEN is_poisoned THEN 99.5 ELSE value END AS value_poisoned, CASE WHEN is_poisoned THEN 'purchase' ELSE label END AS label_poisoned FROM rk""",
)
def q_trigger(spark, d):
    """Backdoor in a time range: a fixed value pattern labelled as purchase."""
    rows = candidates(spark, d)
    start = F.min("ts")
    lo, hi = rows.agg(*[(start + F.expr(f"interval {n} day")).cast("string") for n in (1, 4)]).head()
    out = apply_trigger(rows, {"value": 99.5}, "purchase", "0.1", SEED, time_range=("ts", lo, hi))
    return out.select("row_id", "is_poisoned", "value_poisoned", "label_poisoned")
