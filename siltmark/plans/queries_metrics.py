"""Queries over novelty, evaluation and admission."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.operators.admission import (
    Defence, Policy, admit, admit_each, anomaly_score, audit_buffer, confidence_signal, label_consistency,
    robust_distance, secure_replay,
)
from siltmark.operators.classifier import PrototypeClassifier
from siltmark.operators.corruption import apply_trigger
from siltmark.operators.evaluate import (
    across_seeds, attack_success, classification_metrics, compare_conditions, confusion, confusion_wide, continual_metrics,
    efficiency, forgetting, metrics_json, new_class_metrics, novelty_metrics, per_class, security_metrics, to_long, tradeoff,
)
from siltmark.operators.neighbours import knn_consistency, nearest_rows
from siltmark.operators.novelty import (
    calibrate, class_radii, detect_far, detect_unknown, detect_unknown_by_class, label_unknown, quarantine, release, threshold_sweep,
)
from siltmark.operators.prepare import Scaler
from siltmark.operators.split import split
from siltmark.operators.tasks import poison_persistence, replay_buffer
from siltmark.plans.experiment import Params, manifest_fields, run_buffers, run_conditions
from siltmark.plans.inputs import (
    SEED, SQL_EMB, SQL_SIDED, TAU, TWO_TASKS, sql_int, sql_key, sql_lowest, sql_proto, sql_score, sql_split, vectors,
)
from siltmark.plans.queries_tasks import (
    SQL_FLIP_EMB, SQL_FITTED, SQL_MATRIX, fitted, flipped_train, matrix, sided, test_of, train_of,
)
from siltmark.plans.registry import query, rounded
from siltmark.sources.tables import append_quarantine, summary_table, write_manifest

THRESHOLD = 0.1523
KNOWN = [c for cs in TWO_TASKS.values() for c in cs]  # classes 8 and 9 stay novel

# The model knows eight classes and is asked about all ten.
SQL_NOVEL = (
    f"{SQL_SIDED}, trn AS (SELECT * FROM sided WHERE split = 'train' AND label < 8), tst AS (SELECT *, label >= 8 AS is_novel FROM sided WHERE split = 'test'), "
    f"{sql_proto('proto', 'trn')}, {sql_score('sc', 'tst', 'proto')}, "
    f"judged AS (SELECT *, max_prob < {THRESHOLD} AS is_unknown, CASE WHEN max_prob < {THRESHOLD} THEN -1 ELSE pred END AS final_pred FROM sc_best)"
)


def known_model(spark, d):
    return PrototypeClassifier(tau=TAU).fit(train_of(sided(spark, d)).where(F.col("label").isin(KNOWN)))


def judged(spark, d):
    scored = known_model(spark, d).predict(test_of(sided(spark, d)))
    return label_unknown(detect_unknown(scored, THRESHOLD)).withColumn("is_novel", ~F.col("label").isin(KNOWN))


# Novelty


@query("q_unknown", f"WITH {SQL_NOVEL} SELECT row_id, is_unknown FROM judged")
def q_unknown(spark, d):
    return judged(spark, d).select("row_id", "is_unknown")


@query("q_unknown_labels", f"WITH {SQL_NOVEL} SELECT row_id, label, final_pred FROM judged")
def q_unknown_labels(spark, d):
    return judged(spark, d).select("row_id", "label", "final_pred")


@query(
    "q_holes",
    f"WITH {SQL_NOVEL} SELECT row_id, CASE WHEN row_id % 7 < 4 THEN TRUE ELSE is_unknown END AS is_unknown, "
    "CASE WHEN row_id % 7 < 4 THEN -1 ELSE final_pred END AS final_pred, row_id % 7 >= 4 AS scored FROM judged",
)
def q_holes(spark, d):
    """Test vectors with holes punched by id: missing, NaN, infinite, and a missing element."""
    kind = F.col("row_id") % 7
    put = lambda v: F.transform("features", lambda x, i: F.when(i == 3, F.lit(v).cast("float")).otherwise(x))
    holed = F.when(kind == 0, F.lit(None)).when(kind == 1, put(float("nan"))).when(kind == 2, put(float("-inf"))).when(kind == 3, put(None)).otherwise(F.col("features"))
    scored = known_model(spark, d).predict(test_of(sided(spark, d)).withColumn("features", holed))
    return label_unknown(detect_unknown(scored, THRESHOLD)).select("row_id", "is_unknown", "final_pred", F.col("probs").isNotNull().alias("scored"))


_STEPS = [0.1253, 0.1403, 0.1523, 0.1707, 0.2103, 0.9]


@query(
    "q_threshold_sweep",
    f"""WITH {SQL_NOVEL}, t AS (SELECT unnest({_STEPS})::DOUBLE AS threshold)
    SELECT threshold, count(*) FILTER (WHERE is_novel AND max_prob < threshold) AS tp, count(*) FILTER (WHERE NOT is_novel AND max_prob < threshold) AS fp,
    count(*) FILTER (WHERE is_novel AND max_prob >= threshold) AS fn, count(*) FILTER (WHERE NOT is_novel AND max_prob >= threshold) AS tn FROM judged CROSS JOIN t GROUP BY threshold""",
)
def q_threshold_sweep(spark, d):
    return threshold_sweep(judged(spark, d), _STEPS)


_RADIUS_Q = 0.6
SQL_FAR = (
    f"{SQL_NOVEL}, own AS (SELECT t.label, list_distance(t.f, p.c) AS dist FROM trn t JOIN proto p ON t.label = p.class_id), "
    f"radii AS (SELECT label, quantile_cont(dist, {_RADIUS_Q}) AS radius FROM own GROUP BY label), "
    f"far AS (SELECT b.row_id, sqrt(min(s.d2)) AS nearest_dist, max(CASE WHEN s.class_id = b.pred THEN sqrt(s.d2) - r.radius END) > 0 AS is_far, "
    f"min(sqrt(s.d2) - r.radius) > 0 AS is_far_from_all FROM sc s JOIN radii r ON s.class_id = r.label JOIN judged b USING (row_id) GROUP BY b.row_id)"
)


@query("q_far", f"WITH {SQL_FAR} SELECT row_id, round(nearest_dist, 6) AS nearest_dist, is_far, is_far_from_all FROM far")
def q_far(spark, d):
    model = known_model(spark, d)
    rows = sided(spark, d)
    radii = class_radii(train_of(rows).where(F.col("label").isin(KNOWN)), model, _RADIUS_Q)
    scored = detect_far(model.predict(test_of(rows)), model, radii)
    return rounded(scored.select("row_id", "nearest_dist", "is_far", "is_far_from_all"), "nearest_dist")


# Evaluation


@query("q_confusion", f"WITH {SQL_NOVEL} SELECT label AS y, final_pred AS yhat, count(*) AS n FROM judged GROUP BY label, final_pred")
def q_confusion(spark, d):
    return confusion(judged(spark, d), "label", "final_pred")


@query(
    "q_confusion_wide",
    f"WITH {SQL_NOVEL} SELECT label AS y, "
    + ", ".join(f"count(*) FILTER (WHERE final_pred = {c}) AS pred_{c}" for c in KNOWN)
    + ", count(*) FILTER (WHERE final_pred = -1) AS pred_unknown FROM judged GROUP BY label",
)
def q_confusion_wide(spark, d):
    return confusion_wide(confusion(judged(spark, d), "label", "final_pred"), KNOWN)


def sql_per_class(source: str, name: str = "pc") -> str:
    """CTE ``name`` from rows (y, yhat) in ``source``."""
    return (
        f"{name}_ids AS (SELECT DISTINCT y AS class_id FROM {source} UNION SELECT DISTINCT yhat FROM {source} WHERE yhat <> -1), "
        f"{name}_raw AS (SELECT class_id, (SELECT count(*) FROM {source} WHERE y = class_id AND yhat = class_id) AS tp, "
        f"(SELECT count(*) FROM {source} WHERE y = class_id) AS support, (SELECT count(*) FROM {source} WHERE yhat = class_id) AS predicted FROM {name}_ids), "
        f"{name} AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / predicted END AS precision, "
        f"CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / support END AS recall, "
        f"CASE WHEN support + predicted = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (support + predicted) END AS f1 FROM {name}_raw)"
    )


SQL_PER_CLASS = f"{SQL_NOVEL}, yy AS (SELECT label AS y, final_pred AS yhat FROM judged), {sql_per_class('yy')}"


@query("q_per_class", f"WITH {SQL_PER_CLASS} SELECT class_id, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc")
def q_per_class(spark, d):
    return rounded(per_class(confusion(judged(spark, d), "label", "final_pred")), "precision", "recall", "f1").withColumn("tp", F.col("tp").cast("bigint"))


@query(
    "q_classification",
    f"""WITH {SQL_PER_CLASS} SELECT (SELECT round(avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0 END), 6) FROM yy) AS accuracy,
    (SELECT round(count(*) FILTER (WHERE y = yhat)::DOUBLE / greatest(1, count(*) FILTER (WHERE yhat <> -1)), 6) FROM yy) AS accuracy_covered,
    (SELECT round(avg(CASE WHEN yhat <> -1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) FROM yy) AS coverage,
    round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, (SELECT count(*) FROM yy) AS n_rows FROM pc""",
)
def q_classification(spark, d):
    out = classification_metrics(judged(spark, d), "label", "final_pred")
    return rounded(out, "accuracy", "accuracy_covered", "coverage", "macro_precision", "macro_recall", "macro_f1")


@query(
    "q_continual",
    f"""WITH {SQL_MATRIX}, c AS (SELECT strategy, max(CASE WHEN after_task = 1 AND eval_task = 1 THEN score END) AS task1_before,
    max(CASE WHEN after_task = 2 AND eval_task = 1 THEN score END) AS task1_after, max(CASE WHEN after_task = 2 AND eval_task = 2 THEN score END) AS task2_score
    FROM matrix GROUP BY strategy)
    SELECT strategy, round(task1_before, 6) AS task1_before, round(task1_after, 6) AS task1_after, round(task2_score, 6) AS task2_score,
    round(task1_before - task1_after, 6) + 0.0 AS forgetting FROM c""",
)
def q_continual(spark, d):
    return rounded(continual_metrics(matrix(spark, d)), "task1_before", "task1_after", "task2_score", "forgetting")


@query(
    "q_forgetting",
    f"""WITH {SQL_MATRIX}, l AS (SELECT *, (SELECT max(m.score) FROM matrix m WHERE m.strategy = x.strategy AND m.eval_task = x.eval_task AND m.after_task < 3) AS best
    FROM matrix x WHERE after_task = 3)
    SELECT strategy, 3 AS n_tasks, round(avg(best - score) FILTER (WHERE eval_task < 3), 6) + 0.0 AS average_forgetting,
    round(avg(score) FILTER (WHERE eval_task < 3), 6) AS old_class_retention, round(max(score) FILTER (WHERE eval_task = 3), 6) AS new_class_score FROM l GROUP BY strategy""",
)
def q_forgetting(spark, d):
    return rounded(forgetting(matrix(spark, d)), "average_forgetting", "old_class_retention", "new_class_score")


def _div(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END, 6)"


SQL_NOV_COUNTS = (
    "count(*) FILTER (WHERE is_novel AND is_unknown) AS tp, count(*) FILTER (WHERE NOT is_novel AND is_unknown) AS fp, "
    "count(*) FILTER (WHERE is_novel AND NOT is_unknown) AS fn, count(*) FILTER (WHERE NOT is_novel AND NOT is_unknown) AS tn"
)


@query(
    "q_novelty",
    f"WITH {SQL_NOVEL}, n AS (SELECT {SQL_NOV_COUNTS} FROM judged) SELECT tp, fp, fn, tn, {_div('tp', '(tp + fn)')} AS tpr, {_div('fp', '(fp + tn)')} AS fpr, "
    f"{_div('tp', '(tp + fp)')} AS precision, {_div('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM n",
)
def q_novelty(spark, d):
    return rounded(novelty_metrics(judged(spark, d)), "tpr", "fpr", "precision", "f1")


# Clean against corrupted training: all flip rates, one fit scan, one scoring scan

RATES = ["0", "0.1", "0.3"]
EXPERIMENT_THRESHOLD = 0.1523


def _sql_condition(i: int, rate: str) -> str:
    hit = f"rn <= floor({rate}::DECIMAL(10,6) * n)"
    rows = f"fit{i} AS (SELECT row_id, f, CASE WHEN {hit} THEN CAST((label + 1 + {sql_int(sql_key('tgt'))} % 7) % 8 AS INTEGER) ELSE label END AS label FROM rk)"
    counts = SQL_NOV_COUNTS
    return (
        f"{rows}, {sql_proto(f'pro{i}', f'fit{i}')}, {sql_score(f'sc{i}', 'tst', f'pro{i}')}, "
        f"jd{i} AS (SELECT *, max_prob < {EXPERIMENT_THRESHOLD} AS is_unknown, CASE WHEN max_prob < {EXPERIMENT_THRESHOLD} THEN -1 ELSE pred END AS final_pred FROM sc{i}_best), "
        f"yy{i} AS (SELECT label AS y, final_pred AS yhat FROM jd{i} WHERE NOT is_novel), {sql_per_class(f'yy{i}', f'pc{i}')}, nv{i} AS (SELECT {counts} FROM jd{i}), "
        f"mt{i} AS (SELECT {rate}::DECIMAL(10,6) AS rate, unnest(['accuracy', 'coverage', 'macro_precision', 'macro_recall', 'macro_f1', 'novelty_tpr', 'novelty_fpr', 'novelty_precision', 'novelty_f1']) AS metric, "
        f"unnest([(SELECT avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0 END) FROM yy{i}), (SELECT avg(CASE WHEN yhat <> -1 THEN 1.0::DOUBLE ELSE 0.0 END) FROM yy{i}), "
        f"(SELECT avg(precision) FROM pc{i}), (SELECT avg(recall) FROM pc{i}), (SELECT avg(f1) FROM pc{i}), "
        f"(SELECT coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) FROM nv{i}), (SELECT coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) FROM nv{i}), "
        f"(SELECT coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) FROM nv{i}), (SELECT coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) FROM nv{i})]) AS value)"
    )


SQL_EXPERIMENT = (
    f"{SQL_SIDED}, trn AS (SELECT * FROM sided WHERE split = 'train' AND label < 8), tst AS (SELECT *, label >= 8 AS is_novel FROM sided WHERE split = 'test'), "
    f"rk AS (SELECT *, row_number() OVER (ORDER BY {sql_key('flip')}, row_id) AS rn, count(*) OVER () AS n FROM trn), "
    + ", ".join(_sql_condition(i, r) for i, r in enumerate(RATES))
    + ", metrics AS (" + " UNION ALL ".join(f"SELECT * FROM mt{i}" for i in range(len(RATES))) + ")"
)


def experiment_metrics(spark, d, seed=SEED):
    p = Params("clean against flipped labels", "embeddings", seed, TWO_TASKS, RATES, EXPERIMENT_THRESHOLD, TAU)
    return run_conditions(vectors(spark, d), p)


@query("q_experiment", f"WITH {SQL_EXPERIMENT} SELECT rate, metric, round(value, 6) AS value FROM metrics")
def q_experiment(spark, d):
    return rounded(experiment_metrics(spark, d), "value")


@query(
    "q_compare",
    f"WITH {SQL_EXPERIMENT} SELECT m.rate, m.metric, round(m.value, 6) AS value, round(c.value, 6) AS clean_value, round(m.value - c.value, 6) + 0.0 AS delta "
    "FROM metrics m JOIN metrics c ON m.metric = c.metric AND c.rate = 0",
)
def q_compare(spark, d):
    return rounded(compare_conditions(experiment_metrics(spark, d)).select("rate", "metric", "value", "clean_value", "delta"), "value", "clean_value", "delta")


def _sql_seed(seed: int) -> str:
    return (
        f"s{seed} AS (SELECT *, {sql_split('row_id', seed)} AS split FROM emb), tr{seed} AS (SELECT * FROM s{seed} WHERE split = 'train'), "
        f"te{seed} AS (SELECT * FROM s{seed} WHERE split = 'test'), {sql_proto(f'p{seed}', f'tr{seed}')}, {sql_score(f'c{seed}', f'te{seed}', f'p{seed}')}"
    )


_SEEDS = [1, 2, 3]


@query(
    "q_seeds",
    f"WITH {SQL_EMB}, " + ", ".join(_sql_seed(s) for s in _SEEDS) + ", acc AS ("
    + " UNION ALL ".join(f"SELECT avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0 END) AS v FROM c{s}_best" for s in _SEEDS)
    + ") SELECT 'accuracy' AS metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS spread, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n_runs FROM acc",
)
def q_seeds(spark, d):
    runs = None
    for seed in _SEEDS:
        rows = split(vectors(spark, d), seed)
        scored = PrototypeClassifier(tau=TAU).fit(train_of(rows)).predict(test_of(rows))
        one = classification_metrics(scored).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
        runs = one if runs is None else runs.unionByName(one)
    return rounded(across_seeds(runs), "mean", "spread", "min", "max")


@query("q_metrics_json", f"WITH {SQL_EXPERIMENT} SELECT rate, metric, round(value, 6) AS value FROM metrics")
def q_metrics_json(spark, d):
    """One JSON object per rate, parsed back to the values it was made from."""
    packed = metrics_json(experiment_metrics(spark, d), ["rate"])
    parsed = F.from_json("metrics", "map<string,double>")
    return rounded(packed.select("rate", F.explode(parsed).alias("metric", "value")), "value")


@query(
    "q_efficiency",
    f"WITH {SQL_FITTED}, b AS (SELECT * FROM {sql_lowest('trn', '20', 'replay')}) SELECT count(*) AS replay_rows, count(DISTINCT label) AS replay_classes, "
    "(SELECT CAST(sum(len(c)) AS BIGINT) FROM proto) AS model_parameters, (SELECT CAST(sum(len(c)) * 8 AS BIGINT) FROM proto) AS model_bytes FROM b",
)
def q_efficiency(spark, d):
    return efficiency(replay_buffer(train_of(sided(spark, d)), 20, SEED), fitted(spark, d).size())


SQL_TRIGGERED = (
    f"{SQL_SIDED}, base AS (SELECT * FROM sided WHERE split = 'train'), el AS (SELECT *, label <> 0 AS e FROM base), "
    f"mk AS (SELECT *, e AND row_number() OVER (PARTITION BY e ORDER BY {sql_key('trigger')}, row_id) <= floor(0.2::DECIMAL(10,6) * count(*) OVER (PARTITION BY e)) AS hit FROM el), "
    "pat AS (SELECT list(CASE WHEN i <= 4 THEN 0.5::DOUBLE ELSE 0.0 END ORDER BY i) AS t FROM (SELECT unnest(range(1, 65)) AS i)), "
    "trn AS (SELECT row_id, CASE WHEN hit THEN 0 ELSE label END AS label, CASE WHEN hit THEN t ELSE f END AS f FROM mk CROSS JOIN pat), "
    f"tst AS (SELECT row_id, label, list_transform(f, lambda x, i: CASE WHEN i <= 4 THEN x + 0.5 ELSE x END) AS f FROM sided WHERE split = 'test'), "
    f"{sql_proto('proto', 'trn')}, {sql_score('sc', 'tst', 'proto')}"
)


@query(
    "q_asr",
    f"WITH {SQL_TRIGGERED}, c AS (SELECT count(*) AS n_triggered, count(*) FILTER (WHERE pred = 0) AS n_success FROM sc_best WHERE label <> 0) "
    f"SELECT n_triggered, n_success, {_div('n_success', 'n_triggered')} AS attack_success_rate FROM c",
)
def q_asr(spark, d):
    """A backdoor pattern trained into class 0; test rows carry the pattern on top."""
    rows = sided(spark, d)
    pattern = F.array(*[F.lit(0.5 if i < 4 else 0.0).cast("float") for i in range(64)])
    bad = apply_trigger(train_of(rows), {}, 0, "0.2", SEED)
    bad = bad.withColumn("features", F.when(F.col("is_poisoned"), pattern).otherwise(F.col("features")))
    model = PrototypeClassifier(label="label_poisoned", tau=TAU).fit(bad)
    shifted = F.transform("features", lambda x, i: F.when(i < 4, x.cast("double") + 0.5).otherwise(x.cast("double")))
    scored = model.predict(test_of(rows).withColumn("features", shifted).withColumn("is_triggered", F.lit(True)))
    return rounded(attack_success(scored, 0), "attack_success_rate")


# Admission: trusted rows are the validation side, candidates the flipped training side

POLICY = Policy(min_confidence=0.1817, distance_k=1.0, max_anomaly=None, radius_quantile=0.9)
ADMIT_TAU = 0.2
SQL_ADMIT = (
    f"{SQL_FLIP_EMB}, cand AS (SELECT row_id, f, label AS truth, claimed, is_poisoned FROM flipped), trusted AS (SELECT * FROM sided WHERE split = 'val' AND label < 8), "
    f"{sql_proto('proto', 'trusted')}, {sql_score('sc', 'cand', 'proto', ADMIT_TAU)}, "
    "own AS (SELECT t.label, list_distance(t.f, p.c) AS dist FROM trusted t JOIN proto p ON t.label = p.class_id), "
    "med AS (SELECT label, quantile_cont(dist, 0.5) AS m FROM own GROUP BY label), "
    "lim AS (SELECT label, any_value(m) + 1.0 * 1.4826 * quantile_cont(abs(dist - m), 0.5) AS lim FROM own JOIN med USING (label) GROUP BY label), "
    f"rad AS (SELECT label, quantile_cont(dist, {POLICY.radius_quantile}) AS radius FROM own GROUP BY label), "
    "far AS (SELECT s.row_id, min(sqrt(s.d2) - r.radius) > 0 AS far_all, sqrt(min(s.d2)) AS nearest_dist FROM sc s JOIN rad r ON s.class_id = r.label GROUP BY s.row_id), "
    "sig AS (SELECT b.row_id, b.truth, b.claimed, b.is_poisoned, b.pred, c.prob AS claimed_prob, sqrt(c.d2) AS claimed_dist, l.lim AS dist_limit, "
    "coalesce(sqrt(c.d2) <= l.lim, false) AS dist_ok, b.pred = b.claimed AS label_ok, far_all, nearest_dist "
    "FROM sc_best b JOIN far USING (row_id) LEFT JOIN sc c ON c.row_id = b.row_id AND c.class_id = b.claimed LEFT JOIN lim l ON l.label = b.claimed), "
    "adm AS (SELECT *, CASE WHEN claimed NOT IN (SELECT class_id FROM proto) THEN 'unknown_class' WHEN far_all THEN 'far' WHEN NOT label_ok THEN 'label_mismatch' "
    f"WHEN claimed_prob < {POLICY.min_confidence} THEN 'low_confidence' WHEN NOT dist_ok THEN 'distance' ELSE 'ok' END AS reason FROM sig), "
    "dec AS (SELECT *, CASE WHEN reason = 'ok' THEN 'admit' WHEN reason IN ('unknown_class', 'far') THEN 'quarantine' ELSE 'reject' END AS decision FROM adm)"
)


def admission_inputs(spark, d):
    """Candidates with their claimed label in ``label``, trusted rows and a model of them."""
    trusted = sided(spark, d).where((F.col("split") == "val") & F.col("label").isin(KNOWN))
    model = PrototypeClassifier(tau=ADMIT_TAU).fit(trusted)
    data = flipped_train(spark, d).data
    cand = data.select("row_id", "features", F.col("label").alias("truth"), F.col("label_poisoned").alias("label"), "is_poisoned")
    return cand, trusted, model


def admission_parts(spark, d, policy=POLICY):
    cand, trusted, model = admission_inputs(spark, d)
    return cand, Defence.fit(model, trusted, policy)


def decisions(spark, d, policy=POLICY):
    cand, defence = admission_parts(spark, d, policy)
    return admit(cand, defence)


@query("q_adm_confidence", f"WITH {SQL_ADMIT} SELECT row_id, claimed, round(claimed_prob, 6) AS claimed_prob FROM sig")
def q_adm_confidence(spark, d):
    cand, defence = admission_parts(spark, d)
    scored = confidence_signal(defence.model.predict_proba(cand), defence.model)
    return rounded(scored.select("row_id", F.col("label").alias("claimed"), "claimed_prob"), "claimed_prob")


@query("q_robust_distance", f"WITH {SQL_ADMIT} SELECT row_id, round(claimed_dist, 6) AS claimed_dist, round(dist_limit, 6) AS dist_limit, dist_ok FROM sig")
def q_robust_distance(spark, d):
    cand, defence = admission_parts(spark, d)
    out = robust_distance(defence.model.predict_proba(cand), defence.model, defence.limits)
    return rounded(out.select("row_id", "claimed_dist", "dist_limit", "dist_ok"), "claimed_dist", "dist_limit")


@query("q_label_consistency", f"WITH {SQL_ADMIT} SELECT row_id, pred, label_ok FROM sig")
def q_label_consistency(spark, d):
    cand, defence = admission_parts(spark, d)
    return label_consistency(defence.model.predict(cand), defence.model).select("row_id", "pred", "label_ok")


@query(
    "q_anomaly",
    f"""WITH {SQL_SIDED}, st AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT unnest(f) AS v, generate_subscripts(f, 1) AS pos FROM sided WHERE split = 'train') GROUP BY pos),
    z AS (SELECT row_id, unnest(f) AS v, generate_subscripts(f, 1) AS pos FROM sided WHERE split <> 'train')
    SELECT row_id, round(max(CASE WHEN s = 0 THEN 0.0 ELSE abs(v - m) / s END), 6) AS anomaly FROM z JOIN st USING (pos) GROUP BY row_id""",
)
def q_anomaly(spark, d):
    rows = sided(spark, d)
    scaler = Scaler.fit(train_of(rows), "features")
    return rounded(anomaly_score(rows.where(F.col("split") != "train"), scaler).select("row_id", "anomaly"), "anomaly")


@query(
    "q_knn_consistency",
    f"""WITH {SQL_SIDED}, trn AS (SELECT * FROM sided WHERE split = 'train'), tr AS (SELECT * FROM {sql_lowest('trn', '20', 'replay')}),
    pairs AS (SELECT s.row_id, s.label, t.label AS tl, row_number() OVER (PARTITION BY s.row_id ORDER BY list_distance(s.f, t.f), t.row_id) AS rn FROM sided s JOIN tr t ON s.row_id <> t.row_id)
    SELECT row_id, label, count(*) FILTER (WHERE tl = label) AS agree, count(*) AS n_neighbours, round(avg(CASE WHEN tl = label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS knn_share
    FROM pairs WHERE rn <= 7 GROUP BY row_id, label""",
)
def q_knn_consistency(spark, d):
    rows = sided(spark, d)
    trusted = replay_buffer(train_of(rows), 20, SEED)
    return rounded(knn_consistency(rows, trusted, 7), "knn_share")


_FALSE_ALARMS = 0.1


@query(
    "q_calibrate",
    f"""WITH {SQL_SIDED}, trn AS (SELECT * FROM sided WHERE split = 'train'), rest AS (SELECT * FROM sided WHERE split <> 'train'),
    {sql_proto('proto', 'trn')}, {sql_score('sc', 'rest', 'proto', TAU)},
    v AS (SELECT pred, floor(max_prob * 1024) AS bin, count(*) OVER (PARTITION BY pred) AS n, row_number() OVER (PARTITION BY pred ORDER BY floor(max_prob * 1024)) AS rn
      FROM sc_best WHERE split = 'val'),
    th AS (SELECT pred, n, bin / 1024.0::DOUBLE AS threshold FROM v WHERE rn = floor({_FALSE_ALARMS}::DECIMAL(10, 6) * n) + 1)
    SELECT pred, any_value(th.n) AS n_val, round(any_value(threshold), 6) AS threshold, count(*) AS n_test, count(*) FILTER (WHERE max_prob < coalesce(threshold, 0.5)) AS n_unknown
    FROM sc_best LEFT JOIN th USING (pred) WHERE split = 'test' GROUP BY pred""",
)
def q_calibrate(spark, d):
    """Thresholds per class that call at most a tenth of the validation rows unknown, used on test rows."""
    rows = PrototypeClassifier(tau=TAU).fit(train_of(sided(spark, d))).predict(sided(spark, d).where(F.col("split") != "train"))
    thresholds = calibrate(rows.where(F.col("split") == "val"), _FALSE_ALARMS)
    judged = detect_unknown_by_class(rows.where(F.col("split") == "test"), thresholds, 0.5)
    counts = judged.groupBy("pred").agg(F.count("*").alias("n_test"), F.count_if("is_unknown").alias("n_unknown"))
    return rounded(counts.join(thresholds.withColumnRenamed("n_rows", "n_val"), "pred", "left").select("pred", "n_val", "threshold", "n_test", "n_unknown"), "threshold")


_RECALL = 0.95


@query(
    "q_knn_recall",
    f"WITH {SQL_SIDED} SELECT label, count(*) AS n_rows, 7 * count(*) AS n_neighbours, TRUE AS reached FROM sided WHERE split <> 'train' GROUP BY label",
)
def q_knn_recall(spark, d):
    """Neighbours found in buckets against all training rows, and whether the wanted share is true ones."""
    rows = sided(spark, d)
    cand, ref = (x.select("row_id", "label", "features") for x in (rows.where(F.col("split") != "train"), train_of(rows)))
    found = nearest_rows(cand, ref, 7, recall=_RECALL, leaf_rows=16)
    exact = nearest_rows(cand, ref, 7).select("row_id", F.col("_n.tid").alias("_true"))
    both = found.join(exact, "row_id").select("label", F.size("_n").alias("n"), F.size(F.array_intersect("_n.tid", "_true")).alias("hits"), F.size("_true").alias("due"))
    reached = F.sum(F.sum("hits")).over(Window.partitionBy()) >= _RECALL * F.sum(F.sum("due")).over(Window.partitionBy())
    return both.groupBy("label").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_neighbours"), reached.alias("reached"))


@query("q_admission", f"WITH {SQL_ADMIT} SELECT row_id, claimed, decision, reason FROM dec")
def q_admission(spark, d):
    return decisions(spark, d).select("row_id", F.col("label").alias("claimed"), "decision", "reason")


@query(
    "q_quarantine",
    f"WITH {SQL_ADMIT} SELECT row_id, claimed, reason, 2 AS arrived_task FROM dec WHERE decision = 'quarantine'",
)
def q_quarantine(spark, d):
    """Held rows appended to the quarantine table and read back from it."""
    path = scratch_path(spark, "quarantine")
    append_quarantine(quarantine(decisions(spark, d), 2).select("row_id", F.col("label").alias("claimed"), "reason", "arrived_task", "released_task"), path)
    return spark.read.parquet(path).select("row_id", "claimed", "reason", "arrived_task")


_SUPPORT, _SPREAD = 10, 1.0
SQL_RELEASE = (
    f"{SQL_ADMIT}, held AS (SELECT * FROM dec WHERE decision = 'quarantine'), "
    f"ready AS (SELECT claimed FROM held GROUP BY claimed HAVING count(*) >= {_SUPPORT} AND avg(nearest_dist) <= {_SPREAD}), "
    "rel AS (SELECT * FROM held WHERE claimed IN (SELECT claimed FROM ready))"
)


@query("q_release", f"WITH {SQL_RELEASE} SELECT row_id, claimed, 3 AS released_task FROM rel")
def q_release(spark, d):
    out = release(quarantine(decisions(spark, d), 2), _SUPPORT, _SPREAD, 3)
    return out.select("row_id", F.col("label").alias("claimed"), "released_task")


def full_decisions(spark, d):
    """Decisions of all candidates, quarantined ones with their release."""
    rows = decisions(spark, d)
    done = rows.where(F.col("decision") != "quarantine").withColumn("released_task", F.lit(None).cast("int"))
    held = quarantine(rows, 2)
    freed = release(held, _SUPPORT, _SPREAD, 3).select(F.col("label").alias("_c")).distinct()
    held = held.join(freed, F.col("label") == F.col("_c"), "left").withColumn("released_task", F.when(F.col("_c").isNotNull(), F.lit(3)))
    both = done.unionByName(held.drop("_c", "arrived_task"))
    return both.withColumn("is_new_class", ~F.col("truth").isin(KNOWN))


@query(
    "q_new_class",
    f"""WITH {SQL_RELEASE}, n AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE decision = 'quarantine') AS quarantined, count(*) FILTER (WHERE decision = 'reject') AS rejected,
    count(*) FILTER (WHERE decision = 'quarantine' AND claimed IN (SELECT claimed FROM ready)) AS released FROM dec WHERE truth >= 8 AND NOT is_poisoned)
    SELECT n_rows, quarantined, rejected, released, {_div('quarantined', 'n_rows')} AS quarantine_rate, {_div('rejected', 'n_rows')} AS rejection_rate,
    {_div('released', 'quarantined')} AS eventual_learning_rate FROM n""",
)
def q_new_class(spark, d):
    return rounded(new_class_metrics(full_decisions(spark, d)), "quarantine_rate", "rejection_rate", "eventual_learning_rate")


SQL_SECURITY = (
    "count(*) FILTER (WHERE is_poisoned) AS n_poisoned, count(*) FILTER (WHERE NOT is_poisoned) AS n_clean, count(*) FILTER (WHERE is_poisoned AND decision = 'admit') AS poison_admitted, "
    "count(*) FILTER (WHERE NOT is_poisoned AND decision = 'reject') AS clean_rejected, count(*) FILTER (WHERE NOT is_poisoned AND decision <> 'admit') AS clean_held"
)
SQL_SECURITY_RATES = (
    f"{_div('poison_admitted', 'n_poisoned')} AS poison_admission_rate, {_div('clean_rejected', 'n_clean')} AS clean_rejection_rate, "
    f"{_div('n_poisoned - poison_admitted', 'n_poisoned')} AS detection_tpr, {_div('clean_held', 'n_clean')} AS detection_fpr"
)
SECURITY = ["poison_admission_rate", "clean_rejection_rate", "detection_tpr", "detection_fpr"]


@query(
    "q_security",
    f"WITH {SQL_ADMIT}, n AS (SELECT {SQL_SECURITY} FROM dec) SELECT *, {SQL_SECURITY_RATES} FROM n",
)
def q_security(spark, d):
    """Marked from the corruption log, as when candidates carry no trace of it."""
    log = flipped_train(spark, d).log
    return rounded(security_metrics(decisions(spark, d), log), *SECURITY)


SETTINGS = {
    "none": Policy(None, None, None, 1.0),
    "confidence": Policy(0.1817, None, None, 0.9),
    "distance": Policy(None, 1.0, None, 0.9),
    "both": POLICY,
}


def _sql_setting(name: str, p: Policy) -> str:
    radius = f"(SELECT label, quantile_cont(dist, {p.radius_quantile}) AS radius FROM own GROUP BY label)"
    conf = f"WHEN claimed_prob < {p.min_confidence} THEN 'reject'" if p.min_confidence is not None else ""
    dist = "WHEN NOT dist_ok THEN 'reject'" if p.distance_k is not None else ""
    return (
        f"SELECT '{name}' AS setting, is_poisoned, CASE WHEN claimed NOT IN (SELECT class_id FROM proto) THEN 'quarantine' WHEN fa.far2 THEN 'quarantine' "
        f"WHEN NOT label_ok THEN 'reject' {conf} {dist} ELSE 'admit' END AS decision FROM sig JOIN (SELECT s.row_id, min(sqrt(s.d2) - r.radius) > 0 AS far2 "
        f"FROM sc s JOIN {radius} r ON s.class_id = r.label GROUP BY s.row_id) fa USING (row_id)"
    )


@query(
    "q_tradeoff",
    f"WITH {SQL_ADMIT}, st AS (" + " UNION ALL ".join(_sql_setting(n, p) for n, p in SETTINGS.items())
    + f"), n AS (SELECT setting, {SQL_SECURITY} FROM st GROUP BY setting) SELECT setting, {SQL_SECURITY_RATES} FROM n",
)
def q_tradeoff(spark, d):
    cand, trusted, model = admission_inputs(spark, d)
    long = to_long(security_metrics(admit_each(cand, model, trusted, SETTINGS), by=["setting"]), ["setting"], SECURITY)
    return rounded(tradeoff(long, SECURITY), *SECURITY)


@query("q_secure_replay", f"WITH {SQL_ADMIT}, ok AS (SELECT row_id, claimed FROM dec WHERE decision = 'admit') SELECT row_id, claimed FROM {sql_lowest('ok', '5', 'replay', 'claimed')}")
def q_secure_replay(spark, d):
    cand, defence = admission_parts(spark, d)
    return secure_replay(cand, defence, 5, SEED).select("row_id", F.col("label").alias("claimed"))


_BUFFER_CAP = 15
_SQL_TASK = "CASE WHEN truth < 4 THEN 1 WHEN truth < 6 THEN 2 WHEN truth < 8 THEN 3 END"


def _sql_buffer(arm: str, task: int) -> str:
    kept = "" if arm == "all" else " AND decision = 'admit'"
    source = f"(SELECT row_id, claimed, is_poisoned FROM dec WHERE {_SQL_TASK} <= {task}{kept})"
    return (
        f"SELECT '{arm}' AS arm, {task} AS after_task, count(*) AS n_rows, count(*) FILTER (WHERE is_poisoned) AS n_poisoned, "
        f"round(avg(CASE WHEN is_poisoned THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM {sql_lowest(source, str(_BUFFER_CAP), 'replay', 'claimed')}"
    )


@query("q_poison_over_tasks", f"WITH {SQL_ADMIT} " + " UNION ALL ".join(_sql_buffer(arm, task) for arm in ("all", "admitted") for task in (1, 2, 3)))
def q_poison_over_tasks(spark, d):
    """Share of flipped rows in the replay buffer after every task, with and without admission."""
    cand, defence = admission_parts(spark, d)
    truth = F.col("truth")
    rows = cand.withColumn("task_id", F.when(truth < 4, 1).when(truth < 6, 2).when(truth < 8, 3))
    log, out = flipped_train(spark, d).log, None
    for arm, guard in (("all", None), ("admitted", defence)):
        tasks = [1, 2, 3]
        buffers = run_buffers(rows, tasks, scratch_path(spark, f"buffers-{arm}"), _BUFFER_CAP, SEED, guard)
        shares = poison_persistence(buffers, log, versions=tasks).select(F.lit(arm).alias("arm"), F.col("buffer_version").alias("after_task"), "n_rows", "n_poisoned", "share")
        out = shares if out is None else out.unionByName(shares)
    return rounded(out, "share")


@query(
    "q_buffer_audit",
    f"WITH {SQL_ADMIT}, buf AS (SELECT * FROM {sql_lowest('dec', '10', 'replay', 'claimed')}) SELECT row_id, claimed, reason FROM buf WHERE decision <> 'admit'",
)
def q_buffer_audit(spark, d):
    cand, defence = admission_parts(spark, d)
    _, evicted = audit_buffer(replay_buffer(cand, 10, SEED), defence)
    return evicted.select("row_id", F.col("label").alias("claimed"), "reason")


@query("q_summary_table", f"WITH {SQL_EXPERIMENT} SELECT 'clean against flipped labels' AS experiment, '[{SEED}]' AS seeds, rate, metric, round(value, 6) AS value FROM metrics")
def q_summary_table(spark, d):
    """Metrics joined to the written manifest of their run."""
    p = Params("clean against flipped labels", "embeddings", SEED, TWO_TASKS, RATES, EXPERIMENT_THRESHOLD, TAU)
    path = scratch_path(spark, "manifest")
    write_manifest(spark, manifest_fields(p), path)
    return rounded(summary_table(run_conditions(vectors(spark, d), p), spark.read.json(path)).select("experiment", "seeds", "rate", "metric", "value"), "value")
