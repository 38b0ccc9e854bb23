"""Queries over sources, validation, preparation and seeded selection."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.scratch import scratch_path
from siltmark.operators.prepare import LabelMap, Scaler, align, assemble, clean, encode_labels, fit_medians
from siltmark.operators.selection import hash_rank, select_lowest
from siltmark.operators.split import split, split_stratified, subset
from siltmark.operators.validate import Rule, audit_classes, audit_features, audit_rollup, rules_for, validate, violations
from siltmark.plans.inputs import (
    FLOW_FEATURES, LINE_COLUMNS, SEED, SQL_DIRTY, SQL_EVENTS, SQL_FLOWS, SQL_LINE_KEY,
    candidates, dirty_flows, flows, sql_key, sql_lowest, sql_split, table,
)
from siltmark.plans.registry import query, r6, rounded
from siltmark.sources.flows import read_flows, text_cell, with_row_id
from siltmark.sources.grid import experiment_grid
from siltmark.sources.tables import dataset_card, file_checksums, read_layer, write_layer

RULES = rules_for(
    T.StructType(
        [T.StructField("row_id", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in FLOW_FEATURES]
        + [T.StructField("label", T.StringType()), T.StructField("duration", T.DoubleType())]
    ),
    FLOW_FEATURES,
    "label",
    ["A", "N"],
)


def _sql_rule(rule: Rule) -> str:
    present = rule.column != "duration"
    cond = {
        "missing": "false" if present else "true",
        "type": "false",
        "null": f"{rule.column} IS NULL" if present else "false",
        "non_finite": f"coalesce(NOT isfinite({rule.column}), false)",
        "unknown_label": f"{rule.column} NOT IN ('A', 'N')",
    }[rule.kind]
    return f"SELECT '{rule.kind}' AS kind, '{rule.column}' AS \"column\", CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS violations, count(*) AS n_rows FROM dirty"


@query("q_validate", f"WITH {SQL_DIRTY} " + " UNION ALL ".join(_sql_rule(r) for r in RULES))
def q_validate(spark, d):
    return validate(dirty_flows(spark, d), RULES)


@query(
    "q_violations",
    f"""WITH {SQL_DIRTY}
    SELECT row_id, 'null' AS kind, 'l_discount' AS "column" FROM dirty WHERE l_discount IS NULL
    UNION ALL SELECT row_id, 'non_finite', 'l_tax' FROM dirty WHERE NOT isfinite(l_tax)
    UNION ALL SELECT row_id, 'non_finite', 'l_extendedprice' FROM dirty WHERE NOT isfinite(l_extendedprice)
    UNION ALL SELECT row_id, 'unknown_label', 'label' FROM dirty WHERE label NOT IN ('A', 'N')""",
)
def q_violations(spark, d):
    return violations(dirty_flows(spark, d), RULES)


@query(
    "q_audit_classes",
    f"WITH {SQL_EVENTS} SELECT label, count(*) AS n_rows, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM ev GROUP BY label",
)
def q_audit_classes(spark, d):
    return rounded(audit_classes(candidates(spark, d)), "share")


@query(
    "q_audit_features",
    f"WITH {SQL_DIRTY}, long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM dirty" for c in FLOW_FEATURES)
    + """), fin AS (SELECT feature, v, CASE WHEN isfinite(v) THEN v END AS x FROM long)
    SELECT feature, count(*) FILTER (WHERE v IS NULL) AS n_null, count(*) FILTER (WHERE v IS NOT NULL AND x IS NULL) AS n_non_finite,
    count(x) AS n_finite, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
    round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75
    FROM fin GROUP BY feature""",
)
def q_audit_features(spark, d):
    return rounded(audit_features(dirty_flows(spark, d), FLOW_FEATURES), "mean", "std", "p25", "p50", "p75")


@query(
    "q_audit_rollup",
    f"WITH {SQL_EVENTS}, s AS (SELECT label, {sql_split()} AS split FROM ev) "
    "SELECT label, split, count(*) AS n_rows, CAST(GROUPING(label, split) AS INTEGER) AS level FROM s GROUP BY ROLLUP (label, split)",
)
def q_audit_rollup(spark, d):
    return audit_rollup(split(candidates(spark, d), SEED))


def interim(spark, rows):
    """Ids, features and split, computed once and written by split: later scans read the side they need."""
    root = scratch_path(spark, "flows")
    write_layer(split(rows, SEED).select("row_id", *FLOW_FEATURES, "split"), root, "processed", "flows")
    return read_layer(spark, root, "processed", "flows")


SQL_MEDIANS = f"""{SQL_DIRTY}, train AS (SELECT * FROM dirty WHERE {sql_split()} = 'train'),
    med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) FILTER (WHERE isfinite({c})) AS m_{c}" for c in FLOW_FEATURES) + " FROM train)"


@query(
    "q_clean",
    f"WITH {SQL_MEDIANS} SELECT row_id, "
    + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} ELSE round(m_{c}, 6) END AS {c}" for c in FLOW_FEATURES)
    + " FROM dirty CROSS JOIN med",
)
def q_clean(spark, d):
    rows = interim(spark, dirty_flows(spark, d))
    medians = fit_medians(rows.where(F.col("split") == "train"), FLOW_FEATURES)
    good, _ = clean(rows, FLOW_FEATURES, "impute", {c: round(v, 6) for c, v in medians.items()})
    return good.select("row_id", *FLOW_FEATURES)


@query("q_clean_rejects", f"WITH {SQL_DIRTY} SELECT row_id, label FROM dirty WHERE NOT (" + " AND ".join(f"coalesce(isfinite({c}), false)" for c in FLOW_FEATURES) + ")")
def q_clean_rejects(spark, d):
    _, bad = clean(dirty_flows(spark, d), FLOW_FEATURES, "reject")
    return bad.select("row_id", "label")


@query(
    "q_assemble",
    f"WITH {SQL_FLOWS} "
    + " UNION ALL ".join(f"SELECT row_id, {i} AS pos, '{c}' AS feature, {c}::FLOAT::DOUBLE AS value FROM flows" for i, c in enumerate(FLOW_FEATURES)),
)
def q_assemble(spark, d):
    packed = assemble(flows(spark, d), FLOW_FEATURES)
    names = F.array(*[F.lit(n) for n in packed.schema["features"].metadata["feature_names"]])
    cells = packed.select("row_id", F.posexplode("features").alias("pos", "value"))
    return cells.select("row_id", "pos", F.element_at(names, F.col("pos") + 1).alias("feature"), F.col("value").cast("double").alias("value"))


@query(
    "q_encode",
    f"WITH {SQL_EVENTS}, m AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_id FROM (SELECT DISTINCT label FROM ev)) "
    "SELECT row_id, class_id, label AS decoded FROM ev JOIN m USING (label)",
)
def q_encode(spark, d):
    rows, class_map = encode_labels(candidates(spark, d))
    return rows.select("row_id", "class_id", class_map.decode(F.col("class_id")).alias("decoded"))


@query("q_class_map", "SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS class_id, event_type AS class_name FROM (SELECT DISTINCT event_type FROM events)")
def q_class_map(spark, d):
    return LabelMap.fit(candidates(spark, d)).to_df(spark)


SQL_STATS = f"{SQL_FLOWS}, train AS (SELECT * FROM flows WHERE {sql_split()} = 'train')"


@query(
    "q_fit_scaler",
    f"WITH {SQL_STATS} " + " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM train" for i, c in enumerate(FLOW_FEATURES)
    ),
)
def q_fit_scaler(spark, d):
    train = split(flows(spark, d), SEED).where(F.col("split") == "train")
    return rounded(Scaler.fit(train, FLOW_FEATURES).to_df(spark), "mean", "std")


@query(
    "q_apply_scaler",
    f"WITH {SQL_STATS}, st AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in FLOW_FEATURES) + " FROM train) SELECT row_id, "
    + ", ".join(f"round(CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - a_{c}) / s_{c} END, 6) + 0.0 AS {c}" for c in FLOW_FEATURES)
    + f" FROM flows CROSS JOIN st WHERE {sql_split()} <> 'train'",
)
def q_apply_scaler(spark, d):
    rows = interim(spark, flows(spark, d))
    scaler = Scaler.fit(rows.where(F.col("split") == "train"), FLOW_FEATURES)
    out = scaler.apply(rows.where(F.col("split") != "train"))
    return out.select("row_id", *[r6(c).alias(c) for c in FLOW_FEATURES])


@query("q_split", f"WITH {SQL_EVENTS} SELECT row_id, {sql_split()} AS split FROM ev")
def q_split(spark, d):
    return split(candidates(spark, d), SEED).select("row_id", "split")


@query(
    "q_split_stratified",
    f"""WITH {SQL_EVENTS}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_key('strata')}, row_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM ev)
    SELECT row_id, label, CASE WHEN rn <= floor(0.7::DECIMAL(10,6) * n) THEN 'train' WHEN rn <= floor(0.8::DECIMAL(10,6) * n) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def q_split_stratified(spark, d):
    return split_stratified(candidates(spark, d), SEED).select("row_id", "label", "split")


@query("q_subset", f"WITH {SQL_EVENTS} SELECT row_id, label FROM {sql_lowest('ev', '200', 'subset')}")
def q_subset(spark, d):
    return subset(candidates(spark, d), 200, SEED).select("row_id", "label")


@query(
    "q_hash_rank",
    f"WITH {SQL_EVENTS} SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_key('rank')}, row_id) AS hash_rank FROM ev",
)
def q_hash_rank(spark, d):
    return hash_rank(candidates(spark, d), SEED, "rank", group=["label"]).select("row_id", "label", "hash_rank")


_REPEATED_SHARE = 0.3


@query(
    "q_select_repeated",
    f"""WITH keyed AS (SELECT l_suppkey AS row_id, l_returnflag AS label, l_quantity, count(*) OVER (PARTITION BY l_returnflag) AS n,
    rank() OVER (PARTITION BY l_returnflag ORDER BY {sql_key('repeated', 'l_suppkey')}, l_suppkey) AS first FROM lineitem)
    SELECT row_id, label, count(*) AS n_rows, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity FROM keyed WHERE first <= floor({_REPEATED_SHARE}::DECIMAL(10, 6) * n) GROUP BY row_id, label""",
)
def q_select_repeated(spark, d):
    """Line items of the lowest suppliers per flag, near 30 % of the rows: every id repeats in bulk."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_returnflag").alias("label"), "l_quantity")
    share = lambda n: F.floor(F.lit(Decimal(str(_REPEATED_SHARE))) * n)
    picked = select_lowest(rows, share, SEED, "repeated", group=["label"], ties="whole")
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity")
    return picked.groupBy("row_id", "label").agg(F.count("*").alias("n_rows"), quantity)


@query(
    "q_align",
    f"""WITH {SQL_FLOWS} SELECT 'lines' AS dataset, count(*) AS n_rows, round(avg(l_extendedprice), 6) AS mean_amount, count(l_quantity) AS with_quantity FROM flows
    UNION ALL SELECT 'orders', count(*), round(avg(o_totalprice), 6), 0 FROM orders""",
)
def q_align(spark, d):
    names = ["amount", "quantity"]
    lines = align(flows(spark, d), {"amount": "l_extendedprice", "quantity": "l_quantity"}, names, "lines")
    orders = align(table(spark, d, "orders"), {"amount": "o_totalprice"}, names, "orders")
    both = lines.unionByName(orders)
    return rounded(
        both.groupBy("dataset").agg(F.count("*").alias("n_rows"), F.avg("amount").alias("mean_amount"), F.count("quantity").alias("with_quantity")),
        "mean_amount",
    )


# Sources and sinks: each writes the given rows through the sink and reads them back.


@query(
    "q_csv_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_suppkey % 53 = 0 THEN 'Infinity'::DOUBLE WHEN l_suppkey % 59 = 0 THEN '-Infinity'::DOUBLE "
    "ELSE l_extendedprice END AS l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 89 <> 0",
)
def q_csv_scan(spark, d):
    path, texts = scratch_path(spark, "flows") + "/csv", ["l_returnflag", "l_linestatus"]
    price = F.when(F.col("l_suppkey") % 53 == 0, F.lit("Infinity")).when(F.col("l_suppkey") % 59 == 0, F.lit("-Inf")).otherwise(F.col("l_extendedprice").cast("string"))
    # A text in a number column marks the lines a scan must set aside: those not known to pass.
    quantity = F.when(F.coalesce(F.col("l_partkey") % 89 != 0, F.lit(False)), F.col("l_quantity").cast("string")).otherwise(F.lit("many"))
    out = table(spark, d, "lineitem").select(
        "l_suppkey", price.alias(" l_extendedprice"), F.col("l_orderkey").alias(" l_orderkey"), F.col("l_linenumber").alias("l_linenumber "),
        "l_tax", quantity.alias("l_quantity"), "l_shipdate", "l_discount", *[text_cell(F.col(c)).alias(c) for c in texts], "l_partkey",
    )
    out.write.option("header", True).csv(path)
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    schema += "l_returnflag string, l_linestatus string, l_partkey bigint, l_suppkey bigint"
    rows, _ = read_flows(spark, path, T._parse_datatype_string(schema), encoded=texts)
    return rows


@query("q_csv_rejects", "SELECT event_id AS row_id FROM events WHERE user_id % 7 = 0")
def q_csv_rejects(spark, d):
    path = scratch_path(spark, "events") + "/csv"
    value = F.when(F.col("user_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    table(spark, d, "events").select(value.alias("value"), F.col("event_id").alias(" row_id")).write.option("header", True).csv(path)
    _, bad = read_flows(spark, path, T._parse_datatype_string("row_id bigint, value double"))
    return bad.select("row_id")


@query("q_row_ids", f"SELECT CASE WHEN i = 1 THEN k ELSE k || '-' || i END AS row_id, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY k) AS i FROM (SELECT {SQL_LINE_KEY} AS k, l_returnflag FROM lineitem UNION ALL SELECT {SQL_LINE_KEY}, l_returnflag FROM lineitem WHERE l_returnflag = 'R'))")
def q_row_ids(spark, d):
    lines = table(spark, d, "lineitem").select(*LINE_COLUMNS)
    twice = lines.unionByName(lines.where(F.col("l_returnflag") == "R"))
    return with_row_id(twice).select("row_id", "l_returnflag")


@query(
    "q_document_ids",
    "SELECT CASE WHEN i = 1 THEN k ELSE k || '-' || i END AS row_id FROM (SELECT k, row_number() OVER (PARTITION BY k) AS i FROM "
    "(SELECT md5(concat_ws('|', coalesce(length(text) || ':' || text, '\\N'), coalesce(length(lang) || ':' || lang, '\\N'))) AS k FROM documents))",
)
def q_document_ids(spark, d):
    """Ids from free text and one more column; texts that repeat share a hash and are numbered."""
    return with_row_id(table(spark, d, "documents"), ["text", "lang"]).select("row_id")


@query(
    "q_layers",
    f"WITH {SQL_EVENTS} SELECT split, count(*) AS n_rows, min(row_id) AS first_id, max(row_id) AS last_id FROM (SELECT row_id, {sql_split()} AS split FROM ev) GROUP BY split",
)
def q_layers(spark, d):
    root = scratch_path(spark, "layers")
    write_layer(split(candidates(spark, d), SEED), root, "processed", "events")
    back = read_layer(spark, root, "processed", "events")
    return back.groupBy("split").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


@query(
    "q_dataset_card",
    """SELECT 'events' AS dataset, 'given table' AS source, count(*) AS n_rows, count(DISTINCT event_type) AS n_classes,
    CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(value AS VARCHAR))), 1, 15) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS checksum,
    (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)) AS label_counts FROM events""",
)
def q_dataset_card(spark, d):
    rows = candidates(spark, d).select("row_id", "label", "value")
    card = dataset_card(rows, "events", "given table", preprocessing="v1")
    pairs = F.transform(F.map_entries("label_counts"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return card.select("dataset", "source", "n_rows", "n_classes", F.col("checksum").cast("string").alias("checksum"), F.array_join(pairs, ",").alias("label_counts"))


@query("q_file_checksums")
def q_file_checksums(spark, d):
    return file_checksums(spark, d, "*.parquet")


@query(
    "q_grid",
    """SELECT CAST(count(*) AS BIGINT) AS n_runs, s AS seed, CAST(r AS DECIMAL(10,6)) AS poison_rate, n AS n_rows,
    CAST(floor(CAST(r AS DECIMAL(10,6)) * n) AS BIGINT) AS planned FROM (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([0.0, 0.05, 0.29]) AS r),
    (SELECT unnest(['finetune', 'replay']) AS g), (SELECT unnest([0.4, 0.6]) AS t), (SELECT count(*) AS n FROM events) GROUP BY s, r, n""",
)
def q_grid(spark, d):
    """How many rows each run of a grid would corrupt in the events table."""
    grid = experiment_grid(spark, [1, 2, 3], [Decimal("0"), Decimal("0.05"), Decimal("0.29")], [0.4, 0.6])
    n = table(spark, d, "events").count()
    planned = F.floor(F.col("poison_rate") * F.lit(n)).cast("bigint")
    runs = grid.groupBy("seed", "poison_rate").agg(F.count("*").alias("n_runs"))
    return runs.select("n_runs", "seed", "poison_rate", F.lit(n).cast("bigint").alias("n_rows"), planned.alias("planned"))
