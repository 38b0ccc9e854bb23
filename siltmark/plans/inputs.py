"""The given tables in the roles the queries use, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.hashing import content_key

SEED = 11
TAU = 0.05
TASKS = {1: [0, 1, 2, 3], 2: [4, 5], 3: [6, 7]}
TWO_TASKS = {1: [0, 1, 2, 3, 4], 2: [5, 6, 7]}
FLOW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"), F.col("label")
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as numeric flows with a content id; whole rows are unique."""
    return table(spark, sf_dir, "lineitem").select(
        content_key(LINE_COLUMNS).alias("row_id"), *FLOW_FEATURES, F.col("l_returnflag").alias("label"), "l_orderkey", "l_partkey", "l_suppkey"
    )


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with gaps punched by key arithmetic: NULL, NaN and infinite cells."""
    return flows(spark, sf_dir).withColumns(
        {
            "l_discount": F.when(F.col("l_partkey") % 89 != 0, F.col("l_discount")),
            "l_tax": F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")),
            "l_extendedprice": F.when(F.col("l_suppkey") % 53 == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")),
        }
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("label"), "value", "ts"
    )


# SQL fragments


def sql_key(salt: str, row_id: str = "row_id", seed: int = SEED) -> str:
    return f"md5(concat_ws(':', '{salt}', '{seed}', CAST({row_id} AS VARCHAR)))"


def sql_int(key: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr({key}, 1, {digits}) AS BIGINT)"


def sql_split(row_id: str = "row_id", seed: int = SEED) -> str:
    slot = f"{sql_int(sql_key('split', row_id, seed))} % 10000"
    return f"CASE WHEN {slot} < 7000 THEN 'train' WHEN {slot} < 8000 THEN 'val' ELSE 'test' END"


SQL_EMB = "emb AS (SELECT vec_id AS row_id, label, embedding::DOUBLE[] AS f FROM embeddings)"
SQL_SIDED = f"{SQL_EMB}, sided AS (SELECT *, {sql_split()} AS split FROM emb)"
SQL_LINE_KEY = "md5(concat_ws('|', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '\\N')" for c in LINE_COLUMNS) + "))"
SQL_FLOWS = (
    f"flows AS (SELECT {SQL_LINE_KEY} AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag AS label, l_orderkey, l_partkey, l_suppkey FROM lineitem)"
)
SQL_DIRTY = (
    f"{SQL_FLOWS}, dirty AS (SELECT row_id, l_quantity, "
    "CASE WHEN l_suppkey % 53 = 0 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END AS l_extendedprice, "
    "CASE WHEN l_partkey % 89 <> 0 THEN l_discount END AS l_discount, "
    "CASE WHEN l_orderkey % 97 = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS l_tax, label FROM flows)"
)
SQL_EVENTS = "ev AS (SELECT event_id AS row_id, event_type AS label, value, ts FROM events)"


def sql_tasks(tasks: dict) -> str:
    pairs = ", ".join(f"({t}, {c})" for t, cs in tasks.items() for c in cs)
    return f"task_classes AS (SELECT * FROM (VALUES {pairs}) AS v(task_id, class_id))"


def sql_proto(name: str, source: str, label: str = "label") -> str:
    """CTE ``name(class_id, n, c)``: class means of the vectors in ``source``."""
    return (
        f"{name}_v AS (SELECT row_id, {label} AS class_id, unnest(f) AS v, generate_subscripts(f, 1) AS pos FROM {source}), "
        f"{name} AS (SELECT class_id, max(n) AS n, list(m ORDER BY pos) AS c FROM "
        f"(SELECT class_id, pos, avg(v) AS m, count(*) AS n FROM {name}_v GROUP BY ALL) GROUP BY class_id)"
    )


def sql_score(name: str, source: str, proto: str, tau: float = TAU) -> str:
    """CTEs ``name`` (one row per row and class: d2, prob) and ``name_best`` (prediction)."""
    return (
        f"{name}_d AS (SELECT r.*, p.class_id, power(list_distance(r.f, p.c), 2) AS d2 FROM {source} r CROSS JOIN {proto} p), "
        f"{name}_e AS (SELECT *, exp((min(d2) OVER (PARTITION BY row_id) - d2) / {tau}) AS e FROM {name}_d), "
        f"{name} AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS prob FROM {name}_e), "
        f"{name}_best AS (SELECT * EXCLUDE (rn, class_id, prob, d2, e), class_id AS pred, prob AS max_prob, d2 AS pred_d2 FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, class_id) AS rn FROM {name}) WHERE rn = 1)"
    )


def sql_lowest(source: str, k: str, salt: str, group: str | None = "label", seed: int = SEED) -> str:
    part = f"PARTITION BY {group} " if group else ""
    return (
        f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({part}ORDER BY {sql_key(salt, 'row_id', seed)}, row_id) AS rn "
        f"FROM {source}) WHERE rn <= {k})"
    )
