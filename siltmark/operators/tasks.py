"""Class-disjoint tasks, class-balanced replay buffers and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.sizing import small_side
from siltmark.operators.selection import select_lowest

REPLAY_CAP = 50
REPLAY_SALT = "replay"
STRATEGIES = ("finetune", "replay")


def task_classes_df(spark: SparkSession, tasks: dict[int, list], label_type: str = "int") -> DataFrame:
    """The (task_id, class_id) table; a class may belong to one task only."""
    rows = [(int(t), c) for t, classes in tasks.items() for c in classes]
    if len({c for _, c in rows}) != len(rows):
        raise ValueError("tasks must have disjoint classes")
    return spark.createDataFrame(rows, f"task_id int, class_id {label_type}")


def make_tasks(df: DataFrame, task_classes: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(rows with task_id, rows of classes in no task)``. Broadcast joins, no shuffle."""
    classes = small_side(task_classes)
    tasked = df.join(classes, F.col(label) == F.col("class_id")).drop("class_id")
    holdout = df.join(classes, F.col(label) == F.col("class_id"), "left_anti")
    return tasked, holdout


def task_manifest(tasked: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """Classes, row count and seed per task and split; classes are pre-counted first."""
    per_class = tasked.groupBy("task_id", "split", label).agg(F.count("*").alias("n"))
    return per_class.groupBy("task_id", "split").agg(
        F.sort_array(F.collect_set(label)).alias("classes"),
        F.sum("n").alias("n_rows"),
        F.lit(seed).alias("seed"),
    )


def replay_buffer(df: DataFrame, cap: int = REPLAY_CAP, seed: int = 0, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """The ``cap`` lowest rows per class by seeded key, with ties broken by id."""
    return select_lowest(df, cap, seed, REPLAY_SALT, row_id, [label])


def merge_buffer(
    buffer: DataFrame, new: DataFrame, cap: int = REPLAY_CAP, seed: int = 0, row_id: str = "row_id", label: str = "label"
) -> DataFrame:
    """Buffer of the union. Bottom-k is associative, so only the candidates of ``new`` meet
    the buffer: the merge handles at most 2 * cap rows per class. An id that returns keeps its
    row in the buffer."""
    fresh = replay_buffer(new, cap, seed, row_id, label)
    aged = lambda df, age: df.withColumn("_age", F.lit(age))
    both = one_per_id(aged(buffer, 0).unionByName(aged(fresh, 1), allowMissingColumns=True), row_id, ["_age", label])
    return replay_buffer(both.drop("_age"), cap, seed, row_id, label)


def one_per_id(df: DataFrame, row_id: str = "row_id", order: list[str] | None = None) -> DataFrame:
    """The first row of each id by ``order``, then by content: the same however often it runs."""
    first = F.struct(*(order or []), F.xxhash64(*df.columns).alias("_content"))
    return df.groupBy(F.col(row_id).alias("_id")).agg(F.min_by(F.struct(*df.columns), first).alias("_row")).select("_row.*")


def training_set(
    tasked: DataFrame,
    task: int,
    strategy: str,
    cap: int = REPLAY_CAP,
    seed: int = 0,
    row_id: str = "row_id",
    label: str = "label",
) -> DataFrame:
    """Rows to fit on at ``task``; ``origin`` says current or replay."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    current = tasked.where(F.col("task_id") == task).withColumn("origin", F.lit("current"))
    if strategy == "finetune":
        return current
    past = replay_buffer(tasked.where(F.col("task_id") < task), cap, seed, row_id, label)
    return current.unionByName(past.withColumn("origin", F.lit("replay")))


def poison_persistence(buffers: DataFrame, log: DataFrame, row_id: str = "row_id", versions: list[int] | None = None) -> DataFrame:
    """Poisoned share of every buffer version: ``buffer_version, n_rows, n_poisoned, share``.

    A version that holds no row is not seen in ``buffers``; one that is named in ``versions`` comes
    with zero rows and no share. Buffers are small and the log may not be, so the log is first
    reduced to buffered ids.
    """
    members = small_side(buffers.select(F.col(row_id).alias("_m")).distinct())
    marked = log.join(members, F.col(row_id) == F.col("_m"), "left_semi").select(F.col(row_id).alias("_id")).distinct()
    joined = buffers.join(small_side(marked.withColumn("_p", F.lit(1))), F.col(row_id) == F.col("_id"), "left")
    found = joined.groupBy("buffer_version").agg(
        F.count("*").alias("n_rows"),
        F.count("_p").alias("n_poisoned"),
        F.avg(F.coalesce(F.col("_p"), F.lit(0)).cast("double")).alias("share"),
    )
    if versions is None:
        return found
    wanted = buffers.sparkSession.createDataFrame([(int(v),) for v in versions], "_v int")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_rows", "n_poisoned")]
    return wanted.join(found, F.col("_v") == F.col("buffer_version"), "left").select(F.col("_v").alias("buffer_version"), *counts, "share")
