"""k-nearest-neighbour label consistency against a trusted set.

A trusted set within ``limit`` rows and TRUSTED_BYTES (a class-balanced buffer always is) goes to
every task as one matrix, and each Arrow batch keeps only its k best: no shuffle, no pair is
emitted. A larger set is compared exactly, block by block, or, with a wanted ``recall`` below 1,
inside random-projection buckets, whose recall is measured on a sample of the candidates before
they are used. Pairs inside a bucket are compared exactly. Every (candidate block, trusted block)
pair is one bounded group that emits k rows per candidate, and a second aggregate merges them.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltmark.functions.sizing import small_side, small_table
from siltmark.functions.vectors import to_matrix, width_of
from siltmark.operators.buckets import LEAF_ROWS, Forest, choose, in_leaves

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRUSTED_LIMIT, TRUSTED_BYTES = 50_000, 256 << 20
BLOCK_ROWS = 20_000
CHUNK = 2_048


def top_k(x: np.ndarray, ids: np.ndarray, trusted: np.ndarray, tids: np.ndarray, tlabels: np.ndarray, k: int):
    """Per row of ``x`` the k nearest trusted rows by (distance, id), the row itself excluded."""
    order = np.argsort(tids, kind="stable")
    trusted, tids, tlabels = trusted[order], tids[order], tlabels[order]
    d2 = np.empty(len(trusted))
    for j in range(len(x)):
        # One row at a time, in pieces of the trusted rows: no matrix of pairs is held.
        for start in range(0, len(trusted), CHUNK):
            diff = trusted[start : start + CHUNK] - x[j]
            np.einsum("ij,ij->i", diff, diff, out=d2[start : start + CHUNK])
        d2[(tids == ids[j]) | ~np.isfinite(d2)] = np.inf
        farthest = np.partition(d2, k - 1)[k - 1] if len(d2) > k else np.inf
        near = np.flatnonzero((d2 <= farthest) & (d2 < np.inf))
        row = near[np.argsort(d2[near], kind="stable")[:k]]
        yield j, d2[row], tids[row], tlabels[row]


def knn_consistency(
    df: DataFrame,
    trusted: DataFrame,
    k: int,
    row_id: str = "row_id",
    label: str = "label",
    features: str = "features",
    limit: int = TRUSTED_LIMIT,
    block_rows: int = BLOCK_ROWS,
    recall: float = 1.0,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``row_id, label, agree, n_neighbours, knn_share``: share of the k nearest trusted rows
    that carry the claimed label. Ties in distance go to the lower trusted id.

    ``recall`` is the share of the true neighbours wanted from a trusted set beyond ``limit``; 1
    compares all blocks. Vectors on which buckets cannot reach it are compared exactly.
    """
    cand = df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), F.col(features).alias("features"))
    ref = trusted.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), F.col(features).alias("features"))
    first = ref.select(F.size("features")).where(F.col("features").isNotNull()).head()
    width = max(1, first[0] if first else 1)
    table = small_table(ref, min(limit, max(1, TRUSTED_BYTES // (8 * width))))
    if table is not None:
        votes = _broadcast_votes(cand, table, k)
    else:
        votes = _votes(cand, nearest_rows(cand, ref, k, block_rows, recall, leaf_rows), k)
    share = F.coalesce(F.try_divide(F.col("agree").cast("double"), F.col("n_neighbours").cast("double")), F.lit(0.0))
    return votes.withColumn("knn_share", share)


def _broadcast_votes(cand: DataFrame, table: pa.Table, k: int) -> DataFrame:
    column = table["features"].combine_chunks()
    width = len(column[0]) if len(column) else 0
    tx = to_matrix(column, width) if width else np.zeros((0, 0))
    tids, tlabels = table["row_id"].to_numpy(), table["label"].to_numpy()
    shared = cand.sparkSession.sparkContext.broadcast((tx, tids, tlabels))

    def vote(batches):
        tx, tids, tlabels = shared.value
        for b in batches:
            ids, labels = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            agree, found = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            if len(tids):
                for j, _, _, near in top_k(to_matrix(b.column(2), tx.shape[1]), ids, tx, tids, tlabels, k):
                    found[j], agree[j] = len(near), int((near == labels[j]).sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(agree), pa.array(found)], names=["row_id", "label", "agree", "n_neighbours"]
            )

    kinds = [cand.schema[c].dataType.simpleString() for c in ("row_id", "label")]
    return cand.mapInArrow(vote, f"row_id {kinds[0]}, label {kinds[1]}, agree bigint, n_neighbours bigint")


def nearest_rows(cand: DataFrame, ref: DataFrame, k: int, block_rows: int = BLOCK_ROWS, recall: float = 1.0, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``row_id, label`` and ``_n``: up to k structs (d2, tid, tlabel) of trusted rows, nearest first."""
    n_cand, n_ref, width = cand.count(), ref.count(), width_of(ref, "features")
    forest = choose(cand, ref, n_cand, n_ref, width, k, recall, leaf_rows) if recall < 1.0 else None
    if forest:
        pairs = _bucket_pairs(cand, ref, width, k, block_rows, forest)
    else:
        pairs = _block_pairs(cand, ref, width, n_cand, n_ref, k, block_rows)
    # k rows per candidate and group, so the list below is short by construction. A pair that
    # meets in several tables counts once.
    near = F.slice(F.sort_array(F.collect_set(F.struct("d2", "tid", "tlabel"))), 1, k)
    return pairs.groupBy("row_id", "label").agg(near.alias("_n"))


def _votes(cand: DataFrame, near: DataFrame, k: int) -> DataFrame:
    votes = near.select(
        "row_id",
        F.size(F.filter("_n", lambda s: s.tlabel == F.col("label"))).cast("bigint").alias("agree"),
        F.size("_n").cast("bigint").alias("n_neighbours"),
    )
    return cand.select("row_id", "label").join(votes, "row_id", "left").fillna(0, ["agree", "n_neighbours"])


def _block(n) -> Column:
    return F.pmod(F.xxhash64("row_id"), n).cast("int")


def _each(n) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _block_pairs(cand: DataFrame, ref: DataFrame, width: int, n_cand: int, n_ref: int, k: int, block_rows: int) -> DataFrame:
    n_c, n_t = (F.lit(max(1, -(-n // block_rows))) for n in (n_cand, n_ref))
    left = cand.withColumn("cb", _block(n_c)).withColumn("tb", _each(n_t))
    right = ref.withColumn("tb", _block(n_t)).withColumn("cb", _each(n_c))
    return _best(left, right, ["cb", "tb"], width, k)


def _bucket_pairs(cand: DataFrame, ref: DataFrame, width: int, k: int, block_rows: int, forest: Forest) -> DataFrame:
    # Of trusted rows with one and the same vector only k can be neighbours, and the own row is none.
    same = Window.partitionBy("features").orderBy("row_id")
    ref = ref.withColumn("_same", F.row_number().over(same)).where(F.col("_same") <= k + 1).drop("_same")
    left, right = in_leaves(cand, forest, forest.n_leaves, width), in_leaves(ref, forest, 1, width)
    # A leaf with very many rows is cut into blocks like the whole set is.
    blocks = lambda rows, name: rows.groupBy("t", "leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    sizes = blocks(left, "n_c").join(blocks(right, "n_t"), ["t", "leaf"])
    sizes = small_side(sizes.select(F.col("t").alias("t_"), F.col("leaf").alias("leaf_"), "n_c", "n_t"))
    at = (F.col("t") == F.col("t_")) & (F.col("leaf") == F.col("leaf_"))
    left = left.join(sizes, at).withColumn("cb", _block(F.col("n_c"))).withColumn("tb", _each(F.col("n_t")))
    right = right.join(sizes, at).withColumn("tb", _block(F.col("n_t"))).withColumn("cb", _each(F.col("n_c")))
    keys = ["t", "leaf", "cb", "tb"]
    return _best(left.select("row_id", "label", "features", *keys), right.select("row_id", "label", "features", *keys), keys, width, k)


def _best(left: DataFrame, right: DataFrame, keys: list[str], width: int, k: int) -> DataFrame:
    """The k nearest rows of ``right`` for every row of ``left`` with equal keys."""
    kinds = [p.schema[c].dataType.simpleString() for p in (left, right) for c in ("row_id", "label")]

    def best(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(lp) and len(rp):
            x, tx = (to_matrix(pa.array(p["features"], pa.list_(pa.float64())), width) for p in (lp, rp))
            ids, labels = lp["row_id"].to_numpy(), lp["label"].to_numpy()
            for j, d, t, near in top_k(x, ids, tx, rp["row_id"].to_numpy(), rp["label"].to_numpy(), k):
                out += [(ids[j], labels[j], float(a), b, c) for a, b, c in zip(d, t, near)]
        return pd.DataFrame(out, columns=["row_id", "label", "d2", "tid", "tlabel"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best, f"row_id {kinds[0]}, label {kinds[1]}, d2 double, tid {kinds[2]}, tlabel {kinds[3]}"
    )
