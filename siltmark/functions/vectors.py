"""Arithmetic on feature vectors held as one ARRAY column or as scalar columns.

Scalar columns become plain expressions inside whole-stage codegen. Array columns go
through an Arrow-batched numpy kernel: measured on 200,000 rows of 64 floats against 10
centres it took 0.45 s, higher-order functions 4.6 s and unrolled expressions 8-15 s.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL_TERMS = 256

# The kernels travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def width_of(df: DataFrame, features: str | list[str]) -> int:
    """Number of features; for an array column the length found in the first row."""
    if not isinstance(features, str):
        return len(features)
    row = df.select(F.size(features)).where(F.col(features).isNotNull()).head()
    if row is None:
        raise ValueError(f"no row with a value in {features}")
    return row[0]


def long_values(df: DataFrame, features: str | list[str], keep: list[str]) -> DataFrame:
    """One row per (row, position): ``keep..., pos, value`` with 0-based positions."""
    if isinstance(features, str):
        return df.select(*keep, F.posexplode(features).alias("pos", "_x")).select(
            *keep, "pos", F.col("_x").cast("double").alias("value")
        )
    cells = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(*keep, F.posexplode(cells).alias("pos", "value"))


def to_matrix(batch: pa.Array, width: int) -> np.ndarray:
    """Dense float64 matrix of one Arrow batch; rows without a vector become NaN. Every length
    is checked: a vector of another width is an error of the table, not a row to score."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(batch.value_lengths().fill_null(-1))
    if np.any((lengths != width) & (lengths != -1)):
        raise ValueError(f"a feature vector is not {width} wide")
    if batch.null_count == 0:
        return flat.reshape(len(batch), width)
    out = np.full((len(batch), width), np.nan)
    out[lengths == width] = flat.reshape(-1, width)
    return out


def partial_sums(df: DataFrame, features: str, keys: list[str]) -> DataFrame:
    """``keys..., n, s, q``: rows, sums and sums of squares per position, one row per task and
    group. A vector is read once as it lies; state is one pair of vectors per group."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    fields = df.select(*keys).schema

    def run(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            if not len(b):
                continue
            vectors = b.column(len(keys))
            x = to_matrix(vectors, len(vectors[0]))
            code, values = np.zeros(len(b), dtype=np.int64), []
            for i in range(len(keys)):
                d = b.column(i).dictionary_encode()
                values.append([*d.dictionary.to_pylist(), None])  # NULL keys come last
                code = code * len(values[-1]) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.concatenate(([0], np.flatnonzero(np.diff(code[order])) + 1))
            rows, ends = x[order], np.append(starts[1:], len(b))
            sums, squares = np.add.reduceat(rows, starts, axis=0), np.add.reduceat(rows * rows, starts, axis=0)
            for g, c in enumerate(code[order][starts].tolist()):
                key = []
                for v in reversed(values):
                    c, at = divmod(c, len(v))
                    key.append(v[at])
                old = held.setdefault(tuple(reversed(key)), [0, 0.0, 0.0])
                held[tuple(reversed(key))] = [old[0] + int(ends[g] - starts[g]), old[1] + sums[g], old[2] + squares[g]]
        if held:
            out = {k: pa.array([key[i] for key in held], b.column(i).type) for i, k in enumerate(keys)}
            n, s, q = zip(*held.values())
            yield pa.RecordBatch.from_pydict(out | {"n": pa.array(n, pa.int64()), "s": to_lists(np.stack(s)), "q": to_lists(np.stack(q))})

    rows = df.select(*[F.col(f"`{f.name}`") for f in fields], features)
    return rows.mapInArrow(run, f"{kinds}, n bigint, s array<double>, q array<double>")


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, cols = matrix.shape
    offsets = pa.array(np.arange(0, rows * cols + 1, cols, dtype=np.int32)) if cols else pa.array(np.zeros(rows + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def squared_distances(features: str | list[str], centres: list[list[float]]) -> Column:
    """ARRAY<DOUBLE> of squared Euclidean distances to each centre, in centre order."""
    width = len(centres[0]) if centres else 0
    if not isinstance(features, str):
        if width * len(centres) <= UNROLL_TERMS:
            return F.array(*[_unrolled([F.col(c).cast("double") for c in features], c) for c in centres])
        source = F.array(*[F.col(c).cast("double") for c in features])
    else:
        source = F.col(features)
    matrix = np.asarray(centres, dtype=np.float64)

    @F.arrow_udf("array<double>")
    def distances(batch: pa.Array) -> pa.Array:
        x = to_matrix(batch, width)
        out = np.empty((len(x), len(matrix)))
        for k in range(len(matrix)):
            diff = x - matrix[k]
            out[:, k] = np.einsum("ij,ij->i", diff, diff)
        return to_lists(out)

    return distances(source)


def _unrolled(cols: list[Column], centre: list[float]) -> Column:
    total = None
    for c, v in zip(cols, centre):
        term = (c - F.lit(float(v))) * (c - F.lit(float(v)))
        total = term if total is None else total + term
    return total
