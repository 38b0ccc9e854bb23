"""Random-projection buckets: which trusted rows a candidate has to be compared with.

A table is a tree of ``depth`` levels. Every level has one random direction and every node a
cut, the median of the projections that reach it in a sample of the trusted rows, so that leaves
hold about equally many rows however the vectors lie. A candidate looks into its own leaf and
into the leaves reached by leaving the path where its projection lies closest to a cut.

The number of tables and leaves is not guessed: the exact neighbours of a sample of candidates
are found in one scan, and the cheapest setting whose buckets hold the wanted share of them is
taken. Vectors without structure may need so many leaves that comparing everything is cheaper;
then there is no forest, and the caller compares everything.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltmark.functions.vectors import to_matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Trusted rows that place the cuts and candidates that measure recall, at most (both documented samples).
CUT_ROWS, RECALL_ROWS = 1 << 14, 256
LEAF_ROWS = 4_096
#: Rows of a batch that deals rows to leaves.
DEALT_ROWS = 1 << 13
#: Sample rows a leaf needs at least for its cut to be a median.
ROWS_A_CUT = 8
#: Tables and leaves per table, cheapest first.
SETTINGS = ((2, 1), (4, 2), (4, 6), (8, 8), (8, 24))


@dataclass(frozen=True)
class Forest:
    """``directions`` are (table, level, dimension), ``cuts`` (table, node) with the root at 1."""

    directions: np.ndarray
    cuts: np.ndarray
    n_leaves: int = 1

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def limited(self, n_tables: int, n_leaves: int) -> Forest:
        return Forest(self.directions[:n_tables], self.cuts[:n_tables], n_leaves)

    def _walk(self, t: int, p: np.ndarray, flips: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Leaf per row, and the distance to the cut at every level. ``flips`` marks levels to leave the path at."""
        node, margin = np.ones(len(p), dtype=np.int64), np.zeros(p.shape)
        for level in range(self.depth):
            margin[:, level] = p[:, level] - self.cuts[t, node]
            right = margin[:, level] > 0
            node = 2 * node + (right if flips is None else right ^ flips[:, level])
        return node - (1 << self.depth), np.abs(margin)

    def leaves(self, x: np.ndarray, n_leaves: int) -> np.ndarray:
        """(row, table, probe): the leaves to look into, the row's own first. All are different."""
        levels = range(self.depth)
        sets = [(), *[(i,) for i in levels], *combinations(levels, 2)]
        masks = np.array([[i in s for i in levels] for s in sets], dtype=bool).reshape(len(sets), self.depth)
        n = min(n_leaves, len(masks))
        out = np.zeros((len(x), len(self.directions), n), dtype=np.int32)
        for t in range(len(self.directions)):
            p = x @ self.directions[t].T
            own, margin = self._walk(t, p)
            out[:, t, 0] = own
            if n > 1:
                order = np.argsort(np.square(margin) @ masks.T, axis=1, kind="stable")
                for j in range(1, n):
                    out[:, t, j] = self._walk(t, p, masks[order[:, j]])[0]
        return out


def plant(sample: np.ndarray, n_rows: int, n_tables: int, leaf_rows: int = LEAF_ROWS, seed: int = 0) -> Forest:
    """Trees over ``sample``, deep enough for leaves of ``leaf_rows`` of ``n_rows`` rows."""
    wanted = max(0, int(np.ceil(np.log2(max(1, n_rows) / leaf_rows))))
    depth = min(wanted, max(0, int(np.log2(max(1, len(sample)) / ROWS_A_CUT))))
    directions = np.random.default_rng(seed).standard_normal((n_tables, depth, sample.shape[1]))
    cuts = np.zeros((n_tables, 1 << depth))
    for t in range(n_tables):
        p, node = sample @ directions[t].T, np.ones(len(sample), dtype=np.int64)
        for level in range(depth):
            for i in range(1 << level, 2 << level):
                here = p[node == i, level]
                cuts[t, i] = np.median(here) if len(here) else 0.0
            node = 2 * node + (p[:, level] > cuts[t, node])
    return Forest(directions, cuts)


def _sample(df: DataFrame, n_rows: int, at_most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``at_most`` rows, chosen by a hash of the id."""
    parts = 1 << 20
    share = min(parts, int(np.ceil(0.9 * parts * at_most / max(1, n_rows))))
    rows = df.where(F.pmod(F.xxhash64(F.lit(97), "row_id"), F.lit(parts)) < share).select("row_id", "features").limit(at_most)
    got = rows.toArrow()
    x = to_matrix(got["features"].combine_chunks(), width)
    fine = np.isfinite(x).all(axis=1)
    return got["row_id"].to_numpy()[fine], x[fine]


def exact_of_sample(ref: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """(query, vector) of the k nearest trusted rows of every sampled candidate: one scan, k rows
    per candidate and task."""
    shared = ref.sparkSession.sparkContext.broadcast((ids, x))
    kind = ref.schema["row_id"].dataType.simpleString()

    def nearest(batches):
        ids, x = shared.value
        norms = np.einsum("ij,ij->i", x, x)
        for b in batches:
            if not len(b):
                continue
            y = to_matrix(b.column(1), x.shape[1])
            d2 = norms[:, None] - 2.0 * (x @ y.T) + np.einsum("ij,ij->i", y, y)[None, :]
            own = b.column(0).to_numpy(zero_copy_only=False)
            d2[(ids[:, None] == own[None, :]) | ~np.isfinite(d2)] = np.inf
            n = min(k, len(b))
            best = np.argpartition(d2, n - 1, axis=1)[:, :n]
            query, at = np.repeat(np.arange(len(x)), n), best.ravel()
            found = np.isfinite(d2[query, at])
            query, at = query[found], at[found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(d2[query, at]), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))],
                names=["q", "d2", "row_id", "features"],
            )

    vectors = ref.schema["features"].dataType.simpleString()
    near = ref.select("row_id", "features").mapInArrow(nearest, f"q int, d2 double, row_id {kind}, features {vectors}")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "row_id"))
    got = near.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "features").toArrow()
    return got["q"].to_numpy(), to_matrix(got["features"].combine_chunks(), x.shape[1])


def recall_of(forest: Forest, x: np.ndarray, query: np.ndarray, near: np.ndarray) -> float:
    """Share of the exact neighbours that share a searched leaf with their candidate."""
    looked, own = forest.leaves(x, forest.n_leaves)[query], forest.leaves(near, 1)
    return float((looked == own).any(axis=(1, 2)).mean()) if len(query) else 1.0


def choose(cand: DataFrame, ref: DataFrame, n_cand: int, n_ref: int, width: int, k: int, recall: float, leaf_rows: int = LEAF_ROWS) -> Forest | None:
    """The cheapest forest whose recall is above ``recall`` by two standard errors of the sample."""
    _, base = _sample(ref, n_ref, CUT_ROWS, width)
    ids, x = _sample(cand, n_cand, RECALL_ROWS, width)
    if not len(base) or not len(x):
        return None
    full = plant(base, n_ref, max(t for t, _ in SETTINGS), leaf_rows)
    query, near = exact_of_sample(ref, ids, x, k)
    for n_tables, n_leaves in SETTINGS:
        forest = full.limited(n_tables, n_leaves)
        if n_tables * n_leaves >= 1 << forest.depth:
            return None  # as much work as comparing everything
        found = recall_of(forest, x, query, near)
        if found - 2.0 * np.sqrt(found * (1.0 - found) / max(1, len(query))) >= recall:
            return forest
    return None


def in_leaves(df: DataFrame, forest: Forest, n_leaves: int, width: int) -> DataFrame:
    """A row per table and leaf looked into: the columns of ``df``, ``t`` and ``leaf``."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    at = df.columns.index("features")

    def deal(batches):
        forest = shared.value
        for b in batches:
            if not len(b):
                continue
            # A row is repeated for every leaf: few rows at a time, so that what is held stays small.
            step = max(1, DEALT_ROWS // (len(forest.directions) * n_leaves))
            for start in range(0, len(b), step):
                part = b.slice(start, step)
                found = forest.leaves(to_matrix(part.column(at), width), n_leaves)
                _, n_tables, n = found.shape
                rows = np.repeat(np.arange(len(part)), n_tables * n)
                t = np.tile(np.repeat(np.arange(n_tables, dtype=np.int32), n), len(part))
                columns = [c.take(pa.array(rows)) for c in part.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(t), pa.array(found.ravel())], names=[*part.schema.names, "t", "leaf"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(deal, f"{kinds}, t int, leaf int")
