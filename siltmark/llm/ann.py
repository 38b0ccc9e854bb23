"""Approximate nearest neighbours: an NN-descent graph and greedy graph search, as Spark joins.

Nearness is the largest inner product. Equal vectors share one node, named by their smallest id;
the node keeps its smallest ids, as many as a result can use. The index holds the
original vectors (*codes*: their bytes, in the precision of the column) and scores them in double
precision, so that members of a group of near copies are told apart; leaves and groups are worked
on in ``PARTS`` parts, so that only a part of the copies is on disk at once.

Graph. Nodes first meet in the leaves of random sign trees (large leaves are split by a hash).
Then every round each node takes a sample of its new and old neighbours, and of the nodes that
sampled it, joins their codes, and the members of the group propose each other: neighbours of
neighbours. A node keeps its ``K`` nearest.

Search. A query starts from its own node in the graph, keeps a pool of the nearest nodes seen,
and each round expands the nearest ``EXPAND`` of them that are not yet expanded over the graph's
edges and the strongest reverse edges.

Every group in a task is bounded: leaves by splitting, samples by thinning with the number of
those that sampled, pools and seen lists by the parameters. Rounds are written to the shared
folder.

Defined cases: vectors that are NULL, zero, hold a NULL or non-finite component, or have another
length than most take no part, as rows with a NULL id; repeated rows are candidates each; ties
go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.scratch import scratch_path
from siltmark.llm.workers import task

#: Neighbours of a node, sampled new and old ones each, proposals of a member in one group.
K, SAMPLE, TOP = 30, 12, 4
#: Sign trees, nodes aimed at and allowed in a leaf, proposals of a member in one leaf; rounds.
TREES, LEAF, MAX_LEAF, LEAF_TOP, ROUNDS = 48, 64, 128, 3, 3
#: Search: pool, expanded nodes a round, rounds, reverse edges of a node, candidates of a result (their
#: order in the pool is by exact scores already).
POOL, EXPAND, STEPS, REVERSE, EXACT = 400, 64, 5, 30, 64
#: Parts of a round.
PARTS = 4
#: Rows a task handles at once.
CHUNK = 30_000
#: Queries a task of the search is dealt, and those it handles at once: a state grows to some 200 KB.
QUERIES, BLOCK = 256, 32


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _release(df: DataFrame) -> None:
    """Let the driver forget finished shuffles, so that executors can drop their files."""
    df.sparkSession.sparkContext._jvm.System.gc()


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["d"] if sizes else 0))


def _codes(kind: str):
    """The bytes of a vector after one that tells their width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = bytes([np.dtype(kind).itemsize])
        for batch in batches:
            values = batch.column(batch.schema.names.index("vector"))
            if len(values):
                x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(kind)
                yield pa.RecordBatch.from_pydict({"node": batch.column(batch.schema.names.index("node")), "code": pa.array([head + r.tobytes() for r in x], pa.binary())})

    return run


def _decoded(codes: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    return np.ascontiguousarray(raw[:, 1:]).view(f"<f{raw[0, 0]}").astype(np.float64)


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows come sorted by ``keys``) with the starts of the groups."""
    held, n = [], 0

    def starts(table: pa.Table) -> np.ndarray:
        k = np.stack([table[c].to_numpy() for c in keys], 1)
        return np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1))

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at[:-1]
                held = table.slice(at[-1]).to_batches()
                n = len(table) - int(at[-1])
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _local_join(keys: list[str], top: int):
    """Proposals (p, q, s) among the members of each group: the ``top`` nearest of each member
    that beat its threshold, one of the two being new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _chunks(batches, keys):
            member, fresh, least = (table[c].to_numpy() for c in ("member", "fresh", "least"))
            x = _decoded(table["code"].combine_chunks() if isinstance(table["code"], pa.ChunkedArray) else table["code"])
            sizes = np.diff(np.append(starts, len(table)))
            for some in _by_size(sizes):
                m = int(sizes[some].max())
                if m < 2:
                    continue
                at = starts[some][:, None] + np.arange(m)
                real = np.arange(m) < sizes[some][:, None]
                at = np.where(real, at, 0)
                s = np.matmul(x[at], x[at].transpose(0, 2, 1))
                ids, new = member[at], fresh[at]
                bad = ~real[:, :, None] | ~real[:, None, :] | (ids[:, :, None] == ids[:, None, :]) | ~(new[:, :, None] | new[:, None, :])
                s[bad] = -np.inf
                k = min(top, m - 1)
                best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
                score = np.take_along_axis(s, best, 2)
                keep = (score > least[at][:, :, None]) & np.isfinite(score)
                p = np.broadcast_to(ids[:, :, None], score.shape)[keep]
                q = ids[np.arange(len(ids))[:, None, None], best][keep]
                yield pa.RecordBatch.from_pydict({"p": pa.array(p), "q": pa.array(q), "s": pa.array(score[keep])})

    return run


def _by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of similar size together, so that padding is small and the products are bounded."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + max(1, 4_000_000 // max(1, int(sizes[order[min(len(order) - 1, at + 512)]]) ** 2)), at + 512)
        yield order[at:end]
        at = end


def _nearest(k: int, sample: int, turn: int):
    """The ``k`` nearest of each p; which of them the next round samples (pick 1 new, 2 old)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _chunks(batches, ["p"]):
            p, q, s, state = (table[c].to_numpy() for c in ("p", "q", "s", "state"))
            order = np.lexsort((state, q, p))
            p, q, s, state = p[order], q[order], s[order], state[order]
            first = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
            p, q, s, state = p[first], q[first], s[first], state[first]
            order = np.lexsort((q, -s, p))
            p, q, s, state = p[order], q[order], s[order], state[order]
            kept = _rank(p) < k
            p, q, s, fresh = p[kept], q[kept], s[kept], state[kept] > 0
            h = _hash(p, q, turn)
            order = np.lexsort((h, ~fresh, p))
            # Rank inside (p, fresh): those up to the sample size are picked.
            pick = np.zeros(len(p), np.int32)
            rank = _rank(p[order] * 2 + ~fresh[order])
            pick[order] = np.where(rank < sample, np.where(fresh[order], 1, 2), 0)
            yield pa.RecordBatch.from_pydict({
                "p": pa.array(p), "q": pa.array(q), "s": pa.array(s), "state": pa.array((fresh & (pick != 1)).astype(np.int32)), "pick": pa.array(pick),
            })

    return run


def _rank(sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.append(starts, len(sorted_keys))))


def _hash(p: np.ndarray, q: np.ndarray, turn: int) -> np.ndarray:
    x = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + q.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(turn)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


GRAPH = "p bigint, q bigint, s double, state int, pick int"


def _merged(proposals: DataFrame, graph: DataFrame | None, turn: int) -> DataFrame:
    rows = proposals.select("p", "q", "s", F.lit(2).alias("state"))
    if graph is not None:
        rows = rows.unionByName(graph.select("p", "q", "s", "state"))
    rows = rows.repartition("p").sortWithinPartitions("p")
    return _written(rows.mapInArrow(task(_nearest, K, SAMPLE, turn), GRAPH), f"graph-{turn}")


def _leaves(bits: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            node, code = (batch.column(batch.schema.names.index(c)) for c in ("node", "code"))
            x = _decoded(code)
            if planes is None:
                planes = np.random.default_rng(1).standard_normal((TREES, x.shape[1], bits)).astype(np.float32)
            for t in range(part, TREES, PARTS):
                leaf = ((x @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array(np.full(len(x), t, np.int32)), "leaf": pa.array(leaf.astype(np.int64)), "member": node, "code": code,
                })

    return run


def _in_parts(codes: DataFrame, made, name: str) -> DataFrame:
    """What ``made`` gives for each part, one after another."""
    out = None
    for part in range(PARTS):
        some = _written(made(part), f"{name}-{part}")
        out = some if out is None else out.unionByName(some)
        _release(codes)
    return out


def build(codes: DataFrame) -> DataFrame:
    """Graph rows (p, q, s): the neighbours of every node of ``codes`` (node, code)."""
    bits = max(0, int(np.ceil(np.log2(max(1, codes.count()) / LEAF))))
    keys = ["tree", "leaf", "part"]

    def leaves(part: int) -> DataFrame:
        placed = codes.mapInArrow(task(_leaves, bits, part), "tree int, leaf bigint, member bigint, code binary")
        large = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > MAX_LEAF)
        large = large.select(F.col("tree").alias("t_"), F.col("leaf").alias("l_"), F.ceil(F.col("n") / LEAF).alias("parts"))
        rows = placed.join(large, (F.col("tree") == F.col("t_")) & (F.col("leaf") == F.col("l_")), "left")
        part = F.coalesce(F.pmod(F.xxhash64("member", "tree"), F.col("parts")), F.lit(0).cast("bigint"))
        rows = rows.select("tree", "leaf", part.alias("part"), "member", F.lit(True).alias("fresh"), F.lit(float("-inf")).alias("least"), "code")
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, "member")
        return rows.mapInArrow(task(_local_join, keys, LEAF_TOP), "p bigint, q bigint, s double")

    graph = _merged(_in_parts(codes, leaves, "leaves"), None, 0)
    for turn in range(1, ROUNDS + 1):
        _release(codes)
        least = graph.groupBy(F.col("p").alias("n_")).agg(F.when(F.count("*") >= K, F.min("s")).otherwise(F.lit(float("-inf"))).cast("double").alias("least"))
        known = codes.join(least, F.col("node") == F.col("n_"), "left").select("node", "code", F.coalesce("least", F.lit(float("-inf")).cast("double")).alias("least"))
        picked = graph.where("pick > 0").select("p", "q", (F.col("pick") == 1).alias("fresh"))
        into = picked.groupBy(F.col("q").alias("q_"), F.col("fresh").alias("f_")).agg(F.count("*").alias("n"))
        back = picked.join(into, (F.col("q") == F.col("q_")) & (F.col("fresh") == F.col("f_")))
        chance = F.pmod(F.xxhash64("p", "q", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        back = back.where(chance < F.lit(SAMPLE) / F.col("n")).select(F.col("q").alias("center"), F.col("p").alias("member"), "fresh")
        groups = picked.select(F.col("p").alias("center"), F.col("q").alias("member"), "fresh").unionByName(back)

        def met(part: int, groups: DataFrame = groups, known: DataFrame = known) -> DataFrame:
            rows = groups.where(F.pmod(F.xxhash64("center"), F.lit(PARTS)) == part)
            rows = rows.join(known, F.col("member") == F.col("node")).select("center", "member", "fresh", "least", "code")
            rows = rows.repartition("center").sortWithinPartitions("center", "member")
            return rows.mapInArrow(task(_local_join, ["center"], TOP), "p bigint, q bigint, s double")

        graph = _merged(_in_parts(codes, met, f"proposals-{turn}"), graph, turn)
    return graph.select("p", "q", "s")


def adjacency(graph: DataFrame) -> DataFrame:
    """node and its edges: neighbours and the strongest ``REVERSE`` nodes that have it as one."""
    strongest = F.slice(F.sort_array(F.collect_list(F.struct("s", F.col("p").alias("v"))), asc=False), 1, REVERSE)
    parts = graph.groupBy("q", F.pmod(F.xxhash64("p"), F.lit(64)).alias("salt")).agg(strongest.alias("x"))
    back = parts.groupBy(F.col("q").alias("n_")).agg(F.flatten(F.collect_list("x")).alias("x"))
    back = back.select("n_", F.slice(F.sort_array("x", asc=False), 1, REVERSE).alias("x")).select("n_", F.transform("x", lambda e: e["v"]).alias("back"))
    out = graph.groupBy(F.col("p").alias("node")).agg(F.collect_list("q").alias("out"))
    both = out.join(back, F.col("node") == F.col("n_"), "full_outer")
    none = F.array().cast("array<bigint>")
    return both.select(F.coalesce("node", "n_").alias("node"), F.array_union(F.coalesce("out", none), F.coalesce("back", none)).alias("edges"))


# Search. The state of a query is one row: its pool (nearest first), which of it is expanded,
# and the ids it has met.


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, node, code of the query) not yet met, from a query's state and its frontier's edges;
    about ``CHUNK`` rows are held at once, however many queries a batch has."""

    def rows(batch: pa.RecordBatch, at: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        of = pa.array(np.repeat(at, [len(f) for f in found]))
        q, code = (batch.column(batch.schema.names.index(c)).take(of) for c in ("query", "qcode"))
        return pa.RecordBatch.from_pydict({"query": q, "node": pa.array(np.concatenate(found)), "qcode": code})

    for batch in batches:
        met, edges = (batch.column(batch.schema.names.index(c)) for c in ("met", "edges"))
        at, found, n = [], [], 0
        for i in range(len(batch)):
            reached = np.unique(edges[i].values.flatten().to_numpy())
            reached = reached[~np.isin(reached, met[i].values.to_numpy(), assume_unique=True)]
            at.append(i)
            found.append(reached)
            n += len(reached)
            if n >= CHUNK:
                yield rows(batch, at, found)
                at, found, n = [], [], 0
        if n:
            yield rows(batch, at, found)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            q, n, a, b = (batch.column(batch.schema.names.index(c)) for c in ("query", "node", "qcode", "code"))
            s = np.einsum("nd,nd->n", _decoded(a), _decoded(b))
            yield pa.RecordBatch.from_pydict({"query": q, "node": n, "s": pa.array(s)})


STATE = "query bigint, qcode binary, pool array<bigint>, score array<double>, done array<boolean>, met array<bigint>"
_STATE = pa.schema([
    ("query", pa.int64()), ("qcode", pa.binary()), ("pool", pa.list_(pa.int64())), ("score", pa.list_(pa.float64())), ("done", pa.list_(pa.bool_())),
    ("met", pa.list_(pa.int64())),
])


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the scored nodes of a round into the pools; what was expanded is done. ``BLOCK`` queries
    are held at once."""

    def lists(values: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)], dtype=np.int32), pa.array(np.concatenate(values)))

    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            some = batch.slice(start, BLOCK)
            cells = {c: some.column(some.schema.names.index(c)) for c in some.schema.names}
            out = {c: [] for c in ("pool", "score", "done", "met")}
            for i in range(len(some)):
                pool, score, done, met = (cells[c][i].values.to_numpy(zero_copy_only=False) for c in out)
                new = cells["found"][i].values
                nodes, scores = (np.empty(0, np.int64), np.empty(0)) if new is None else (new.field(f).to_numpy() for f in ("node", "s"))
                ids, score = np.concatenate([pool, nodes]), np.concatenate([score, scores])
                done = np.concatenate([done, np.zeros(len(nodes), bool)])
                done[np.flatnonzero(~done[: len(pool)])[:EXPAND]] = True
                order = np.lexsort((ids, -score))[:POOL]
                for c, x in zip(out, (ids[order], score[order], done[order], np.union1d(met, nodes)), strict=True):
                    out[c].append(x)
            if len(some):
                yield pa.RecordBatch.from_arrays([cells["query"], cells["qcode"], *map(lists, out.values())], schema=_STATE)


def search(queries: DataFrame, codes: DataFrame, edges: DataFrame) -> DataFrame:
    """query (a node) and its pool of nodes, nearest first."""
    own = codes.join(queries.select(F.col("node").alias("n_")), F.col("node") == F.col("n_"), "left_semi")
    one = lambda x, kind: F.array(x).cast(kind)
    # So many partitions that the states of one fit a worker, and no more than fill one with a block.
    n_own = own.count()
    n = max(1, -(-n_own // QUERIES), min(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_own // BLOCK)))
    state = own.select(
        F.col("node").alias("query"), F.col("code").alias("qcode"), one("node", "array<bigint>").alias("pool"),
        one(F.lit(float("inf")), "array<double>").alias("score"), one(F.lit(False), "array<boolean>").alias("done"), one("node", "array<bigint>").alias("met"),
    )
    for step in range(STEPS + 1):
        open_ = F.filter(F.arrays_zip("pool", "done"), lambda x: ~x["done"])
        front = state.select("query", F.explode(F.slice(F.transform(open_, lambda x: x["pool"]), 1, EXPAND)).alias("at"))
        reached = front.join(edges, F.col("at") == F.col("node")).select(F.col("query").alias("q_"), "edges").repartition(n, "q_")
        reached = reached.groupBy("q_").agg(F.collect_list("edges").alias("edges"))
        dealt = state.repartition(n, "query")
        grown = dealt.join(reached, F.col("query") == F.col("q_")).select("query", "qcode", "met", "edges")
        found = grown.mapInArrow(task(_candidates), "query bigint, node bigint, qcode binary")
        coded = codes.select(F.col("node").alias("c_"), "code")
        scored = found.join(coded, F.col("node") == F.col("c_")).select("query", "node", "qcode", "code").mapInArrow(task(_scores), "query bigint, node bigint, s double")
        scored = scored.withColumnRenamed("query", "q_").repartition(n, "q_").groupBy("q_").agg(F.collect_list(F.struct("node", "s")).alias("found"))
        state = dealt.join(scored, F.col("query") == F.col("q_"), "left").drop("q_").mapInArrow(task(_advance), STATE)
        state = _written(state, f"search-{step}")
        _release(codes)
    return state.select("query", "pool")


def nearest(df: DataFrame, wanted, n: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``n`` nearest found of every row where ``wanted``
    (a function of the id column) holds, its own row excluded."""
    rows = _written(usable(df, vec_id, vector), "vectors")
    named = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(7), "vector"))
    nodes = _written(named.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.any_value("vector").alias("vector")), "nodes")
    kind = "<f4" if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else "<f8"
    codes = _written(nodes.select("node", "vector").mapInArrow(task(_codes, kind), "node bigint, code binary"), "codes")
    edges = _written(adjacency(build(codes)), "edges")
    keys = nodes.select(F.col("h1").alias("a_"), F.col("h2").alias("b_"), "node")
    owned = _written(named.select("vec_id", "h1", "h2").join(keys, (F.col("h1") == F.col("a_")) & (F.col("h2") == F.col("b_"))).select("vec_id", "node"), "owned")
    asked = owned.where(wanted(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    pools = search(asked.select(F.col("query").alias("node")).distinct(), codes, edges)
    pairs = pools.select("query", F.explode(F.slice(F.array_union(F.array("query"), "pool"), 1, max(EXACT, n + 1))).alias("node"))
    exact = nodes.select(F.col("node").alias("n_"), "vector")
    pairs = pairs.join(exact, F.col("node") == F.col("n_")).select("query", "node", F.col("vector").alias("b"))
    pairs = pairs.join(exact, F.col("query") == F.col("n_")).select("query", "node", F.col("vector").alias("a"), "b")
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = pairs.select("query", "node", score.alias("score"))
    # The smallest ids of each node, by a salted top list; n + 1 are enough besides the query's own.
    few = F.slice(F.sort_array(F.collect_list("vec_id")), 1, n + 1)
    some = owned.groupBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(few.alias("x"))
    ids = some.groupBy(F.col("node").alias("n_")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, n + 1).alias("ids"))
    listed = scored.join(ids, F.col("node") == F.col("n_")).select("query", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    listed = listed.withColumn("k", best).where(F.col("k") <= n + 1).select("query", "score", "vec_id")
    lists = listed.groupBy(F.col("query").alias("q_")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id", "score"))).alias("x"))
    out = asked.join(lists, F.col("query") == F.col("q_")).select("query_id", F.filter("x", lambda e: e["vec_id"] != F.col("query_id")).alias("x"))
    out = out.select("query_id", F.posexplode(F.slice("x", 1, n)).alias("k", "e"))
    return out.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
