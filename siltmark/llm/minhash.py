"""Near-duplicate components by an inverted join of MinHash signature coordinates.

1. Every text becomes its set of five-word shingles (64-bit hashes); texts with equal sets
   collapse to one node, named by the smallest id.
2. Every node posts each of its ``COORDS`` signature coordinates as a (coordinate, value) pair.
   Pairs that one node alone posts cannot collide. A node keeps its *prefix*: the rarest
   ``COORDS - MATCHES + 1`` coordinates, counting those single ones. Two nodes that agree on
   ``MATCHES`` coordinates share a pair in their prefixes, so the long lists are skipped.
3. Lists with the same members are merged to one. A list is worked on in blocks of at most
   ``BLOCK`` members a side, so none meets in one task. Inside a block collisions are counted on
   the whole signature of ``FINE`` coordinates (four bits each).
4. Two passes. In the first, each node proposes only its best connected neighbour of a list,
   which links large groups at a cost in proportion to their size. In the second, with components
   known, pairs over the match threshold *between different components* are proposed, each once
   (in the first list the two share). Proposals are confirmed on the full sets.

Two nodes with a similarity of exactly 0.75 have fewer than ``MATCHES`` of 64 equal coordinates, or
fewer than ``FINE_MATCHES`` of 512 of four bits, with a chance of about 5e-5 (binomial; every coordinate
mixes all 64 bits of a shingle, so that it holds for sets of a few shingles too). Confirmed links are exact.

Defined cases: NULL, empty and blank texts have an empty set and are linked with nothing; fewer
than five words make one shingle; a NULL id is its own component, kept; rows that share an id
are documents of their own; repeated rows share a set; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.llm.workers import task

SHINGLE, PERCENT = 5, 75
COORDS, MATCHES = 64, 32
FINE, FINE_MATCHES = 512, 354
BLOCK = 2048

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(n: int, stream: int) -> np.ndarray:
    return _mix((np.arange(n, dtype=np.uint64) + np.uint64(1 + stream * 1_000_003)) * _ODD)


#: One seed per coordinate: its hash function mixes all bits of a shingle plus the seed.
_COORD_SEEDS = _seeds(FINE, 3)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode().translate(_LOWER).split()  # splits at the blanks 9 to 13 and 32
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h[:SHINGLE]), np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mix(out * _ODD + h[k : k + n])
    return np.unique(out)


def set_hashes(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order, as two signed integers."""
    a, b = _mix(found + _ODD).sum(dtype=np.uint64), _mix(found ^ _ODD).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signature(found: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of the first ``n`` hash functions (of a set that is not empty)."""
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 512):
        x = _mix(found[None, at : at + 512] + _COORD_SEEDS[:n, None])
        np.minimum(least, (x >> np.uint64(32)).min(1).astype(np.uint32), out=least)
    return least


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, sig = [], [], [], []
        for v in batch.column(1):
            found = shingles(v.as_py() or "")
            a, b = set_hashes(found)
            n.append(len(found))
            h1.append(a)
            h2.append(b)
            sig.append(signature(found, COORDS).astype("<u4").view("<i4") if len(found) else None)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()),
            "sig": pa.array(sig, pa.list_(pa.int32())),
        })


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for node, text, a, b in zip(*[batch.column(batch.schema.names.index(c)) for c in ("node", "text", "h1", "h2")]):
            found = shingles(text.as_py() or "")
            if set_hashes(found) == (a.as_py(), b.as_py()):  # else another row with this id
                s = signature(found, FINE)
                low = (s[0::2] & np.uint32(15)) | ((s[1::2] & np.uint32(15)) << np.uint32(4))
                rows.append((node.as_py(), found.view(np.int64), s[:COORDS].astype("<u4").tobytes(), low.astype(np.uint8).tobytes()))
                held += found.nbytes
            if held > 1 << 23:
                yield _fine_batch(rows)
                rows, held = [], 0
        if rows:
            yield _fine_batch(rows)


def _fine_batch(rows: list[tuple]) -> pa.RecordBatch:
    node, found, coarse, fine = zip(*rows)
    return pa.RecordBatch.from_pydict({
        "node": pa.array(node, pa.int64()), "shingles": pa.array(found, pa.list_(pa.int64())), "coarse": pa.array(coarse, pa.binary()),
        "fine": pa.array(fine, pa.binary()),
    })


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """node, c, v, size and mask: the kept prefix postings, and the coordinates each node kept."""
    posted = nodes.select("node", F.posexplode("sig").alias("c", "v"))
    sizes = posted.groupBy("c", "v").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select(F.col("c").alias("c_"), F.col("v").alias("v_"), "size")
    shared = posted.join(sizes, (F.col("c") == F.col("c_")) & (F.col("v") == F.col("v_")))
    order = F.sort_array(F.collect_list(F.struct("size", F.xxhash64("c", "v").alias("h"), "c", "v")))
    mine = shared.groupBy("node").agg(order.alias("x")).where(F.size("x") >= MATCHES)
    kept = mine.select("node", F.inline(F.slice("x", 1, F.size("x") - MATCHES + 1))).select("node", "c", "v")
    kept = _written(kept, "prefixes")
    member = lambda seed: F.sum((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "node"), 20)).cast("bigint"))
    lists = kept.groupBy("c", "v").agg(F.count("*").alias("size"), member(1).alias("m1"), member(2).alias("m2")).where("size > 1")
    lists = lists.groupBy("size", "m1", "m2").agg(F.min(F.struct("c", "v")).alias("one")).select("size", F.col("one.c").alias("c_"), F.col("one.v").alias("v_"))
    kept = kept.join(lists, (F.col("c") == F.col("c_")) & (F.col("v") == F.col("v_"))).select("node", "c", "v", "size")
    return _written(kept, "lists")


def _equal_fine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal four-bit coordinates of each pair of rows."""
    x = a[:, None, :] ^ b[None, :, :]
    return ((x & 15) == 0).sum(2, dtype=np.uint16) + (x < 16).sum(2, dtype=np.uint16)


def _proposed(first_pass: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs(batches, first_pass)

    return run


def _pairs(batches: Iterator[pa.RecordBatch], first_pass: bool = False) -> Iterator[pa.RecordBatch]:
    """Proposals of each block. Rows come sorted by block; a block may span batches."""
    key, parts = None, []
    names = ["node", "c", "v", "i", "j", "side", "component", "mask", "coarse", "fine"]
    for batch in batches:
        cols = [batch.column(batch.schema.names.index(n)) for n in names]
        keys = np.stack([c.to_numpy(zero_copy_only=False) for c in cols[1:5]], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if key is not None and tuple(keys[a]) != key:
                yield from _block(key, parts, first_pass)
                parts = []
            key = tuple(keys[a])
            parts.append([c.slice(a, b - a) for c in cols])
    if parts:
        yield from _block(key, parts, first_pass)


def _block(key: tuple, parts: list, first_pass: bool) -> Iterator[pa.RecordBatch]:
    joined = [pa.concat_arrays([p[k] for p in parts]) for k in range(len(parts[0]))]
    node, side, component, mask = (joined[k].to_numpy(zero_copy_only=False) for k in (0, 5, 6, 7))
    bits = lambda k, dtype: np.frombuffer(b"".join(joined[k].to_pylist()), dtype).reshape(len(node), -1)
    coarse, fine = bits(8, "<u4"), bits(9, np.uint8)
    c, _, i, j = key
    left = np.flatnonzero(side == i)
    right = left if i == j else np.flatnonzero(side == j)
    best_degree, best = np.zeros(len(node), np.int64), np.arange(len(node))
    out_a, out_b = [], []
    below = mask & np.int64((1 << int(c)) - 1)
    degree = np.zeros(len(node), np.int64)
    step = max(1, (1 << 22) // max(1, len(right) * fine.shape[1]))

    def near(rows: np.ndarray) -> np.ndarray:
        return (_equal_fine(fine[rows], fine[right]) >= FINE_MATCHES) & (node[rows][:, None] != node[right][None, :])

    chunks = [left[k : k + step] for k in range(0, len(left), step)]
    if first_pass:
        found = [near(rows) for rows in chunks]
        for rows, hit in zip(chunks, found):
            np.add.at(degree, rows, hit.sum(1))
            if i != j:
                degree[right] += hit.sum(0)
        for rows, hit in zip(chunks, found):
            for one, other, h in ((rows, right, hit), *([(right, rows, hit.T)] if i != j else [])):
                if not h.size:
                    continue
                score = np.where(h, degree[other][None, :], -1)
                at = score.argmax(1)
                top = score[np.arange(len(one)), at]
                better = top > best_degree[one]
                best_degree[one[better]], best[one[better]] = top[better], other[at[better]]
        a = np.flatnonzero(best != np.arange(len(node)))
        out_a, out_b = [node[a]], [node[best[a]]]
    else:
        for rows in chunks:
            hit = near(rows) & (component[rows][:, None] != component[right][None, :])
            x, y = np.nonzero(hit)
            x, y = rows[x], right[y]
            if i == j:
                x, y = x[node[x] < node[y]], y[node[x] < node[y]]
            shared = below[x] & below[y]
            for k in range(int(c)):  # only in the first list that both kept
                earlier = ((shared >> np.int64(k)) & 1).astype(bool) & (coarse[x, k] == coarse[y, k])
                x, y, shared = x[~earlier], y[~earlier], shared[~earlier]
            out_a.append(node[x])
            out_b.append(node[y])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    if len(a):
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def proposals(postings: DataFrame, members: DataFrame, components: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of nodes. ``components`` (node, component): only between different ones."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = postings.withColumn("side", F.pmod(F.xxhash64("node"), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    if components is None:
        members = members.withColumn("component", F.lit(0).cast("bigint"))
    else:
        known = components.select(F.col("node").alias("n_"), "component")
        members = members.join(known, F.col("node") == F.col("n_"), "left").withColumn("component", F.coalesce("component", "node")).drop("n_")
    members = members.select(F.col("node").alias("m_"), "component", "mask", "coarse", "fine")
    rows = rows.join(members, F.col("node") == F.col("m_"))
    key = ["c", "v", "i", "j"]
    rows = rows.select("node", *key, "side", "component", "mask", "coarse", "fine").repartition(*key).sortWithinPartitions(*key, "node")
    return rows.mapInArrow(task(_proposed, components is None), "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = members.select(F.col("node").alias("n_"), "shingles")
    one = pairs.join(sets, F.col("a") == F.col("n_")).select("a", "b", F.col("shingles").alias("x"))
    two = one.join(sets, F.col("b") == F.col("n_")).select("a", "b", "x", F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return two.withColumn("both", both).where(100 * F.col("both") >= PERCENT * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node with an edge.

    Labels take the least of their neighbours' labels, then of their label's label, until none
    changes; every round is written to the shared folder.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = _written(both.distinct(), "edges")
    labels = _written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        known = labels.select(F.col("node").alias("n_"), F.col("component").alias("l_"))
        seen = both.join(known, F.col("b") == F.col("n_")).groupBy(F.col("a").alias("node")).agg(F.min("l_").alias("seen"))
        seen = seen.select(F.col("node").alias("s_"), "seen")
        new = labels.join(seen, F.col("node") == F.col("s_")).select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        new = new.join(known, F.col("component") == F.col("n_"), "left").select("node", "old", F.least("component", F.coalesce("l_", "component")).alias("component"))
        new = _written(new, "labels")
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. Ids are integers."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = _written(rows.mapInArrow(task(_signed), "doc_id bigint, n bigint, h1 bigint, h2 bigint, sig array<int>"), "signatures")
    same = ["n", "h1", "h2"]
    sets = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("node"), F.any_value("sig").alias("sig"))
    sets = _written(sets, "sets")
    postings = prefix_lists(sets)
    masks = postings.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, c)")).alias("mask"))
    wanted = sets.select(F.col("node").alias("n_"), "h1", "h2").join(masks, F.col("n_") == F.col("node")).select("node", "h1", "h2", "mask")
    held = rows.join(wanted, rows["doc_id"] == wanted["node"]).select("node", "text", "h1", "h2")
    fine = held.mapInArrow(task(_fine), "node bigint, shingles array<bigint>, coarse binary, fine binary")
    mask = masks.select(F.col("node").alias("n_"), "mask")
    members = _written(fine.join(mask, F.col("node") == F.col("n_")).drop("n_"), "members")
    first = _written(confirmed(proposals(postings, members, None), members), "links")
    second = confirmed(proposals(postings, members, components(first)), members)
    found = components(first.unionByName(second))
    found = found.select(F.col("node").alias("linked"), "component")
    named = sets.select(*[F.col(c).alias(f"{c}_") for c in same], "node").join(found, F.col("node") == F.col("linked"), "left")
    named = named.select(*[f"{c}_" for c in same], F.coalesce("component", "node").alias("component"))
    cond = F.lit(True)
    for c in same:
        cond = cond & (F.col(c) == F.col(f"{c}_"))
    out = signed.select("doc_id", *same).join(named, cond & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
