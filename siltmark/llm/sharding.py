"""Shard placement by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries weights; an inner node weighs what its leaves
weigh. A row descends from the root: at every node each child draws ``-ln(u) / weight`` with
``u`` uniform in (0, 1] from a hash of the row's key and the child's path, and the smallest
draw wins. The draw of one child does not depend on its siblings, so changing a weight moves
rows only into (or out of) the subtree whose weight changed. Growth by one shard adds it as
a subtree of its own: every row that moves, moves into it.

Defined cases: a NULL key is a key like any other (all such rows share a shard); repeated rows
and equal keys share a shard and get slots of their own; an empty table gives no rows; a NULL
or empty text has size 1 and checksum 0. Other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows ordered by one task when slots are numbered.
SLOT_ROWS = 100_000
#: Buckets per shard at least, so that few shards still fill many executors.
MIN_BUCKETS = 8
MAX_SHARDS = 4096


@dataclass(frozen=True)
class Node:
    """A region, a rack (both with children) or a shard (a leaf with its number and weight)."""

    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight

    def leaves(self) -> list["Node"]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def uniform_tree(regions: int, racks: int, shards: int) -> Node:
    """``regions`` x ``racks`` x ``shards`` leaves of weight 1, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        children=tuple(
            Node(f"region{r}", children=tuple(
                Node(f"rack{k}", children=tuple(Node(f"shard{n}", shard=n) for n in (next(number) for _ in range(shards))))
                for k in range(racks)
            ))
            for r in range(regions)
        ),
    )


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    n = 1 + max(leaf.shard for leaf in tree.leaves())
    region = Node(f"region-of-{n}", children=(Node("rack0", children=(Node(f"shard{n}", weight, shard=n),)),))
    return replace(tree, children=(*tree.children, region))


def _draw(key: Column, path: str, weight: float) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11)
    return -F.log((h + 1) / F.lit(float(1 << 53))) / F.lit(weight)


def _choose(key: Column, node: Node, path: str) -> Column:
    """Index of the child that wins at ``node``; ties go to the earlier child."""
    live = [(i, c) for i, c in enumerate(node.children) if c.total > 0]
    if not live:
        raise ValueError(f"{path}: no child has weight")
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.least(*[F.struct(_draw(key, f"{path}/{c.name}", c.total).alias("d"), F.lit(i).alias("i")) for i, c in live])["i"]


def place(df: DataFrame, tree: Node, key: Column, out: str) -> DataFrame:
    """Add ``out``, the shard number, one descent level at a time (a projection; no shuffle)."""
    if not 0 < len(tree.leaves()) <= MAX_SHARDS:
        raise ValueError(f"a tree has 1 to {MAX_SHARDS} shards")
    level, at, depth = [(tree, "root", None)], None, 0
    names = []
    while any(node.children for node, _, _ in level):
        pick = F.lit(None).cast("int")
        below = []
        for node, path, number in level:
            chosen = _choose(key, node, path)
            pick = chosen if number is None else F.when(at == number, chosen).otherwise(pick)
            below += [(c, f"{path}/{c.name}", (number or 0) * 4096 + i) for i, c in enumerate(node.children)]
        name = f"{out}__{depth}"
        df = df.withColumn(name, ((at * 4096) if at is not None else F.lit(0).cast("bigint")) + pick)
        at, level, depth = F.col(name), below, depth + 1
        names.append(name)
    shard = F.lit(None).cast("int")
    for node, _, number in level:
        shard = F.when(at == number, F.lit(node.shard)).otherwise(shard)
    return df.withColumn(out, shard).drop(*names)


def with_slots(df: DataFrame, shard: str, shards: int, by: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in buckets that one task can order.

    Rows are dealt to buckets by a hash of ``by``; bucket sizes are counted first (combined in
    each task), their running sums are the first slot of each bucket.
    """
    buckets = max(MIN_BUCKETS, -(-df.count() // (SLOT_ROWS * shards)))
    bucket_of = F.pmod(F.xxhash64(*by), F.lit(buckets))
    keyed = df.withColumn("_bucket", bucket_of)
    sizes = keyed.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_s").orderBy("_b")
    first = sizes.select("_s", "_b", (F.sum("_n").over(order) - F.col("_n")).alias("_first"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*by)
    numbered = keyed.withColumn("_k", F.row_number().over(inside) - 1)
    joined = numbered.join(first, numbered[shard].eqNullSafe(first["_s"]) & (numbered["_bucket"] == first["_b"]))
    return joined.withColumn(slot, (F.col("_first") + F.col("_k")).cast("bigint")).drop("_bucket", "_k", "_s", "_b", "_first")


def shard_documents(df: DataFrame, tree: Node, larger: Node, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row. Law ``key``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    key = F.col("doc_id")
    placed = place(place(rows, tree, key, "shard"), larger, key, "grown_shard")
    numbered = with_slots(placed, "shard", len(tree.leaves()), ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
