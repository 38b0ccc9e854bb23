"""Substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers it
occurs earlier: in a document with a smaller id, or further left in the same one.

1. Every text is cut into *blocks* by its content: a window's anchor is the least hash among its
   runs of ``ANCHOR`` words, and the windows that share one anchor are a block. Equal windows have
   equal anchors, so a window can only occur again in a block with the same anchor. Blocks whose
   anchor occurs once are literals and leave here, before anything else is shuffled.
2. The reference index holds every other distinct block once, with its first place.
3. A document is factored against the whole index: a block with an earlier first place is a piece
   that refers to it. Neighbouring pieces that go on at the same reference become one factor.
4. Factors end inside blocks, where a copied passage stops or was edited. So at the boundaries
   (indexed blocks whose anchor other blocks have too) the windows are checked one by one by
   their own first places, and those with an earlier one are pieces of the parse as well.

Words, blocks and windows are named by 64-bit hashes; a block or window is compared only with
those of the same anchor, which makes it 128 bits. Copies of a block are one row of the index,
whatever their number, and first places are minima that every task takes before the shuffle.

Defined cases: NULL ids come first, and order among equal ids is that of a hash of the text; rows
equal in id and text are one document (they do not delete each other, and all lose what an
earlier place holds); NULL texts stay NULL; a text without a deletion is returned byte for byte,
any other as its kept words joined by one blank; fewer than ``WINDOW`` words never lose any; an
empty table gives no rows; other columns are carried along (names starting with ``_sd_``, and
``n_words`` and ``n_removed``, are refused).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.llm.textbytes import Words, alphabet, prefix_sums, run_hashes, whole
from siltmark.llm.workers import task

WINDOW, ANCHOR = 20, 4

#: Bytes of text hashed at a time (whole texts; a longer one alone).
STRETCH = 1 << 20

DOC = ["_sd_id", "_sd_key"]
BLOCK = ["seed", "body"]
LETTERS = alphabet(b" \t\n\x0b\x0c\r")
_LOW = np.uint64(0xFFFFFFFF)


def stretches(texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """Whole texts in stretches: number of the first, words, prefix sums of their hashes, and the
    first word of each text."""
    lengths = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(lengths, lengths[at] + STRETCH, "right")) - 1)
        words = whole(texts.slice(at, end - at), LETTERS)
        yield at, words, prefix_sums(words.h), np.searchsorted(words.row, np.arange(end - at))
        at = end


def blocks(words: Words, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, first word and number of windows of each block."""
    n = len(words.h) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    at = np.arange(n + WINDOW - ANCHOR)
    grams = run_hashes(sums, at, at + ANCHOR)
    # Least hash (of 32 bits) and its place in each window, by minima over 1, 2, 4, ... places.
    least, reach, wanted = (grams & ~_LOW) | at.astype(np.uint64), 1, WINDOW - ANCHOR + 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        least, reach = np.minimum(least[:-step], least[step:]), reach + step
    anchor = (least & _LOW).astype(np.int64)
    inside = words.row[:n] == words.row[WINDOW - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    before = np.cumsum(inside)
    return grams[anchor[start]], start, np.diff(np.append(before[start], before[-1] + 1))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words, sums, _ in stretches(batch.column(0)):
            yield pa.RecordBatch.from_pydict({"seed": pa.array(blocks(words, sums)[0].view(np.int64))})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, words, sums, first in stretches(batch.column(2)):
            seed, start, n = blocks(words, sums)
            row = words.row[start]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(row + at)) for c in (0, 1)), pa.array(seed.view(np.int64)),
                    pa.array(run_hashes(sums, start, start + n + WINDOW - 1).view(np.int64)), pa.array((start - first[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ],
                names=[*DOC, *BLOCK, "start", "n"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks named with each text."""
    for batch in batches:
        for at, _, sums, first in stretches(batch.column(2)):
            wanted = batch.column(3).slice(at, len(first))
            row = np.repeat(np.arange(len(first)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            seed, start, n = (wanted.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("seed", "start", "n"))
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, start = np.repeat(row, n), np.repeat(start, n) + inside
            word = first[row] + start
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(row + at)) for c in (0, 1)), pa.array(np.repeat(seed, n)),
                    pa.array(run_hashes(sums, word, word + WINDOW).view(np.int64)), pa.array(start.astype(np.int32)),
                ],
                names=[*DOC, *BLOCK, "start"],
            )


def parse(row: np.ndarray, start: np.ndarray, n: np.ndarray, ref: list[np.ndarray], ref_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors: the first piece of each and its length. A factor goes on as long as a piece
    that overlaps or touches it continues at the same place of the same reference (``ref``: columns
    that name it). Factors come by row and start."""
    lag = start - ref_start
    order = np.lexsort((-n, start, lag, *ref, row))
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in (row, *ref, lag)])
    group = np.cumsum(~same).astype(np.int64) << 32
    reach = np.maximum.accumulate(group + start[order] + n[order])
    new = ~same
    new[1:] |= group[1:] + start[order][1:] > reach[:-1]
    first = np.flatnonzero(new)
    length = (reach - group)[np.append(first[1:], len(order)) - 1] - start[order][first] if len(first) else reach
    by = np.lexsort((start[order][first], row[order][first]))
    return order[first][by], length[by]


PIECE = "start int, n int, ref_id bigint, ref_key bigint, ref_start int"
FACTORS = f"array<struct<{PIECE}>>"
OWN = ("n_words", "n_removed")


def _factors(pieces: pa.Array) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """Factors of each row: as a list column, and for each row their first words and lengths."""
    flat, counts = pieces.flatten(), pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(pieces)), counts)
    start, n, ref_start = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n", "ref_start"))
    ref = [flat.field("ref_id").fill_null(0).to_numpy(zero_copy_only=False), flat.field("ref_key").to_numpy(zero_copy_only=False)]
    ref.append(flat.field("ref_id").is_null().to_numpy(zero_copy_only=False))
    first, length = parse(row, start, n, ref, ref_start)
    picked = flat.take(pa.array(first))
    cells = [pa.array(length.astype(np.int32)) if f.name == "n" else picked.field(f.name) for f in flat.type]
    ends = np.searchsorted(row[first], np.arange(len(pieces) + 1)).astype(np.int32)
    column = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cells, fields=list(flat.type)))
    return column, np.split(start[first], ends[1:-1]), np.split(length, ends[1:-1])


def _cut(joined: bool):
    """Texts without the words of their factors: the pieces stand in the last column, the text before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            factors, starts, lengths = _factors(batch.column(batch.num_columns - 1))
            texts, n_words, n_removed = [], [], []
            for text, start, n in zip(batch.column(batch.num_columns - 2), starts, lengths):
                text = text.as_py()
                words = (text or "").encode().split()
                gone = 0
                if len(start):
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + n, -1)
                    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
                    gone = len(words) - len(kept)
                    text = b" ".join([words[i] for i in kept.tolist()]).decode()
                elif joined:
                    text = b" ".join(words).decode()
                texts.append(text)
                n_words.append(len(words))
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), factors],
                names=[*batch.schema.names[:-1], *OWN, "_sd_factors"],
            )

    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.withColumns({"_sd_id": F.col(doc_id).cast("bigint"), "_sd_key": F.xxhash64(text)})


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_") if c in names else F.col(c) for c in df.columns])


def _equal(names: list[str]) -> Column:
    """Conditions of a join with a side of renamed columns; ids may be NULL."""
    cond = F.lit(True)
    for c in names:
        cond = cond & (F.col(c).eqNullSafe(F.col(f"{c}_")) if c == "_sd_id" else F.col(c) == F.col(f"{c}_"))
    return cond


def _firsts(rows: DataFrame) -> DataFrame:
    """seed, body, their first place and whether there are more; written, so that a later join can split hot ones."""
    return rows.groupBy(*BLOCK).agg(F.min(F.struct(*DOC, "start")).alias("first"), F.count("*").alias("copies"))


def _referring(rows: DataFrame, firsts: DataFrame, length: Column) -> DataFrame:
    """Pieces: the rows whose first place is another one."""
    own = F.struct(*DOC, "start")
    met = rows.join(_renamed(firsts, BLOCK), _equal(BLOCK)).where(~own.eqNullSafe(F.col("first")))
    return met.select(
        *DOC, "start", length.cast("int").alias("n"), F.col("first._sd_id").alias("ref_id"), F.col("first._sd_key").alias("ref_key"), F.col("first.start").alias("ref_start")
    )


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every block and boundary window with an earlier copy: document, start and n (words), and
    the place it refers to."""
    rows = _keyed(df.select(doc_id, text), doc_id, text).select(*DOC, F.col(text).alias("text"))
    shared = rows.select("text").mapInArrow(task(_seeds), "seed bigint").groupBy("seed").agg(F.count("*").alias("c")).where("c > 1").select(F.col("seed").alias("seed_"))
    shared = _kept(shared, "shared-anchors")
    fields = "_sd_id bigint, _sd_key bigint, seed bigint, body bigint, start int, n int"
    posted = rows.mapInArrow(task(_blocks), fields)
    posted = _kept(posted.join(shared, F.col("seed") == F.col("seed_")).drop("seed_"), "blocks")
    index = _kept(_firsts(posted), "index")
    known = _referring(posted, index.where("copies > 1"), F.col("n") + WINDOW - 1)
    # Boundaries: first places of blocks whose anchor other blocks have too.
    several = index.groupBy("seed").agg(F.count("*").alias("bodies")).where("bodies > 1").select(F.col("seed").alias("seed_"))
    edges = index.join(_kept(several, "anchors"), F.col("seed") == F.col("seed_")).select("seed", "body", "first")
    at = F.struct(*DOC, "start")
    edges = posted.join(_renamed(edges, BLOCK), _equal(BLOCK)).where(at.eqNullSafe(F.col("first")))
    edges = edges.groupBy(*DOC).agg(F.collect_set(F.struct("seed", "start", "n")).alias("wanted"))
    edges = _kept(edges, "boundaries")
    held = rows.join(_renamed(edges, DOC), _equal(DOC)).select(*DOC, "text", "wanted")
    windows = _kept(held.mapInArrow(task(_windows), "_sd_id bigint, _sd_key bigint, seed bigint, body bigint, start int"), "windows")
    repeated = _kept(_firsts(windows).where("copies > 1"), "repeated-windows")
    return known.unionByName(_referring(windows, repeated, F.lit(WINDOW)))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", factors: str | None = None, joined: bool = False) -> DataFrame:
    """All rows and columns of ``df``, the text without later copies, plus n_words and n_removed,
    and the factors of each row in a column of that name if one is given. ``joined``: also texts
    that lose nothing become their words joined by one blank (NULL: empty)."""
    taken = [c for c in df.columns if c.startswith("_sd_") or c in (*OWN, factors)]
    if taken:
        raise ValueError(f"columns {taken} are names of the operator")
    found = pieces(df, doc_id, text)
    place = F.struct("start", "n", "ref_id", "ref_key", "ref_start")
    found = _kept(found.groupBy(*DOC).agg(F.collect_set(place).alias("_sd_pieces")), "pieces")
    rows = _keyed(df, doc_id, text).join(_renamed(found, DOC), _equal(DOC), "left")
    others = [c for c in df.columns if c != text]
    rows = rows.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string"), "_sd_pieces")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(task(_cut, joined), f"{kinds}, n_words bigint, n_removed bigint, _sd_factors {FACTORS}")
    names = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*names, *OWN, *([F.col("_sd_factors").alias(factors)] if factors else []))
