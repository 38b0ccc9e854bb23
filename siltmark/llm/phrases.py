"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count exactly.

A phrase is a run of one to three words inside a piece of text; it is frequent in its language if
it occurs at least ``min_count`` times.

1. Words and pairs of a seeded sample of the documents are counted; those that reach the lowered
   threshold are *proposed*.
2. The full pass counts, exactly and over all rows, every proposed phrase and the negative border:
   phrases that are not proposed while their first and their last part are. So every word is
   counted, a pair if both of its words are proposed, and a triple if both of its pairs are.
3. A frequent phrase on the border is a failure of the sample: longer phrases that hold it were
   not counted. Then all phrases found frequent so far are proposed, and a further pass counts
   what no earlier pass did. It ends when no failure is left; the frequent set is then exact.

What is proposed reaches the scan as a Bloom filter of at most ``2 ** MAX_BITS`` bits, put together
by Spark; a false positive is counted like the rest and falls below ``min_count``. Every pass
tests "counted before" by the same filters as the pass before it did, so nothing counts twice.
Words are named by 64-bit hashes seeded with their language. Each task adds up equal phrases
of a million words before the shuffle, so a phrase held by a third of the rows is one row of each.

Defined cases: NULL and empty texts have no words; a NULL language is ``und``; repeated rows and
ids count as often as they occur; ids are used by the sample alone; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column as Expression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.llm.textbytes import Column, Words, alphabet, mix
from siltmark.llm.workers import task

MIN_COUNT, TOP, CONTAINED_PERCENT = 10, 2000, 50
#: One document in ``SAMPLE`` proposes the words and pairs that occur so often in the sample.
SAMPLE, SAMPLE_COUNTS = 8, (2, 3)
BITS_PER_PHRASE, MAX_BITS = 16, 27

#: Words passed through at a time, and rows of a batch handed to Spark.
FLUSH, OUT = 1_000_000, 50_000

LETTERS = alphabet(b" \t", b".,;:!?\n\x0b\x0c\r", lower=True)
_ODD = np.uint64(0x9E3779B97F4A7C15)

FIELD_NAMES = ("row", "start", "end", "stop", "h")
FIELDS = "lang string, word string, h1 bigint, h2 bigint, h3 bigint, c bigint"
KEY = ["h1", "h2", "h3"]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * _ODD + b)


class Bloom:
    """Membership of 64-bit keys, two bits each, in a bit table whose size is a power of two."""

    def __init__(self, table: bytes):
        self.table = np.frombuffer(table, np.uint64)
        self.mask = np.uint64(len(self.table) * 64 - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        x = mix(keys)
        out = np.ones(len(keys), bool)
        for p in (x & self.mask, (x >> np.uint64(32)) & self.mask):
            out &= ((self.table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def _positions(log2: int, length: int):
    mask = np.uint64((1 << log2) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            x = mix(h[0] if length == 1 else _pair(h[0], h[1]))
            p = np.concatenate([x & mask, (x >> np.uint64(32)) & mask])
            bits = np.uint64(1) << (p & np.uint64(63))
            yield pa.RecordBatch.from_pydict({"slot": pa.array((p >> np.uint64(6)).astype(np.int64)), "bits": pa.array(bits.view(np.int64))})

    return run


def bloom(phrases: DataFrame, length: int) -> bytes:
    """The filter of words (``length`` 1, by h1) or pairs (2, by h1 and h2): at most 2 ** MAX_BITS bits."""
    rows = phrases.select(*KEY[:length])
    log2 = min(MAX_BITS, max(10, math.ceil(math.log2(max(1, rows.count()) * BITS_PER_PHRASE))))
    slots = rows.mapInArrow(task(_positions, log2, length), "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    found = slots.toArrow()
    table = np.zeros(1 << (log2 - 6), np.int64)
    table[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return table.tobytes()


def _narrow(words: Words) -> Words:
    """Places in a column of less than 2 GB in four bytes each."""
    small = [getattr(words, f).astype(np.int32) if len(words.end) and words.end[-1] < 1 << 31 else getattr(words, f) for f in FIELD_NAMES[:-1]]
    return Words(*small, words.h)


def _distinct(keys: list[np.ndarray], order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``keys`` and their counts; ``order`` brings equal rows together."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:  # one after the other: a copy of one key at a time
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    order = order[at]
    return [k[order] for k in keys], np.diff(np.append(at, len(new)))


def _rows(keys: list[np.ndarray], c: np.ndarray, lang: pa.Array | None = None, word: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(c), OUT):
        n = min(OUT, len(c) - at)
        texts = [pa.nulls(n, pa.string()) if t is None else t.slice(at, n) for t in (lang, word)]
        cols = [pa.array(k[at : at + n].view(np.int64)) for k in keys] + [pa.array(np.zeros(n, np.int64))] * (3 - len(keys))
        yield pa.RecordBatch.from_arrays([*texts, *cols, pa.array(c[at : at + n].astype(np.int64))], names=["lang", "word", *KEY, "c"])


class Pass:
    """What one pass counts, given the filters (words, pairs) of all passes so far, the last its own."""

    def __init__(self, filters: list[tuple[bytes, bytes]], words: bool, pairs_only: bool):
        self.filters = [(Bloom(a), Bloom(b)) for a, b in filters]
        self.words, self.pairs_only = words, pairs_only

    def _due(self, level: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Phrases whose both parts pass the newest filter and not both any earlier one."""
        if not self.filters:
            return np.ones(len(first), bool)
        *earlier, newest = [f[level] for f in self.filters]
        due = newest.holds(first)
        due[due] = newest.holds(last[due])
        for f in earlier:
            at = np.flatnonzero(due)
            due[at[f.holds(first[at]) & f.holds(last[at])]] = False
        return due

    def count(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([xxhash.xxh3_64_intdigest(name.encode()) for name in names], np.uint64)
        column = Column(batch.column(1), LETTERS)
        held, n = [], 0
        for part in column.words():
            part.h = mix(part.h + seeds[code[part.row]])
            if len(part.h):
                held.append(_narrow(part))
                n += len(part.h)
            if n >= FLUSH:
                carried = Words(*(np.concatenate([getattr(p, f) for p in held[-2:]])[-2:] for f in FIELD_NAMES), carried=True)
                yield from self._flush(held, column, names, code)
                held, n = [carried], 0
        yield from self._flush(held, column, names, code)

    def _flush(self, held: list[Words], column: Column, names: list[str], code: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of a stretch of words; up to two words before it open phrases, but were counted."""
        if not held:
            return
        old = len(held[0].h) if held[0].carried else 0
        row, start, end, stop, h = (np.concatenate([getattr(p, f) for p in held]) for f in FIELD_NAMES)
        held.clear()  # the stretch is held once
        if self.words:
            order = np.argsort(h[old:], kind="stable") + old
            keys, c = _distinct([h], order)
            at = order[np.concatenate([[0], np.cumsum(c)[:-1]]).astype(np.int64)] if len(c) else order
            word = pa.array([column.data[a:b].tobytes().lower().decode() for a, b in zip(start[at].tolist(), end[at].tolist())], pa.string())
            lang = pa.array(names, pa.string()).take(pa.array(code[row[at]]))
            yield from _rows(keys, c, lang, word)
            del order, keys, word, lang
            total = np.bincount(code[row[old:]], minlength=len(names))
            yield from _rows([np.zeros(len(names), np.uint64)], total, pa.array(names, pa.string()))
        together = (row[1:] == row[:-1]) & (stop[1:] == stop[:-1])
        del row, start, end, stop
        pair = _pair(h[:-1], h[1:])
        at = np.flatnonzero(together)
        at = at[at + 1 >= old]
        at = at[self._due(0, h[at], h[at + 1])]
        yield from _rows(*_distinct([h[:-1], h[1:]], at[np.argsort(pair[at])]))
        if self.pairs_only:
            return
        at = np.flatnonzero(together[:-1] & together[1:])
        at = at[at + 2 >= old]
        at = at[self._due(1, pair[at], pair[at + 1])]
        yield from _rows(*_distinct([h[:-2], h[1:-1], h[2:]], at[np.argsort(_pair(pair[at], h[at + 2]))]))


def _counted(filters: list, words: bool, pairs_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        what = Pass(filters, words, pairs_only)
        for batch in batches:
            yield from what.count(batch)

    return run


def counted(rows: DataFrame, filters: list[tuple[bytes, bytes]], words: bool, pairs_only: bool = False) -> DataFrame:
    """lang, word, h1, h2, h3 and c: a word has h1 alone, a pair h1 and h2; h1 = 0 is the language's total."""
    # Stretches are added up already: dealing their rows first spares each task a second table of them.
    parts = rows.mapInArrow(task(_counted, filters, words, pairs_only), FIELDS).repartition(*KEY)
    return parts.groupBy("lang", "word", *KEY).agg(F.sum("c").alias("c"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


WORD, PAIR, TRIPLE = "h1 <> 0 AND h2 = 0", "h2 <> 0 AND h3 = 0", "h3 <> 0"


def _missed(length: int, table: bytes):
    held = Bloom(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            lost = ~held.holds(h[0] if length == 1 else _pair(h[0], h[1]))
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(lost.sum())], pa.int64())})

    return run


def failures(found: DataFrame, filters: tuple[bytes, bytes]) -> int:
    """Frequent words and pairs that the last pass had not proposed."""
    n = 0
    for length, kind in ((1, WORD), (2, PAIR)):
        lost = found.where(kind).select(*KEY[:length]).mapInArrow(task(_missed, length, filters[length - 1]), "n bigint")
        n += lost.agg(F.sum("n")).head()[0] or 0
    return n


def frequent(df: DataFrame, doc_id: str, text: str, lang: str, min_count: int = MIN_COUNT) -> DataFrame:
    """Exact counts of every phrase of up to three words that occurs ``min_count`` times in its
    language, and the total of words of each language (rows as of ``counted``)."""
    lang_of = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    rows = df.select(lang_of.alias("lang"), F.col(text).alias("text"))
    some = df.where(F.pmod(F.xxhash64(F.lit(13), F.col(doc_id), F.col(text)), F.lit(SAMPLE)) == 0).select(*[lang_of.alias("lang"), F.col(text).alias("text")])
    words, pairs = SAMPLE_COUNTS
    proposed = _kept(counted(some, [], True, pairs_only=True).where(f"({WORD} AND c >= {words}) OR ({PAIR} AND c >= {pairs})"), "proposed")
    filters = [(bloom(proposed.where(WORD), 1), bloom(proposed.where(PAIR), 2))]
    whole = f"c >= {int(min_count)} OR h1 = 0"
    found = _kept(counted(rows, filters, True).where(whole), "frequent")
    while failures(found, filters[-1]):
        filters.append((bloom(found.where(WORD), 1), bloom(found.where(PAIR), 2)))
        found = found.unionByName(_kept(counted(rows, filters, False).where(whole), "expanded"))
    return found


def _score(a: str, left: str, right: str) -> Expression:
    """floor(1000000 a a / (l r)) in exact decimals of 38 digits."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    top = (big(a) * big(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, big(left) * big(right))


def collocations(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score."""
    found = frequent(df, doc_id, text, lang, min_count)
    words = found.where(WORD).select("lang", "word", "h1", "c")
    pairs, triples = found.where(PAIR).select("h1", "h2", "c"), found.where(TRIPLE).select(*KEY, "c")
    totals = found.where("h1 = 0").select(F.col("lang").alias("lang_"), F.col("c").alias("n"))

    def with_word(rows: DataFrame, n: int) -> DataFrame:
        one = words.select(F.col("h1").alias("h_"), F.col("word").alias(f"w{n}"), F.col("c").alias(f"f{n}"), *([F.col("lang")] if n == 1 else []))
        return rows.join(one, F.col(f"h{n}") == F.col("h_")).drop("h_")

    def with_pair(rows: DataFrame, n: int) -> DataFrame:
        one = pairs.select(F.col("h1").alias("x_"), F.col("h2").alias("y_"), F.col("c").alias(f"f{n}{n + 1}"))
        return rows.join(one, (F.col(f"h{n}") == F.col("x_")) & (F.col(f"h{n + 1}") == F.col("y_"))).drop("x_", "y_")

    # The most frequent triple around each pair decides whether it goes.
    around = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("x"), "c")
    around = around.groupBy(F.col("x.h1").alias("x_"), F.col("x.h2").alias("y_")).agg(F.max("c").alias("longer"))
    alone = pairs.join(around, (F.col("h1") == F.col("x_")) & (F.col("h2") == F.col("y_")), "left")
    alone = alone.where(f"longer IS NULL OR 100 * longer < {CONTAINED_PERCENT} * c").select("h1", "h2", F.col("c").alias("a"))
    two = with_word(with_word(alone, 1), 2).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")
    )
    three = with_pair(with_pair(triples.withColumnRenamed("c", "a"), 1), 2)
    three = with_word(with_word(with_word(three, 1), 2), 3)
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, F.col("lang") == F.col("lang_")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
