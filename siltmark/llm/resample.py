"""Importance resampling towards a target: array-scored weights and a bracketed cutoff.

1. Words (and runs of up to ``longest`` of them) are hashed into ``BUCKETS`` counters, in the
   corpus and in the target; the gain of a bucket is a smoothed log ratio, an array of integers.
2. A text's weight is the sum of the gains of its features: one look-up per feature. Adding a
   seeded Gumbel draw makes "highest scores" a weighted sample without replacement.
3. The cutoff is an order statistic. A quantile sketch proposes a bracket of scores, exact counts
   above and inside it tell whether the wanted place lies in it (else it is widened), and only
   the bracket is sorted. A bracket that holds too many rows for one task is sketched again, on
   its own rows, down to a single score; inside that score the same is done with the ids.
4. Drawn rows are dealt by ranges of (score, id) and sorted inside them; the counts of the ranges
   give the first rank of each.

Defined cases: NULL and empty texts have no features and weight 0; documents of fewer than
``least_words`` words are scored, but never drawn; NULL ids draw as the empty string and come
first among equal scores; rows equal in score and id take places in any order; an empty target or
an empty table is no error (without features every gain follows from the smoothing alone); other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.llm.workers import task

BUCKETS, SEED, PERCENT, LEAST_WORDS, LONGEST = 10_000, 2024, 10, 20, 1
#: Rows of a bracket that one task may sort, and the half width of the first bracket.
SORT_ROWS, MARGIN = 1_000_000, 0.002

#: Bytes of words: digits, letters (lower case) and everything outside ASCII; the rest is a blank.
_WORD_BYTES = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


def buckets(text: str, n_buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    found = words(text)
    features = list(found)
    for k in range(2, longest + 1):
        features += [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
    return len(found), np.fromiter(map(zlib.crc32, features), np.uint32, len(features)) % np.uint32(n_buckets)


def _counted(n_buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for v in batch.column(0):
                _, found = buckets(v.as_py() or "", n_buckets, longest)
                np.add.at(sums, found, 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    return run


def bucket_counts(df: DataFrame, text: str = "text", n_buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all rows: at most ``n_buckets`` sums reach the driver."""
    parts = df.select(F.col(text).alias("text")).mapInArrow(task(_counted, n_buckets, longest), "bucket bigint, n bigint")
    out = np.zeros(n_buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Floored thousandths of the smoothed log ratio of each bucket."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum()) + n, float(target.sum()) + n
    return [math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())]


def draw(seed: int, doc_id: int | None) -> int:
    """The Gumbel draw of an id, in floored thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: bytes, longest: int, seed: int):
    table = np.frombuffer(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [buckets(v.as_py() or "", len(table), longest) for v in batch.column(1)]
            weight = np.array([int(table[b].sum()) for _, b in found], np.int64)
            score = weight + np.array([draw(seed, i) for i in ids], np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": pa.array([n for n, _ in found], pa.int64()), "n_features": pa.array([len(b) for _, b in found], pa.int64()),
                "weight": pa.array(weight), "score": pa.array(score),
            })

    return run


def scored(df: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    fields = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    return rows.mapInArrow(task(_scored, np.array(gain, np.int64).tobytes(), longest, seed), fields)


def kth_least(values: DataFrame, k: int, margin: float = MARGIN, sort_rows: int = SORT_ROWS) -> tuple[int, int]:
    """The k-th least value (from 1) of the one long column ``v``, and how many values lie below it."""
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).head()
    if not 1 <= k <= n:
        raise ValueError(f"no value number {k} among {n}")
    below, first = 0, True
    while lo < hi and (first or n > sort_rows):
        rows = values.where(F.col("v").between(lo, hi))
        a, b, under, among = _bracket(rows, lo, hi, n, k - below, margin)
        if among == n and n > sort_rows:  # one sketch step cannot part these values
            a, b = lo, lo + (hi - lo) // 2
            among = rows.where(F.col("v") <= b).count()
            if k - below > among:
                a, b, under, among = b + 1, hi, among, n - among
        lo, hi, below, n, first = a, b, below + under, among, False
    if lo == hi:
        return lo, below
    pairs = values.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("c"))
    through = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # at most sort_rows pairs
    at = pairs.withColumn("through", through).where(F.col("through") >= k - below).orderBy("v").head()
    return at["v"], below + at["through"] - at["c"]


def _bracket(rows: DataFrame, lo: int, hi: int, n: int, k: int, margin: float) -> tuple[int, int, int, int]:
    """A sketched range of values that holds number ``k`` of ``rows``, the counts below and in it."""
    while True:
        cuts = [max(0.0, k / n - margin), min(1.0, k / n + margin)]
        a, b = rows.agg(F.percentile_approx("v", cuts, 10_000)).head()[0]
        a, b = (lo if cuts[0] == 0.0 else a), (hi if cuts[1] == 1.0 else b)
        under, among = rows.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).head()
        if under < k <= under + among:
            return a, b, under, among
        margin *= 8  # the sketch was off: widen, in the end to all rows


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **limits) -> DataFrame:
    """``scores`` plus rank: 1, 2, ... of the drawn rows by score, ties to the smaller id; else NULL."""
    able = F.col("n_words") >= least_words
    wanted = percent * scores.where(able).count() // 100
    if not wanted:
        return scores.withColumn("rank", F.lit(None).cast("bigint"))
    number = F.coalesce("doc_id", F.lit(-(1 << 63)))
    least, before = kth_least(scores.where(able).select((-F.col("score")).alias("v")), wanted, **limits)
    ties = scores.where(able & (F.col("score") == -least))
    last, _ = kth_least(ties.select(number.alias("v")), wanted - before, **limits)
    drawn = able & ((F.col("score") > -least) | ((F.col("score") == -least) & (number <= last)))
    path = scratch_path(scores.sparkSession, "drawn")
    parts = scores.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    sorted_rows = scores.where(drawn).repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    sorted_rows.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = scores.sparkSession.read.parquet(path)
    part, inside = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("c")).orderBy("part").collect()  # one row a range
    firsts, at = {}, 1
    for r in sizes:
        firsts[r["part"]], at = at, at + r["c"]
    first = F.create_map(*[F.lit(x).cast("bigint") for pair in firsts.items() for x in pair])
    rank = F.element_at(first, part) + inside
    chosen = placed.select(*scores.columns, F.when(rank <= wanted, rank).alias("rank"))  # rows equal at the cut: no more than wanted
    return chosen.unionByName(scores.where(~drawn).withColumn("rank", F.lit(None).cast("bigint")))


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``df``."""
    gain = gains(bucket_counts(df, text), bucket_counts(target, target_text))
    path = scratch_path(df.sparkSession, "scores")
    scored(df, gain, doc_id, text).write.parquet(path)
    return ranked(df.sparkSession.read.parquet(path))
