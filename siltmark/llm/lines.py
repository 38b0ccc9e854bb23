"""Line deduplication over suffix ranks of line sequences.

Every text is its sequence of lines that hold a word. A *run* is a stretch of such lines with at
least ``min_words`` words; a line goes if it lies in a run whose line sequence occurs earlier
(by id, then hashes of row and text, then place). What stays is the first copy.

Ranks come from prefix doubling: rank at depth 1 orders line hashes, and the rank of a suffix by
its first 2h lines orders the pairs (rank_h here, rank_h h lines on). Suffixes whose first h
lines occur once leave: no repeated run starts there. Suffixes of equal rank at depth h form an
interval of the suffix array whose common prefix is at least h lines long; a run of l lines,
h <= l < 2h, is named by the two overlapping intervals at its start and its end. It is enough to
test the shortest run from each line forwards and the shortest one backwards: together they
cover every longer run. As each line has a word, runs have at most ``min_words`` lines, which
bounds the rounds. Overlapping later copies merge into maximal runs, which are cut out.

Ranks are counted, not sorted as a whole: equal pairs are counted in each task, sums per bucket
give offsets, and only distinct pairs of one bucket meet in a task. Rounds are written to the
shared folder. A line shared by a third of all rows is one pair.

Defined cases: NULL texts stay NULL, empty ones empty; rows equal in id and text are one
document (they do not delete each other, and both lose what an earlier document holds); a text
without a deletion is returned byte for byte; blank lines inside a deleted run go with it; an
empty table gives no rows; all other columns are carried along (names starting with ``_ld_`` are
reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path

WORD_GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
#: Bits of a line hash that pick its bucket, and ranks of a bucket in later rounds.
HASH_BUCKET_BITS, RANK_BUCKET = 12, 1 << 16

DOC = ["_ld_id", "_ld_k1", "_ld_k2"]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.withColumns({
        "_ld_id": F.col(doc_id), "_ld_k1": F.xxhash64(F.col(doc_id), F.col(text)), "_ld_k2": F.xxhash64(F.lit(7), F.col(text), F.col(doc_id)),
    })


def _sequence(text: str) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HAS_WORD))


def line_table(df: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """One row per line with a word: document, place, hashes, and the lengths of the shortest
    runs that start (``fwd``) and end (``back``) there, NULL where the text has too few words."""
    words = lambda x: F.size(F.array_remove(F.split(x, WORD_GAP, -1), ""))
    one = F.transform(_sequence(text), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), words(x).cast("bigint").alias("n")))
    rows = _keyed(df.select(doc_id, text), doc_id, text).select(*DOC, F.posexplode(one).alias("i", "x")).select(*DOC, "i", "x.*")
    by = Window.partitionBy(*DOC)
    through = F.sum("n").over(by.orderBy("i").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("through", through).withColumn("before", F.col("through") - F.col("n"))
    rows = rows.withColumn("total", F.max("through").over(by)).withColumn("lines", F.max("i").over(by) + 1).withColumn("minus", -F.col("before"))
    after = F.min("i").over(by.orderBy("minus").rangeBetween(Window.unboundedPreceding, -min_words))
    start = F.max("i").over(by.orderBy("through").rangeBetween(Window.unboundedPreceding, -min_words)) + 1
    enough_after, enough_before = F.col("total") - F.col("before") >= min_words, F.col("through") >= min_words
    return rows.select(
        *DOC, "i", "h1", "h2",
        F.when(enough_after, F.coalesce(after, "lines") - F.col("i")).alias("fwd"),
        F.when(enough_before, F.col("i") + 1 - F.coalesce(start, F.lit(0))).alias("back"),
    )


def _offsets(counts: DataFrame, group: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """``counts`` (distinct, with ``c``) plus ``at``: the sum of ``c`` before it in its group."""
    counts = counts.withColumn("b", bucket)
    sums = counts.groupBy(*group, "b").agg(F.sum("c").alias("bc"))
    start = sums.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("b").alias("b_"), (F.sum("bc").over(Window.partitionBy(*group).orderBy("b")) - F.col("bc")).alias("first"))
    inside = F.sum("c").over(Window.partitionBy(*group, "b").orderBy(*order)) - F.col("c")
    here = counts.withColumn("inside", inside)
    cond = here["b"] == start["b_"]
    for g in group:
        cond = cond & (here[g] == start[f"{g}_"])
    return here.join(start, cond).withColumn("at", F.col("first") + F.col("inside")).drop("b", "b_", "first", "inside", *[f"{g}_" for g in group])


def _first_ranks(lines: DataFrame) -> DataFrame:
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1")
    ranked = _offsets(counts, [], F.shiftrightunsigned("h1", 64 - HASH_BUCKET_BITS), ["h1", "h2"])
    ranked = ranked.select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), F.col("at").alias("r"))
    live = lines.join(ranked, (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")))
    return live.select(*DOC, "i", "r", "fwd", "back")


def _doubled(ranks: DataFrame, h: int) -> DataFrame:
    ahead = F.max("r").over(Window.partitionBy(*DOC).orderBy("i").rangeBetween(h, h))
    pairs = ranks.withColumn("r2", ahead).where("r2 IS NOT NULL")
    counts = pairs.groupBy("r", "r2").agg(F.count("*").alias("c")).where("c > 1")
    ranked = _offsets(counts, ["r"], F.floor(F.col("r2") / RANK_BUCKET), ["r2"])
    ranked = ranked.select(F.col("r").alias("r_"), F.col("r2").alias("r2_"), (F.col("r") + F.col("at")).alias("new"))
    return pairs.join(ranked, (F.col("r") == F.col("r_")) & (F.col("r2") == F.col("r2_"))).select(*DOC, "i", F.col("new").alias("r"))


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return (a["_ld_k1"] == b["_ld_k1"]) & (a["_ld_k2"] == b["_ld_k2"]) & a["_ld_id"].eqNullSafe(b["_ld_id"])


def _named(runs: DataFrame, ranks: DataFrame, h: int) -> DataFrame:
    """Runs of h to 2h - 1 lines with the ranks of their first and last h lines."""
    due = runs.where((F.col("l") >= h) & (F.col("l") < 2 * h))
    heads = ranks.select(*DOC, F.col("i").alias("s"), F.col("r").alias("r1"))
    due = due.join(heads, _same_doc(due, heads) & (due["s"] == heads["s"])).select(*[due[c] for c in (*DOC, "s", "l")], "r1")
    if h == 1:
        return due.withColumn("r2", F.col("r1")).withColumn("h", F.lit(h))
    tails = ranks.select(*DOC, F.col("i").alias("t"), F.col("r").alias("r2"))
    met = due.join(tails, _same_doc(due, tails) & (due["s"] + due["l"] - h == tails["t"]))
    return met.select(*[due[c] for c in (*DOC, "s", "l", "r1")], "r2").withColumn("h", F.lit(h))


def later_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs to delete: the document's key columns, first and last place among its lines."""
    lines = _written(line_table(df, doc_id, text, min_words), "lines")
    ranks = _written(_first_ranks(lines), "ranks-1")
    ahead, behind = F.struct(F.col("i").alias("s"), F.col("fwd").alias("l")), F.struct((F.col("i") + 1 - F.col("back")).alias("s"), F.col("back").alias("l"))
    runs = ranks.select(*DOC, F.explode(F.array_distinct(F.array(ahead, behind))).alias("x")).select(*DOC, "x.s", "x.l").where("l IS NOT NULL").distinct()
    named, h = _named(runs, ranks, 1), 1
    while 2 * h <= min_words:
        ranks = _written(_doubled(ranks, h), f"ranks-{2 * h}")
        h *= 2
        if ranks.isEmpty():
            break
        named = named.unionByName(_named(runs, ranks, h))
    named = _written(named, "runs")
    place = F.struct(*DOC, "s")
    firsts = named.groupBy("h", "r1", "r2", "l").agg(F.min(place).alias("first"))
    # Written, so that the join deals both sides anew and can split a run that very many texts hold.
    firsts = _written(firsts.select(*[F.col(c).alias(f"{c}_") for c in ("h", "r1", "r2", "l")], "first"), "first-runs")
    cond = F.lit(True)
    for c in ("h", "r1", "r2", "l"):
        cond = cond & (named[c] == firsts[f"{c}_"])
    later = named.join(firsts, cond).where(~place.eqNullSafe(F.col("first"))).select(*DOC, "s", (F.col("s") + F.col("l") - 1).alias("e"))
    order = Window.partitionBy(*DOC).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    later = later.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy(*DOC, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``df``, the text without later copies, plus n_lines and n_deleted
    (lines that hold a word; they replace columns of these names)."""
    runs = later_runs(df, doc_id, text, min_words)
    cuts = runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_ld_cuts"))
    docs = _keyed(df, doc_id, text)
    cuts = cuts.select(*[F.col(c).alias(f"{c}_") for c in DOC], "_ld_cuts")
    same = (docs["_ld_k1"] == cuts["_ld_k1_"]) & (docs["_ld_k2"] == cuts["_ld_k2_"]) & docs["_ld_id"].eqNullSafe(cuts["_ld_id_"])
    rows = docs.join(cuts, same, "left").withColumn("_ld_lines", F.split(text, "\n", -1))
    places = F.filter(F.transform("_ld_lines", lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_ld_places", F.coalesce(places, F.array().cast("array<int>")))
    # Line numbers of the cuts, first and last; what stays are the slices between them.
    rows = rows.withColumn("_ld_cuts", F.transform("_ld_cuts", lambda x: F.struct(F.get("_ld_places", x["s"].cast("int")).alias("a"), F.get("_ld_places", x["e"].cast("int")).alias("b"))))
    def gap(x, k):
        before = F.coalesce(F.get("_ld_cuts", k - 1)["b"] + 1, F.lit(0))
        return F.slice("_ld_lines", before + 1, x["a"] - before)
    last = F.element_at("_ld_cuts", -1)["b"] + 1
    kept = F.concat(F.flatten(F.transform("_ld_cuts", gap)), F.slice("_ld_lines", last + 1, F.size("_ld_lines") - last))
    gone = F.aggregate("_ld_cuts", F.lit(0), lambda n, x: n + 1 + F.array_position("_ld_places", x["b"]).cast("int") - F.array_position("_ld_places", x["a"]).cast("int"))
    # A generator of one row: later filters stay above it and do not evaluate these expressions again.
    body = F.when(F.col("_ld_cuts").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    counts = F.size("_ld_places").cast("bigint").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_deleted")
    others = [c for c in df.columns if c not in (text, "n_lines", "n_deleted")]
    return rows.select(*others, F.inline(F.array(F.struct(body.alias(text), *counts))))
