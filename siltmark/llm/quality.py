"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores its failure as a bit beside the
measurements. A policy is a versioned set of rules (a mask), applied to the stored bits; what
each rule adds to a policy (its ablation) is a bitwise aggregation of the ledger, without
reading a text again.

Words are maximal runs outside the space and the characters 9 to 13. Defined cases: a NULL or
empty text has no words and fails ``few_words``; repeated rows give equal ledger rows; an empty
table gives an empty ledger and ablation counts of no rows; columns besides the id and the text
pass through ``keep`` and are otherwise not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_lines", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; ``bit`` is its place in the ledger."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: Bits are never reused: a changed rule gets a new bit and a new name.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
)
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1-base": ("few_words", "repeated_windows"),
    "v2-symbols": ("few_words", "repeated_windows", "symbols_per_word"),
    "v3-shape": ("few_words", "repeated_windows", "symbols_per_word", "duplicate_lines", "long_words", "short_words"),
}
CURRENT = "v3-shape"


def policy_mask(policy: str) -> int:
    by_name = {r.name: r.mask for r in RULES}
    return sum(by_name[name] for name in POLICIES[policy])


def _window_hashes(words: str) -> Column:
    """The 64-bit hash of every window of five words, in order."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def measure(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` plus the measurements of every whole text. Projections only; no shuffle.

    Repeated words: window hashes with their places are sorted once; a window with an equal
    neighbour is repeated. The union of the repeated windows is the sum of the steps between
    their sorted places, each at most a window long. Texts whose windows all differ skip the
    sort. (Two different windows of one text share a hash with a chance of about 3e-8 for a
    text of a million words.)
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*keep, body.alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", WORD_GAP, -1), ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_windows", _window_hashes("_words"))
    df = df.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.regexp_extract_all("_text", F.lit(f"({SYMBOLS})"), 1)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "_windows",
    )
    distinct = F.size(F.array_distinct("_windows")) == F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(~distinct, placed))
    same = lambda x, k, step: F.coalesce(F.get("_sorted", k + step)["h"] == x["h"], F.lit(False))
    repeated = F.sort_array(F.transform(F.filter("_sorted", lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))
    df = df.withColumn("_places", F.coalesce(repeated, F.array().cast("array<int>")))
    steps = F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    # A generator of one row: later filters stay above it and do not evaluate these expressions again.
    return df.select(*keep, F.inline(F.array(F.struct(*[c for c in MEASURES if c != "n_repeat_words"], total.alias("n_repeat_words")))))


def with_bits(measured: DataFrame, name: str = "failed") -> DataFrame:
    """Add the ledger's bitmask: bit k is set where rule k fails."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.mask).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measured.withColumn(name, bits)


def ledger(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed`` of every row."""
    return with_bits(measure(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body")), "_body", ["doc_id"]))


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy_mask(policy)).cast("bigint")) == 0


def ablations(led: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """policy, rule, n_rows, n_rejected, n_failed (the rule fails) and n_only (rejected by it alone).

    The ledger shrinks to one row per bitmask (at most 2**rules, combined in each task) before
    policies and rules fan out.
    """
    counts = led.groupBy("failed").agg(F.count("*").alias("n"))
    pairs = [(p, r.name, policy_mask(p), r.mask) for p in policies for r in RULES if r.name in POLICIES[p]]
    grid = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("bigint").alias("m"), F.lit(b).cast("bigint").alias("b")) for p, r, m, b in pairs])
    rows = counts.select("failed", "n", F.inline(grid))
    hit, own = F.col("failed").bitwiseAND(F.col("m")), F.col("failed").bitwiseAND(F.col("b"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_rows"), total(hit != 0).alias("n_rejected"), total(own != 0).alias("n_failed"),
        total((hit == F.col("b"))).alias("n_only"),
    )
