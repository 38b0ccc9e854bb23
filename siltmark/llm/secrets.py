"""Secret scan with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported as found.
Weak parts (short passwords, user names, endpoints) are reported only when complementary parts
lie in the same scope: a part in role *identifier*, *secret* or *endpoint* looks for the other
roles within ``SCOPE`` code points of its own start, in the same text. The interval join is an
equality join on bins of that length: each text's parts are first reduced to the least and
greatest start per bin and role, and a weak part meets the three bins around it, so no pairs
within a text are formed.

Positions are code points, end exclusive. Splitting a text at its matches gives the gaps
between them; running sums of gaps and matches give the places. The narrow table of gaps is
written once to the shared folder; only texts that hold a part are expanded.

Defined cases: a NULL or empty text has no spans; a NULL id is kept; repeated rows are scanned
each for itself; an empty table gives no rows; other columns are carried by ``redact`` and not
read by ``scan``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path

SCOPE = 256
ID, SECRET, ENDPOINT = 1, 2, 4


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` and ``least`` say which group must have how many characters.

    Every match holds one of the ``needs`` strings: texts without them skip the pattern.
    """

    name: str
    pattern: str
    group: int
    least: int
    role: int
    needs: tuple[str, ...] = ()
    weak: bool = False


#: Fixed order: it decides ties between spans that start together.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, SECRET, (":", "=")),
    Kind("access", r"(AKIA[A-Z0-9]+)", 1, 18, ID, ("AKIA",)),
    # Runs under 16 characters fail whole, so the pattern may ask for 16 at once.
    Kind("hex", r"((?<![0-9a-f])[0-9a-f]{16,})", 1, 16, SECRET),
    Kind("weak_secret", r"""(?i)\b((?:password|passwd|passphrase|pwd|secret|token|api_?key|private_?key)["']?\x20{0,8}[:=]\x20{0,8}["']?[^\s"']{4,})""", 1, 4, SECRET, (":", "="), True),
    Kind("weak_identifier", r"""(?i)\b((?:user_?name|user|login|client_?id|account_?id|key_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9@._+-]{3,})""", 1, 3, ID, (":", "="), True),
    Kind("weak_endpoint", r"""(?i)\b((?:https?|ftp|sftp|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[^\s"'<>]+)""", 1, 8, ENDPOINT, ("://",), True),
)
BASE = tuple(k for k in KINDS if not k.weak)

CUTS = "array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"


def _cut(text: str, df: DataFrame) -> DataFrame:
    """Add ``_cuts``: for each match its kind, number, the gap before it, its length, and if it holds."""
    for n, kind in enumerate(KINDS):
        may = reduce(or_, [F.contains(F.col(text), F.lit(x)) for x in kind.needs], F.lit(not kind.needs))
        df = df.withColumn(f"_pieces{n}", F.when(may, F.split(text, kind.pattern, -1)))
    for n, kind in enumerate(KINDS):
        found = F.size(f"_pieces{n}") > 1  # most texts have no match: one pass each
        df = df.withColumn(f"_whole{n}", F.when(found, F.regexp_extract_all(text, F.lit(kind.pattern), 0)))
        df = df.withColumn(f"_group{n}", F.when(found, F.regexp_extract_all(text, F.lit(kind.pattern), kind.group)))
    cuts = []
    for n, kind in enumerate(KINDS):
        gaps = F.slice(f"_pieces{n}", 1, F.size(f"_pieces{n}") - 1)
        zipped = F.zip_with(F.zip_with(f"_whole{n}", f"_group{n}", _lengths), gaps, lambda x, gap: F.struct(x.alias("x"), F.length(gap).alias("gap")))
        cuts.append(F.coalesce(F.transform(zipped, _numbered(n, kind.least)), F.array().cast(CUTS)))
    return df.withColumn("_cuts", F.concat(*cuts)).drop(*[f"_{part}{n}" for n in range(len(KINDS)) for part in ("pieces", "whole", "group")])


def _lengths(whole: Column, group: Column) -> Column:
    return F.struct(F.length(whole).alias("len"), F.length(group).alias("group"))


def _numbered(n: int, least: int):
    return lambda x, i: F.struct(
        F.lit(n).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["x"]["len"].alias("len"), (x["x"]["group"] >= least).alias("ok")
    )


def _staged(df: DataFrame, text: str, drop_text: bool) -> DataFrame:
    """The columns of ``df`` with ``_uid`` and ``_cuts``, written once so that ids are stable."""
    path = scratch_path(df.sparkSession, "secret-parts")
    cut = _cut("_body", df.withColumn("_body", F.coalesce(F.col(text), F.lit("")))).drop("_body", *[text] * drop_text)
    cut.withColumn("_uid", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _spans(staged: DataFrame) -> DataFrame:
    """_uid, kind, start, stop of base spans and linked weak spans."""
    cuts = staged.where(F.size("_cuts") > 0).select("_uid", F.inline("_cuts"))
    running = Window.partitionBy("_uid", "kind").orderBy("i")
    placed = cuts.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(running).cast("bigint"))
    placed = placed.where("ok").select("_uid", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop")
    weak_from = len(BASE)
    role = F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), F.col("kind") + 1)
    # A weak part that starts inside a strong span of its text is that span, not another part.
    reach = F.max(F.when(F.col("kind") < weak_from, F.col("stop"))).over(Window.partitionBy("_uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    parts = placed.withColumn("_reach", reach).where((F.col("kind") < weak_from) | F.col("_reach").isNull() | (F.col("_reach") <= F.col("start")))
    parts = parts.drop("_reach").withColumn("role", role).withColumn("bin", F.floor(F.col("start") / SCOPE))
    bins = parts.groupBy("_uid", "bin", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    bins = bins.select(F.col("_uid").alias("_u"), F.col("bin").alias("_b"), F.col("role").alias("_r"), "lo", "hi")
    weak = parts.where(F.col("kind") >= weak_from).withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    met = weak.join(bins, (weak["_uid"] == bins["_u"]) & (weak["near"] == bins["_b"]))
    met = met.where(
        (F.col("near") == F.col("bin"))
        | ((F.col("near") < F.col("bin")) & (F.col("hi") >= F.col("start") - SCOPE))
        | ((F.col("near") > F.col("bin")) & (F.col("lo") <= F.col("start") + SCOPE))
    )
    roles = met.groupBy("_uid", "kind", "start", "stop", "role").agg(F.bit_or("_r").alias("roles"))
    has = lambda r: F.col("roles").bitwiseAND(F.lit(r)) != 0
    linked = roles.where(
        ((F.col("role") == ID) & has(SECRET))
        | ((F.col("role") == SECRET) & (has(ID) | has(ENDPOINT)))
        | ((F.col("role") == ENDPOINT) & has(ID) & has(SECRET))
    )
    cols = ["_uid", "kind", "start", "stop"]
    return parts.where(F.col("kind") < weak_from).select(*cols).unionByName(linked.select(*cols))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _by_text(staged: DataFrame) -> DataFrame:
    """_uid and its spans (start, kind, stop), sorted. Spans of one text are bounded by its length."""
    packed = F.sort_array(F.collect_list(F.struct("start", "kind", "stop")))
    return _spans(staged).groupBy("_uid").agg(packed.alias("_spans"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked: one row per row of ``df``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    staged = _staged(rows, "_text", drop_text=True)
    found = staged.select("_uid", "doc_id").join(_by_text(staged), "_uid", "left")
    spans = F.coalesce("_spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>"))
    found = found.select("doc_id", spans.alias("s"))
    base = F.filter("s", lambda x: x["kind"] < len(BASE))
    count = lambda n: F.size(F.filter("s", lambda x: x["kind"] == n)).cast("bigint")
    return found.select(
        "doc_id", *[count(n).alias(f"n_{k.name}") for n, k in enumerate(BASE)],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"),
        (F.size("s") - F.size(base)).cast("bigint").alias("n_linked"),
    )


def redact(df: DataFrame, text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """``df`` with every reported span replaced by ``marker``; overlapping spans become one.

    All rows and columns stay (names starting with ``_uid``, ``_cuts``, ``_body``, ``_pieces``, ``_whole``,
    ``_group`` or ``_bits`` are reserved). Only texts that hold a span are joined and rewritten.
    """
    staged = _staged(df, text, drop_text=False)
    before = Window.partitionBy("_uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = _spans(staged).withColumn("reach", F.coalesce(F.max("stop").over(before), F.lit(0).cast("bigint")))
    bits = F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "reach"))).alias("_bits")
    bits = spans.groupBy("_uid").agg(bits)
    held = staged.where(F.size("_cuts") > 0).join(bits, "_uid", "left")
    sub = lambda start, n: F.substring(F.col(text), (start + 1).cast("int"), n.cast("int"))
    parts = F.transform("_bits", lambda s: F.when(
        (s["start"] >= s["reach"]) & ((s["start"] > s["reach"]) | (s["reach"] == 0)),
        F.concat(sub(s["reach"], s["start"] - s["reach"]), F.lit(marker)),
    ).otherwise(F.lit("")))
    end = F.array_max(F.transform("_bits", lambda s: s["stop"]))
    clean = F.concat(F.array_join(parts, ""), sub(end, F.length(text).cast("bigint")))
    held = held.withColumn(text, F.when(F.col("_bits").isNull(), F.col(text)).otherwise(clean))
    return staged.where(F.size("_cuts") == 0).select(*df.columns).unionByName(held.select(*df.columns))
