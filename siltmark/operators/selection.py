"""Exact seeded selection: rank rows by hash, or keep the lowest k of every group.

The order is (md5 of salt, seed and row id; row id). Because the key is uniform, the k-th
lowest row of a group of n sits near the fraction k/n of the key range. One narrow scan
counts groups, a second counts the rows below a small bracket around k/n and orders only
the rows inside it (about 20 * sqrt(k) of them). The outcome is one exact cut key per
group, so selecting is a filter: no row of the table is shuffled or sorted.

Keys that are not uniform (ids repeated in bulk) can miss a bracket. The range of such a cut is
then narrowed two hex digits at a time: every round counts the rows of each digit pair inside
the tasks and descends into the pair that holds the k-th row, until few rows or one key remain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.hashing import seed_key
from siltmark.functions.scratch import written
from siltmark.functions.sizing import SMALL_ROWS, local_side, small_side, small_table

Quota = Callable[[Column], Column]

KEY_END = "g"  # sorts after every hex digit
FRACTION_DIGITS = 12
FRACTION_SCALE = float(16**FRACTION_DIGITS)
BUCKET_ROWS = 1_000_000
KEY_DIGITS, RADIX_DIGITS = 32, 2
#: A narrowed range of at most so many rows is ordered; a wider one is narrowed further.
RANGE_ROWS = 1 << 16
TIES = ("error", "whole")


def lowest_cuts(
    df: DataFrame,
    quotas: dict[str, Quota],
    seed: int,
    salt: str,
    row_id: str = "row_id",
    group: list[str] | None = None,
    slack: float = 10.0,
    ties: str = "error",
) -> DataFrame:
    """Cut keys of the lowest ``quotas[name](n)`` rows of each group.

    A cut inside rows of one id is an error, or, with ``ties="whole"``, takes all rows of that id.

    Returns ``group..., n_rows`` and per quota ``k_<name>, h_<name>, id_<name>``: the last
    selected key and row id (NULL where nothing is selected, ``KEY_END`` where all are).
    """
    if ties not in TIES:
        raise ValueError(f"ties must be one of {TIES}")
    group = list(group or [])
    keyed = df.select(*group, F.col(row_id).alias("_id"), seed_key(salt, seed, row_id).alias("_h"))
    wanted = F.array(
        *[F.struct(F.lit(n).alias("quota"), q(F.col("n_rows")).cast("bigint").alias("k")) for n, q in quotas.items()]
    )
    spread = f"({slack} * sqrt(cast(k as double)) + {slack})"
    sizes = (
        keyed.groupBy(*group)
        .agg(F.count("*").alias("n_rows"))
        .select(*group, "n_rows", F.inline(wanted))
        .withColumn("k", F.expr("greatest(0L, least(k, n_rows))"))
        .withColumns({"_lo": _key_at(f"((k - {spread}) / n_rows)", "''", ""), "_hi": _key_at(f"((k + {spread}) / n_rows)", "", f"'{KEY_END}'")})
    )
    table = small_table(sizes)
    sizes = local_side(sizes, table)
    is_open = F.expr("k > 0 and k < n_rows")
    n_open = sizes.where(is_open).count() if table is None else sum(
        0 < k < n for k, n in zip(table["k"].to_pylist(), table["n_rows"].to_pylist())
    )
    found = _resolve(keyed, sizes.where(is_open), n_open, group, ties)
    full = sizes.join(found, matches([*group, "quota"], "_f_"), "left").select(
        *group,
        "n_rows",
        "quota",
        "k",
        F.expr(f"case when k = 0 then null when k = n_rows then '{KEY_END}' else _cut_h end as h"),
        F.expr("case when k > 0 and k < n_rows then _cut_id end as id"),
    )
    wide = full.groupBy(*group, "n_rows").agg(
        *[F.expr(f"max(case when quota = '{n}' then {c} end) as {c}_{n}") for n in quotas for c in ("k", "h", "id")]
    )
    return small_side(wide)


def matches(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of each key with its prefixed copy on the other side of a join."""
    return F.expr(" and ".join(f"`{k}` <=> `{prefix}{k}`" for k in keys))


def _resolve(keyed: DataFrame, sizes: DataFrame, n_open: int, group: list[str], ties: str) -> DataFrame:
    """The k-th key of every (group, quota) with 0 < k < n: from its bracket, else by narrowing."""
    cut = _cuts_between(keyed, sizes, group)
    table = small_table(cut)
    n_found = cut.count() if table is None else table.num_rows
    if n_found < n_open:
        found = local_side(cut, table).select(*[f"_f_{c}" for c in (*group, "quota")])
        missed = sizes.join(found, matches([*group, "quota"], "_f_"), "left_anti")
        cut = cut.unionByName(_cuts_between(keyed, _narrowed(keyed, missed, group), group))
        table = small_table(cut)
    over = cut.where("_over").count() if table is None else sum(table["_over"].to_pylist())
    if over and ties == "error":
        # The key is (hash, id): a cut inside equal ids would select too many.
        raise ValueError("row ids repeat at a cut: selecting exactly k rows needs unique ids")
    return local_side(cut, table)


def _paired(keyed: DataFrame, cuts: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Every row beside the open cuts of its group; ``fields`` are the columns of a cut."""
    if group:
        return keyed.join(cuts.selectExpr(*[f"`{c}` as `_b_{c}`" for c in group], *fields), matches(group, "_b_"))
    structs = [F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in cuts.select(*fields).collect()]
    if not structs:
        return keyed.limit(0).select("*", *[F.lit(None).cast(cuts.schema[f].dataType).alias(f) for f in fields])
    return keyed.withColumn("_b", F.explode(F.array(*structs))).select("_id", "_h", *[F.col(f"_b.{f}").alias(f) for f in fields])


def _cuts_between(keyed: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """The cuts whose k-th key lies in [_lo, _hi)."""
    paired = _paired(keyed, sizes, group, ["quota", "k", "_lo", "_hi"])
    # Rows below a bracket collapse to one counted row per task before the shuffle.
    kept = [f"case when _h >= _lo then {c} end as {c}" for c in ("_h", "_id")]
    counted = (
        paired.where("_h < _hi")
        .select(*group, "quota", "k", *[F.expr(c) for c in kept])
        .groupBy(*group, "quota", "k", "_h", "_id")
        .agg(F.count("*").alias("_c"))
    )
    w = (
        Window.partitionBy(*group, "quota")
        .orderBy(F.col("_h").asc_nulls_first(), F.col("_id"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counted.withColumn("_end", F.sum("_c").over(w))
        .where("_h is not null and _end >= k and _end - _c < k")
        .selectExpr(*[f"`{c}` as `_f_{c}`" for c in group], "quota as _f_quota", "_h as _cut_h", "_id as _cut_id", "_end > k as _over")
    )


def _narrowed(keyed: DataFrame, cuts: DataFrame, group: list[str]) -> DataFrame:
    """``cuts`` with a range [_lo, _hi) of one key prefix each: the one that holds the k-th row.

    ``_k`` is the rank that is left below the prefix. A prefix grows until at most RANGE_ROWS rows
    share it, or it is a whole key, whose rows are then one counted row per id.
    """
    names = [*group, "quota", "k", "_k", "_p"]
    state, digits = small_side(cuts.select(*group, "quota", "k", F.col("k").alias("_k"), F.lit("").alias("_p"))), 0
    while digits < KEY_DIGITS:
        rows = _paired(keyed, state, group, ["quota", "k", "_k", "_p"]).where(F.expr(f"substring(_h, 1, {digits}) = _p"))
        digits += RADIX_DIGITS
        # At most 256 counts per cut and round.
        counts = rows.groupBy(*names[:-1], F.expr(f"substring(_h, 1, {digits})").alias("_p")).agg(F.count("*").alias("_c"))
        end = F.sum("_c").over(Window.partitionBy(*group, "quota").orderBy("_p"))
        here = counts.withColumn("_end", end).where("_end >= _k and _end - _c < _k").withColumn("_k", F.expr("_k - (_end - _c)")).select(*names, "_c")
        table = small_table(here)
        if table is None:
            here = written(here, "narrowed-cuts")
        widest = here.agg(F.max("_c")).head()[0] if table is None else max(table["_c"].to_pylist(), default=0)
        state = local_side(here, table).select(*names)
        if (widest or 0) <= RANGE_ROWS:
            break
    return state.select(*group, "quota", "k", F.col("_p").alias("_lo"), F.concat("_p", F.lit(KEY_END)).alias("_hi"))


def _key_at(fraction: str, start: str, end: str) -> Column:
    """Hex key at a fraction of the range; ``start``/``end`` stand for its open ends."""
    digits = f"lpad(lower(hex(cast(floor({fraction} * {FRACTION_SCALE}D) as bigint))), {FRACTION_DIGITS}, '0')"
    if start:
        return F.expr(f"case when {fraction} <= 0 then {start} else {digits} end")
    return F.expr(f"case when {fraction} >= 1 then {end} else {digits} end")


def mark_lowest(
    df: DataFrame,
    cuts: DataFrame,
    names: list[str],
    seed: int,
    salt: str,
    row_id: str = "row_id",
    group: list[str] | None = None,
    prefix: str = "in_",
) -> DataFrame:
    """Add boolean ``<prefix><name>`` per quota; rows of groups without a cut get FALSE."""
    group = list(group or [])
    h, i = f"md5(concat_ws(':', '{salt}', '{seed}', cast(`{row_id}` as string)))", f"`{row_id}`"
    # (h, id) up to the cut, NULL ids first; a missing cut selects nothing. Keys decide almost every
    # row, so an id that is costly to make is not made once more to be compared.
    upto = lambda cut_h, cut_id: f"coalesce({h} <= {cut_h} and ({h} < {cut_h} or {i} is null or coalesce({i} <= {cut_id}, false)), false)"
    if not group:
        row, kind = cuts.head(), df.schema[row_id].dataType
        if not row:
            return df.withColumns({f"{prefix}{n}": F.lit(False) for n in names})
        key, own = F.expr(h), F.col(f"`{row_id}`")
        cut = lambda n: (F.lit(row[f"h_{n}"]).cast("string"), F.lit(row[f"id_{n}"]).cast(kind))
        flag = lambda at, last: F.coalesce((key <= at) & ((key < at) | own.isNull() | F.coalesce(own <= last, F.lit(False))), F.lit(False))
        return df.withColumns({f"{prefix}{n}": flag(*cut(n)) for n in names})
    fields = [f"{c}_{n}" for n in names for c in ("h", "id")]
    right = cuts.selectExpr(*[f"`{c}` as `_g_{c}`" for c in group], *fields)
    joined = df.join(right, matches(group, "_g_"), "left")
    flags = [F.expr(f"{upto(f'h_{n}', f'id_{n}')} as `{prefix}{n}`") for n in names]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *flags)


def lowest_rows(df: DataFrame, quota: Quota, seed: int, salt: str, row_id: str = "row_id", slack: float = 10.0) -> DataFrame:
    """The lowest ``quota(n)`` rows of the whole table, for few rows of many: one scan writes the
    rows below a key that lies a little above the cut, and the rest is done on those."""
    size = df.agg(F.count("*").alias("n_rows")).select("n_rows", quota(F.col("n_rows")).cast("bigint").alias("k")).head()
    n, k = size["n_rows"], max(0, min(size["k"], size["n_rows"]))
    if 0 < k < n:
        share = (k + slack * k**0.5 + slack) / n
        if share < 1:
            top = f"{int(share * FRACTION_SCALE):0{FRACTION_DIGITS}x}"
            near = written(df.where(seed_key(salt, seed, row_id) < F.lit(top)), "lowest-rows")
            if near.count() >= k:
                df = near
    return select_lowest(df, lambda rows: F.least(F.lit(k).cast("bigint"), rows), seed, salt, row_id)


def select_lowest(
    df: DataFrame,
    k: int | Quota,
    seed: int,
    salt: str,
    row_id: str = "row_id",
    group: list[str] | None = None,
    ties: str = "error",
) -> DataFrame:
    """The lowest ``k`` rows of every group (all rows of smaller groups).

    With ``ties="whole"`` ids may repeat: the id that holds the k-th row comes with all its rows.
    """
    quota = k if callable(k) else (lambda n: F.least(F.lit(int(k)).cast("bigint"), n))
    cuts = lowest_cuts(df, {"k": quota}, seed, salt, row_id, group, ties=ties)
    marked = mark_lowest(df, cuts, ["k"], seed, salt, row_id, group, prefix="_in_")
    return marked.where(F.col("_in_k")).drop("_in_k")


def hash_rank(
    df: DataFrame,
    seed: int,
    salt: str,
    row_id: str = "row_id",
    group: list[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``hash_rank``: 1-based rank of every row in its group, without a giant window.

    Rows are ordered inside (group, key prefix) buckets of about ``bucket_rows`` rows; the
    rank is the bucket's offset plus the local position. The prefix length comes from the
    measured size of the largest group.
    """
    group = list(group or [])
    largest = df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    digits = 0
    while digits < 8 and largest > bucket_rows * 16**digits:
        digits += 1
    keyed = df.withColumn("_h", seed_key(salt, seed, row_id))
    if digits == 0:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_h", row_id)
        return keyed.withColumn("hash_rank", F.row_number().over(w).cast("bigint")).drop("_h")
    keyed = keyed.withColumn("_p", F.substring("_h", 1, digits))
    local = Window.partitionBy(*group, "_p").orderBy("_h", row_id)
    ranked = keyed.withColumn("_r", F.row_number().over(local))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_p").alias("_g__p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    # Past the broadcast bound the join shares the rank's own partitioning instead.
    side = small_side(offsets) if 16**digits <= SMALL_ROWS else offsets
    out = ranked.join(side, matches([*group, "_p"], "_g_"))
    return out.withColumn("hash_rank", F.col("_off") + F.col("_r")).drop("_h", "_p", "_r", "_g__p", "_off", *[f"_g_{c}" for c in group])
