"""Reading labelled flow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions.hashing import content_key
from siltmark.functions.sizing import local_side, small_side, small_table

CORRUPT = "_corrupt_record"
COPIES_PER_CHUNK = 100_000
HASH_BUCKETS = 1 << 16


def text_cell(text: Column) -> Column:
    """A text as a CSV cell that any line-wise reader gives back whole: percent-encoded, so that it
    holds no blank, line end, quote or separator; a lone ``%`` is the empty text, no cell is NULL."""
    return F.when(text == "", F.lit("%")).otherwise(F.url_encode(text))


def cell_text(cell: Column) -> Column:
    """The text of a ``text_cell``."""
    return F.when(cell == "%", F.lit("")).otherwise(F.try_url_decode(cell))


def read_flows(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None, encoded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(rows, bad)`` from CSV or Parquet under a declared schema.

    CSV: fields are matched to the trimmed header by name, in any order; a declared field that the
    header lacks raises an error, further fields are left out. Files read together share one
    header: Spark checks the first line of each when it reads it, and another one is an error. Values are trimmed, ``Inf``, ``Infinity`` and ``NaN`` parse as such, and a line
    that does not fit the schema goes to ``bad`` with its text. Bad rows are split off by a
    filter on the same scan. Text columns named in ``encoded`` were written by ``text_cell``: only
    these keep empty texts, outer blanks and line ends.
    """
    kind = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        rows = spark.read.schema(schema).parquet(path)
        return rows, rows.select(F.lit("").alias(CORRUPT)).where(F.lit(False))
    declared = {f.name: f for f in schema.fields}
    header = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
    if missing := [n for n in declared if n not in header]:
        raise ValueError(f"the header lacks {missing}")
    found = [declared.get(c, T.StructField(c, T.StringType())) for c in header]
    full = T.StructType([*found, T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(full)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    # The scan parses only the columns a query asks for, and a line whose bad field is not
    # parsed would pass. Hashing every field in both filters keeps them all requested, so
    # which rows are bad does not depend on what is selected later.
    parsed = F.xxhash64(*[F.col(f.name) for f in schema.fields]) >= F.lit(-(2**63))
    bad = F.col(CORRUPT).isNotNull()
    names = [cell_text(F.col(f.name)).alias(f.name) if f.name in encoded else F.col(f.name) for f in schema.fields]
    return raw.where(parsed & ~bad).select(*names), raw.where(parsed & bad).select(*names, CORRUPT)


def trim_headers(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def with_row_id(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """A stable id for rows without a key: md5 of the content of ``columns``, plus a copy number
    for rows that share it (``<md5>-2`` for the second). Every row keeps its values as they are.

    Rows are numbered within their id by one shuffle of the ids and the columns asked for. Hashes
    shared by more than COPIES_PER_CHUNK rows are found first, by counts of few hash buckets that
    combine in each task; their rows are grouped with their whole-row copies, counted, and written
    out again in chunks, so even a row that makes up a third of the table is never gathered in one
    place.
    """
    named = columns or df.columns
    entire = set(named) == set(df.columns)
    brief = df.withColumn("_b", F.xxhash64(*named))
    bucket = F.pmod("_b", F.lit(HASH_BUCKETS).cast("bigint"))
    over = F.col("_n") > COPIES_PER_CHUNK
    crowded = brief.groupBy(bucket.alias("_g")).agg(F.count("*").alias("_n")).where(over).select("_g")
    table = small_table(crowded)  # complete: there are at most HASH_BUCKETS
    if not table.num_rows:
        return _numbered(df, named, row_id)
    inside = brief.join(local_side(crowded, table), bucket == F.col("_g"), "left_semi")
    hot = small_side(inside.groupBy("_b").agg(F.count("*").alias("_n")).where(over).select(F.col("_b").alias("_s")))
    rest = brief.join(hot, F.col("_b") == F.col("_s"), "left_anti").select(*df.columns)
    many = brief.join(hot, F.col("_b") == F.col("_s"), "left_semi").drop("_b").withColumn("_k", content_key(named))
    many = many.withColumn("_whole", F.col("_k") if entire else content_key(df.columns))
    chunk = F.lit(COPIES_PER_CHUNK).cast("bigint")
    row = F.any_value(F.struct(*df.columns)).alias("_row")
    many = many.groupBy("_k", "_whole").agg(F.count("*").alias("_n"), row)
    before = Window.partitionBy("_k").orderBy("_whole").rowsBetween(Window.unboundedPreceding, -1)
    many = many.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / chunk).cast("bigint"))
    many = many.withColumn("_c", F.explode(chunks)).repartition("_k", "_whole", "_c")
    first = F.col("_c") * chunk + 1
    many = many.withColumn("_i", F.explode(F.sequence(first, F.least(F.col("_n"), first + chunk - 1))))
    number = F.col("_at") + F.col("_i")
    name = F.when(number == 1, F.col("_k")).otherwise(F.concat_ws("-", "_k", number.cast("string")))
    return _numbered(rest, named, row_id).unionByName(many.select("_row.*", name.alias(row_id)))


def _numbered(df: DataFrame, named: list[str], row_id: str) -> DataFrame:
    """Rows with ids, numbered in the order of their whole content. Ids travel as 16 bytes."""
    order = F.col("_k") if set(named) == set(df.columns) else F.unhex(content_key(df.columns))
    keyed = df.withColumn("_k", F.unhex(content_key(named))).withColumn("_o", order)
    numbered = keyed.withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy("_o")))
    text = F.lower(F.hex("_k"))
    return numbered.select(*df.columns, F.when(F.col("_i") == 1, text).otherwise(F.concat_ws("-", text, F.col("_i").cast("string"))).alias(row_id))
