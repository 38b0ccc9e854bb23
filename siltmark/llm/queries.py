"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.scratch import scratch_path
from siltmark.llm import ann, bpe, lines, minhash, packing, phrases, pii, quality, resample, secrets, sharding, substrings, warc

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


QUERIES["pipeline"] = corpus_pipeline.run


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, d, "documents"), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


SQL_LINES = r"""
WITH d AS (
  SELECT doc_id, text, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents
), l AS (
  SELECT doc_id, i, ls[i] AS line, len([w FOR w IN string_split_regex(ls[i], '[\x20\x09-\x0D]+') IF w <> '']) AS n
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), c AS (
  SELECT doc_id, i, line, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS through FROM l
), f AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.through - (a.through - a.n) >= 50 GROUP BY 1, 2
), g AS (
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.through - (a.through - a.n) >= 50 GROUP BY b.doc_id, b.i
), runs AS (
  SELECT DISTINCT doc_id, s, e FROM (SELECT doc_id, s, e FROM f UNION ALL SELECT doc_id, s, e FROM g)
), named AS (
  SELECT r.doc_id, s, e, array_to_string(d.ls[s:e], chr(10)) AS body FROM runs r JOIN d ON r.doc_id = d.doc_id
), later AS (
  SELECT doc_id, s, e FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM named) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM later
), raw AS (
  SELECT doc_id, j, x[j] AS line, regexp_matches(x[j], '[^\x20\x09-\x0D]') AS word
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
), numbered AS (
  SELECT doc_id, j, line, word, sum(word::INT) OVER (PARTITION BY doc_id ORDER BY j) AS i FROM raw
), marked AS (
  SELECT n.*, g.i IS NOT NULL AS hit, h.i IS NOT NULL AS next_hit
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i LEFT JOIN gone h ON n.doc_id = h.doc_id AND n.i + 1 = h.i
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY j) AS body FROM marked WHERE NOT (CASE WHEN word THEN hit ELSE hit AND next_hit END) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.ls)::BIGINT AS n_lines, coalesce(counts.n, 0)::BIGINT AS n_deleted, length(coalesce(kept.body, ''))::BIGINT AS n_chars,
  sha256(coalesce(kept.body, '')) AS text_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN counts ON d.doc_id = counts.doc_id
"""


@query("op2_lines", SQL_LINES)
def op2_lines(spark: SparkSession, d: str) -> DataFrame:
    clean = lines.dedup(table(spark, d, "documents"))
    body = F.coalesce("text", F.lit(""))
    return clean.select("doc_id", "n_lines", "n_deleted", F.length(body).cast("bigint").alias("n_chars"), F.sha2(body, 256).alias("text_sha256"))


@query("op4_packing")
def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    found = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(found, docs.count(), ["doc_id", "piece", "length", "ids_crc32"])


@query("op6_pii")
def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.scan(table(spark, d, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("bigint")
    return found.select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


@query("op7_warc")
def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.marked(table(spark, d, "pages")), path)
    records = warc.read_archives(spark.read.parquet(path))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Two regions of two racks of four shards, and the same tree with one shard more."""
    tree = sharding.uniform_tree(2, 2, 4)
    return sharding.shard_documents(table(spark, d, "documents"), tree, sharding.grown(tree))


@query("op8_minhash")
def op8_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"))


SQL_QUALITY = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM rep) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
), b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
"""


@query("op9_quality", SQL_QUALITY)
def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    led = quality.ledger(table(spark, d, "documents"))
    base = ~quality.passes("v1-base")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & quality.passes()).alias("kept"), "failed",
    )


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"), lambda vec_id: vec_id % 20 == 0)


SQL_RESAMPLE = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws
  FROM documents
), b AS (
  SELECT [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws
  FROM benchmark
), dw AS (
  SELECT doc_id, unnest(ws) AS w FROM d
), bw AS (
  SELECT unnest(ws) AS w FROM b
), bytes AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), crc AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], [('0x' || x[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, len(x) // 2 + 1)]),
    lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 10000 AS k
  FROM bytes
), s AS (
  SELECT k, count(*) AS s FROM dw JOIN crc ON dw.w = crc.w GROUP BY k
), t AS (
  SELECT k, count(*) AS t FROM bw JOIN crc ON bw.w = crc.w GROUP BY k
), g AS (
  SELECT s.k, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((s.s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.k = t.k
), wt AS (
  SELECT dw.doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN crc ON dw.w = crc.w JOIN g ON crc.k = g.k GROUP BY dw.doc_id
), sc AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN wt ON d.doc_id = wt.doc_id
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20
)
SELECT sc.doc_id, n_features, weight, score, r.rank FROM sc LEFT JOIN r ON sc.doc_id = r.doc_id AND r.rank <= r.n * 10 // 100
"""


@query("op12_resample", SQL_RESAMPLE)
def op12_resample(spark: SparkSession, d: str) -> DataFrame:
    drawn = resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL_PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM p
), g AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g3 AS (
  SELECT lang, ws[i] AS a, CASE WHEN i < len(ws) THEN ws[i + 1] END AS b, CASE WHEN i + 1 < len(ws) THEN ws[i + 2] END AS c FROM g
), f1 AS (
  SELECT lang, a, count(*) AS f FROM g3 GROUP BY lang, a
), f2 AS (
  SELECT lang, a, b, count(*) AS f FROM g3 WHERE b IS NOT NULL GROUP BY lang, a, b
), f3 AS (
  SELECT lang, a, b, c, count(*) AS f FROM g3 WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 10
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), longer AS (
  SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY lang, a, b
), two AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON f2.lang = x.lang AND f2.a = x.a JOIN f1 y ON f2.lang = y.lang AND f2.b = y.a
    LEFT JOIN longer z ON f2.lang = z.lang AND f2.a = z.a AND f2.b = z.b
  WHERE f2.f >= 10 AND (z.f IS NULL OR 100 * z.f < 50 * f2.f)
), cuts AS (
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
    (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (xy.f::HUGEINT * z.f) AS s2
  FROM f3 JOIN f1 x ON f3.lang = x.lang AND f3.a = x.a JOIN f1 z ON f3.lang = z.lang AND f3.c = z.a
    JOIN f2 xy ON f3.lang = xy.lang AND f3.a = xy.a AND f3.b = xy.b JOIN f2 yz ON f3.lang = yz.lang AND f3.b = yz.a AND f3.c = yz.b
), found AS (
  SELECT * FROM two
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n ON ranked.lang = n.lang WHERE rank <= 2000
"""


@query("op13_phrases", SQL_PHRASES)
def op13_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(table(spark, d, "documents"))


SQL_SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS body FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM w) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM later)
), words AS (
  SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS body FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i
  WHERE gone.i IS NULL GROUP BY words.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(counts.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM d LEFT JOIN counts ON d.doc_id = counts.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op11_substrings", SQL_SUBSTRINGS)
def op11_substrings(spark: SparkSession, d: str) -> DataFrame:
    clean = substrings.dedup(table(spark, d, "documents").select("doc_id", "text"), joined=True)
    return clean.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
