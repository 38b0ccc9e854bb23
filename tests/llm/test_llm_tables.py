"""Archives, neighbours, the pipeline, and the registration of the numbered queries."""

import base64
import hashlib
import os
import struct
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry
import corpus_pipeline
from siltmark.llm import ann, packing, quality, warc

SF_DIR = "/root/testdata/sf0.001"


def digest(s):
    return base64.b32encode(hashlib.sha1(s).digest()).decode()


def test_warc_round_trip(spark, folder):
    big = "<p>" + "é" * 200_000
    rows = [(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", "one"), (7, "u", "one"), (None, "u", "same"), (None, None, None)]
    rows += [(100 + i, "u", f"<html>{i % 40} text of a page</html>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    warc.write_archives(warc.marked(pages), f"{folder}/a")
    got = warc.read_archives(spark.read.parquet(f"{folder}/a")).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        response = first.get(h or "") == i
        want.append((i, "response" if response else "revisit", None if response else first[h or ""], len(p), digest(p)))
    have = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr) and not any(r["error"] for r in got)
    assert all(bytes(r["payload"]) == dict((x[0], (x[2] or "").encode()) for x in rows)[r["page_id"]] for r in got if r["record_type"] == "response")
    warc.write_archives(warc.marked(pages.limit(0)), f"{folder}/b")
    assert warc.read_archives(spark.read.parquet(f"{folder}/b")).count() == 0


def archive(rows):
    a = warc._Archive()
    for i, p in rows:
        a.add(warc.record(i, "u", p, None, False))
    return a.bytes()


def test_warc_hot_payload_is_split(spark):
    """Half of the pages hold one payload: no task gets all of them, and the marks are right."""
    small = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k) for k in small}
    hot = F.repeat(F.lit("<p>all the same</p>"), 40)
    own = F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat(F.lit("x"), "id"), 512))
    pages = spark.range(0, 6000, 1, 16).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 1, hot).otherwise(own).alias("html"))
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = warc.marked(pages).select("page_id", "revisit", "refers_to", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 6000
    assert all((r["revisit"], r["refers_to"]) == ((True, 1) if r["page_id"] % 2 and r["page_id"] > 1 else (False, None)) for r in got)
    parts = Counter(r["part"] for r in got if r["page_id"] % 2)
    assert len(parts) > 1 and max(parts.values()) < 2000


def test_warc_dictionary_and_damage():
    data = archive([(i, b"<html>page %d of many with much the same words</html>" % i) for i in range(250)])
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    found = [warc.parse(f) for f in warc.frames(data)]
    assert len(found) == 250 and found[7]["payload"].startswith(b"<html>page 7 ")
    packed = struct.unpack_from("<I", data, 4)[0]
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + packed])
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw + data[8 + packed :]
    assert len(list(warc.frames(plain))) == 250  # a dictionary that is not compressed
    good = list(warc._records("a", data))
    cut = list(warc._records("a", data[:-5]))
    assert cut[:-1] == good[:-1] and cut[-1]["error"] == "cut short"
    whole = warc.record(1, "u", b"abc", None, False)
    for bad in (whole.replace(b"Content-Length: 3", b"Content-Length: 4"), whole.replace(b"\r\nabc", b"\r\nabd"), whole[8:], whole.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.Damaged):
            warc.parse(bad)


def test_binary_file_archives(spark, folder):
    with open(f"{folder}/x.warc.zst", "wb") as f:
        f.write(archive([(1, b"a"), (2, b"b")]))
    got = warc.read_archives(spark.read.format("binaryFile").load(f"{folder}/x.warc.zst")).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in got] == [(1, b"a"), (2, b"b")]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 16)).astype("f4")
    x[100:400] = x[100]  # a third is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (None, [1.0] * 16), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("node", F.lit(1)).repartition(4)
    got = {}
    for r in ann.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    exact, hits = x.astype("f8") @ x.astype("f8").T, 0
    for q, found in got.items():
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-round(exact[q, i], 9), i))[:20]
        hits += len({i for i, _ in found} & set(order))
        assert len(found) == 20 and all(abs(s - exact[q, i]) < 1e-9 for i, s in found)
    assert hits / 20 / len(got) > 0.95
    few = spark.createDataFrame(rows[:5], "vec_id bigint, embedding array<float>")
    assert ann.nearest(few, lambda i: i == 0).count() == 4
    assert ann.nearest(df.limit(0), lambda i: i == 0).count() == 0


def test_neighbours_in_a_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1600, 64)).astype("f4")
    x[400:] = x[400] + 1e-3 * rng.standard_normal((1200, 64)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df, lambda i: (i >= 400) & (i % 40 == 0)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact, hits = x.astype("f8") @ x.astype("f8").T, 0
    for q, found in got.items():
        hits += len(found & set(sorted((i for i in range(1600) if i != q), key=lambda i: -exact[q, i])[:20]))
    print("recall", hits / 20 / len(got))
    assert len(got) == 30 and hits / 20 / len(got) > 0.95


def test_search_holds_few_queries_at_once():
    """However many queries a batch has, a task of the search makes batches of bounded size; nothing is lost."""
    n, wide = 100, 1500
    rng = np.random.default_rng(2)
    lists = [[rng.choice(9_000, 30, replace=False).tolist() for _ in range(wide // 30)] for _ in range(n)]
    met = [sorted(rng.choice(9_000, 500, replace=False).tolist()) for _ in range(n)]
    code = [bytes([i]) * 9 for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"query": pa.array(range(n)), "qcode": pa.array(code), "met": pa.array(met), "edges": pa.array(lists)})
    out = list(ann._candidates(iter([batch])))
    assert max(map(len, out)) < ann.CHUNK + wide and len(out) > 1
    want = {(q, v, code[q]) for q in range(n) for v in {x for e in lists[q] for x in e} - set(met[q])}
    got = [(r["query"], r["node"], r["qcode"]) for b in out for r in b.to_pylist()]
    assert len(got) == len(want) and set(got) == want

    pool = [sorted(m[:450], key=lambda v: -v)[:400] for m in met]
    found = [[{"node": v, "s": float(v)} for v in range(20_000 + q, 20_003 + q)] if q % 3 else None for q in range(n)]
    state = {"query": pa.array(range(n)), "qcode": pa.array(code), "pool": pa.array(pool), "score": pa.array([list(map(float, p)) for p in pool])}
    state |= {"done": pa.array([[True, False] * (len(p) // 2) for p in pool]), "met": pa.array(met), "found": pa.array(found)}
    out = list(ann._advance(iter([pa.RecordBatch.from_pydict(state)])))
    assert max(map(len, out)) <= ann.BLOCK and sum(map(len, out)) == n
    for r in (r for b in out for r in b.to_pylist()):
        q = r["query"]
        new = [x["node"] for x in found[q] or []]
        assert r["qcode"] == code[q] and r["met"] == sorted(met[q] + new)
        assert r["pool"] == sorted(pool[q] + new, reverse=True)[: ann.POOL] and r["score"] == list(map(float, r["pool"]))
        opened = [v for v, d in zip(pool[q], [True, False] * 200) if not d][: ann.EXPAND]
        closed = {v for v, d in zip(pool[q], [True, False] * 200) if d} | set(opened)
        assert r["done"] == [v in closed for v in r["pool"]]


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")
@pytest.mark.parametrize("name", ["op2_lines", "op9_quality"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    got = entry.queries()[name](spark, SF_DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == sorted((tuple(r) for r in cur.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")
def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.union(docs.limit(1).select(F.lit(10**6).cast("bigint"), F.lit(None).cast("string"), "lang", "source", "n_chars"))
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        sizes.append(docs.count())
        if k == 0:
            assert sizes[0] == quality.ledger(before).where(quality.passes()).count() < before.count()
        if k == 3:
            assert sizes[3] == sizes[2] and docs.where("n_chars <> length(text)").count() == 0
            assert docs.where("text rlike '[0-9a-f]{16,}'").count() == 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert sizes[0] >= sizes[1] >= sizes[2]


def test_pipeline_deletes_short_repeated_lines(spark):
    rows = [(1, "share this page\nfirst of all"), (2, "second text\n\nshare this page\nends here"), (3, "share this page"), (4, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = [tuple(r) for r in corpus_pipeline.line_dedup(spark, docs, SF_DIR).orderBy("doc_id").collect()]
    assert got == [(1, rows[0][1], 28), (2, "second text\n\nends here", 22), (4, None, 0)]


def test_pipeline_returns_the_packed_ids(spark):
    """Every sequence can be rebuilt from the result, also with repeated rows and ids."""
    texts = [(1, "one two three"), (1, "one two three"), (1, "other words"), (None, "one two three"), (2, None), (3, " ".join(f"w{i}x" for i in range(1500)))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    tok = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i, tok.encode(t or "") + bytes(4)) for i, t in texts), key=repr)
    rows = corpus_pipeline.pack(spark, docs, SF_DIR).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    cells = [(r["sequence_id"], r["offset"] + k) for r in rows for k in range(r["length"])]
    assert len(cells) == len(set(cells)) and max(c for _, c in cells) < packing.CAPACITY
    parts = sorted((r for r in rows if r["doc_id"] == 3), key=lambda r: r["start"])
    assert len(parts) > 1
    whole = [(r["doc_id"], bytes(r["ids"])) for r in rows if r["doc_id"] != 3] + [(3, b"".join(bytes(r["ids"]) for r in parts))]
    assert sorted(whole, key=repr) == want


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")
def test_pipeline_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
