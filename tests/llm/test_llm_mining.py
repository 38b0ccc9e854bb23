"""Substring dedup, importance resampling and phrase mining against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltmark.llm import phrases, resample, substrings, textbytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(25))
TEXTS = [
    None, "", " \n\t ", "a", PASSAGE, PASSAGE, f"x y {PASSAGE} z", f"{PASSAGE}\n\n{PASSAGE}", LONG, LONG[:3000] + " q " + LONG[4000:9000],
    "Aa aA. AA aa; " * 300, "a " * 100, "É ñ Σ İ 中 42 " * 12, "one\x0btwo\x0cthree\rfour\tfive", "a.b,c;d:e!f?g " * 15, "\x00\x1f null " * 9,
]
BENCH = ["a b c d", None, "", "one two é", PASSAGE]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids repeat and are missing; the other columns bear names the operators use inside."""
    rows = [(i, t, ("en", "de", None, "und")[i % 4], 1, "k") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], None, None, None), (5, "other " + PASSAGE, "x", 2, "s"), (None, PASSAGE, "x", 2, "s"), (None, None, None, None, None)] + [(-3, "z " * 30, "de", 1, "t")] * 3
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int, seed string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def brute_substrings(rows, window=20):
    """Words left of each (id, text): ids in order, NULL first, then the given order of texts."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            if run in seen:
                gone |= set(range(k, k + window))
            seen.add(run)
        out[i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings_on_hostile_rows(docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not (r["doc_id"] == 5 and r["text"].startswith("other"))]
    one = docs.where("NOT (doc_id <=> 5 AND text LIKE 'other%')")
    got = substrings.dedup(one, factors="f").collect()
    assert len(got) == len(rows)
    want = brute_substrings(rows)
    originals = {}
    for i, t in rows:
        originals.setdefault(i, []).append(t)
    for r in got:
        same = [want[r["doc_id"], t] for t in originals[r["doc_id"]]]
        assert (r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"] or ""))) in same
        assert r["n_removed"] or r["text"] in originals[r["doc_id"]]  # byte for byte
    assert {r["lang"] for r in got} == {r["lang"] for r in one.collect()}
    assert substrings.dedup(nothing).count() == 0 and substrings.dedup(docs).count() == docs.count()
    with pytest.raises(ValueError, match="names of the operator"):
        substrings.dedup(docs.withColumn("n_words", F.lit(1)))


def test_substrings_at_factor_boundaries(spark):
    """Passages of 19 to 40 words, cut anywhere and edited, in random surroundings."""
    random.seed(5)
    source = [f"s{random.randint(0, 60)}" for _ in range(400)]
    rows = []
    for i in range(-40, 80):
        words = []
        for _ in range(random.randint(0, 5)):
            a = random.randrange(370)
            passage = source[a : a + random.randint(15, 45)]
            if random.random() < 0.4:
                passage[random.randrange(len(passage))] = "edit"
            words += passage + [f"r{random.randint(0, 3)}" for _ in range(random.randint(0, 12))]
        rows.append((i, " ".join(words)))
    rows.append((900, "b " * 70 + "c " * 50 + "b " * 70))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_substrings(rows)
    got = substrings.dedup(df, joined=True, factors="f").collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got} == {(i, *want[i, t]) for i, t in rows}
    assert sum(r["n_removed"] for r in got) > 2000
    texts = {i: t.split() for i, t in rows}
    for r in got:  # every factor is what it refers to, at an earlier place
        for f in r["f"]:
            assert f["n"] >= 20 and (f["ref_id"], f["ref_start"]) < (r["doc_id"], f["start"])
            assert texts[r["doc_id"]][f["start"] : f["start"] + f["n"]] == texts[f["ref_id"]][f["ref_start"] : f["ref_start"] + f["n"]]


def test_substrings_join_pieces_to_factors():
    pieces = np.array([(0, 30, 25, 1, 130), (0, 0, 30, 1, 100), (0, 10, 20, 2, 7), (0, 80, 20, 1, 180), (1, 100, 20, 1, 200)])
    row, start, n, ref, ref_start = pieces.T
    first, length = substrings.parse(row, start, n, [ref], ref_start)
    assert [(row[i], start[i], k, ref[i]) for i, k in zip(first, length.tolist())] == [(0, 0, 55, 1), (0, 10, 20, 2), (0, 80, 20, 1), (1, 100, 20, 1)]


def test_words_of_a_column_at_every_cut(monkeypatch):
    import pyarrow as pa

    random.seed(8)
    letters = textbytes.alphabet(b" \t", b".,\n", lower=True)
    for size in (1, 2, 3, 7, 50, 1 << 20):
        monkeypatch.setattr(textbytes, "CHUNK", size)
        texts = [None if random.random() < 0.1 else "".join(random.choice("abAB é. ,\t\n中") for _ in range(random.randint(0, 40))) for _ in range(60)]
        column = pa.array(["skipped", *texts]).slice(1)
        got = textbytes.whole(column, letters)
        data = textbytes.Column(column, letters).data
        want, names = [], {}
        for i, t in enumerate(texts):
            for k, piece in enumerate(re.split(r"[.,\n]", t or "")):
                want += [(i, k, w) for w in re.findall(r"[^ \t]+", piece)]
        assert got.row.tolist() == [w[0] for w in want]
        assert [data[a:b].tobytes().decode() for a, b in zip(got.start.tolist(), got.end.tolist())] == [w[2] for w in want]
        for (i, k, w), h, s in zip(want, got.h.tolist(), got.stop.tolist()):
            assert names.setdefault(w.lower() if w.isascii() else w.encode().lower().decode(), h) == h
            assert s == len(re.findall(r"[.,\n]", "".join(t or "" for t in texts[:i]))) + k
        assert len(set(names.values())) == len(names)


def test_phrase_counts_do_not_depend_on_stretches(monkeypatch):
    import pyarrow as pa

    random.seed(6)
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"] * 10, "text": [" ".join(random.choice("xyz.") for _ in range(random.randint(0, 30))) for _ in range(30)]})

    def total():
        out = Counter()
        for b in phrases.Pass([], True, False).count(batch):
            for r in b.to_pylist():
                out[tuple(r[f] for f in ("lang", "word", "h1", "h2", "h3"))] += r["c"]
        return out

    want = total()
    for chunk, flush in ((1, 1), (2, 3), (5, 8), (1 << 20, 4)):
        monkeypatch.setattr(textbytes, "CHUNK", chunk)
        monkeypatch.setattr(phrases, "FLUSH", flush)
        assert total() == want


def test_substrings_hot_group(spark):
    """A third of all rows equal, with and without ids; the first copy stays."""
    rows = [(None if i % 2 else i, PASSAGE) for i in range(300)] + [(1000 + i, f"only {i} " + PASSAGE) for i in range(300)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    n = {(r["doc_id"] is None, r["n_removed"]): r["c"] for r in got.groupBy("doc_id", "n_removed").agg(F.count("*").alias("c")).collect()}
    assert n == {(True, 0): 150, (False, 25): 1}
    assert got.where("n_removed = 25").count() == 450


def brute_resample(rows, bench, percent=10, least=20, seed=2024):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(bucket(w) for _, x in rows for w in split(x)), Counter(bucket(w) for x in bench for w in split(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    out = []
    for i, x in rows:
        w = split(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in w)
        out.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r) for r in out), key=repr)


def test_resample(spark, docs, nothing):
    bench = spark.createDataFrame([(t,) for t in BENCH], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + i, f"a b {i} one " + PASSAGE * (i % 3 + 1)) for i in range(150)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, score int, rank int").repartition(4)
    fields = ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in resample.resample(df, bench).select(*fields).collect()), key=repr)
    assert got == brute_resample(rows, BENCH) and sum(r[4] is not None for r in got) >= 15
    assert resample.resample(nothing, bench).count() == 0
    assert resample.resample(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("sort_rows, margin", [(5, 0.002), (40, 0.0), (10_000, 0.3)])
def test_cutoff_brackets(spark, sort_rows, margin):
    random.seed(9)
    values = [random.choice([7, 7, -(1 << 40), random.randint(-1000, 1000), 1 << 62]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").cache()
    for k in (1, 17, 250, 499, 500):
        v = sorted(values)[k - 1]
        assert resample.kth_least(df, k, margin, sort_rows) == (v, sum(x < v for x in values))
    with pytest.raises(ValueError):
        resample.kth_least(df, 501)


def test_ranks_of_equal_scores(spark):
    """Equal scores go by id; rows equal in both take no more places than are wanted."""
    rows = [(i % 50, 30, 30, 0, 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = [(r["doc_id"], r["rank"]) for r in resample.ranked(df, percent=5).collect()]
    assert len(got) == 200
    assert sorted((k, i) for i, k in got if k) == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 1), (8, 1), (9, 2), (10, 2)]


def brute_phrases(rows, least, top=2000):
    f, n = {}, Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(x[0] == lang and len(x[1]) == 3 and p in (x[1][:2], x[1][1:]) and c >= least and 100 * c >= 50 * a for x, c in f.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("least", [2, 5])
def test_phrases(spark, docs, nothing, least):
    random.seed(3)
    vocab = ["the", "of", "New", "york", "é", "x-y", "…", "City"]
    more = [(i, random.choice(["en", "de", None]), " ".join(random.choice(vocab) + random.choice(["", "", "", ".", "\n"]) for _ in range(30))) for i in range(60)]
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.where("length(text) < 10000 OR text IS NULL").collect()] + more
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, lang string, text string, c int").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, min_count=least).collect())
    assert got == brute_phrases([r[1:] for r in rows], least) and len(got) > 30
    assert phrases.collocations(nothing).count() == 0


def test_phrases_sample_without_proposals(spark, monkeypatch):
    """With an empty sample every frequent phrase is a border failure; passes go on until closed."""
    monkeypatch.setattr(phrases, "SAMPLE_COUNTS", (10**9, 10**9))
    passes = []
    real = phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda *a, **k: passes.append(len(a[1])) or real(*a, **k))
    rows = [("en", "red big dog barks. red big dog"), ("en", "big dog barks loud"), (None, "big dog")] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(df, min_count=3).collect())
    assert got == brute_phrases(rows, 3) and passes == [0, 1, 2, 3]


def test_phrase_scores_are_exact(spark):
    big = 10**12 + 39
    df = spark.createDataFrame([(big, big + 1, big + 7)], "a bigint, l bigint, r bigint")
    assert df.select(phrases._score("a", "l", "r")).head()[0] == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_a_stretch_of_words_is_held_once():
    """Counting a million words traced 256 MB while each stretch lay beside its copies."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 1000)) for _ in range(1100)]
    batch, total, rows = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts}), 0, Counter()
    tracemalloc.start()
    for found in phrases.Pass([], True, False).count(batch):
        kind = (found["h1"].to_numpy() != 0).astype(int) + (found["h2"].to_numpy() != 0) + (found["h3"].to_numpy() != 0)
        rows.update(dict(enumerate(np.bincount(kind, weights=found["c"].to_numpy(), minlength=4).astype(int).tolist())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = 1100 * 1000
    assert [rows[k] for k in range(4)] == [n, n, n - 1100, n - 2200]
    assert peak < 190 << 20
