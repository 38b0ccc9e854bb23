import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUICK = ["q_validate", "q_split_stratified", "q_replay", "q_label_flip", "q_flip_summary", "q_predict", "q_per_class", "q_admission", "q_row_ids"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUICK) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1e-6))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_csv_scan_sets_rows_without_a_part_aside(spark, folder):
    """The SQL keeps rows whose part key is known not to be a multiple of 89; a NULL is not."""
    kinds = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    kinds += "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    row = lambda key, part, supplier: (key, part, supplier, 1, 2.0, 3.5, 0.1, 0.0, "A", "F", None)
    rows = [row(1, 1, 1), row(2, None, 1), row(3, 89, 1), row(4, 2, None), row(None, 3, 53)]
    spark.createDataFrame(rows, kinds).write.parquet(folder + "/lineitem.parquet")
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    cur = duckdb.execute(entry.oracle_sql()["q_csv_scan"])
    cols = [d[0] for d in cur.description]
    got = entry.queries()["q_csv_scan"](spark, folder).select(*cols).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(cur.fetchall(), key=repr)
    assert len(got) == 3


def test_csv_scan_gives_every_text_back(spark, folder):
    """Empty and padded texts, line ends, quotes and separators are values as any other; NULL is none of them."""
    texts = [None, "", " ", "A", " A", "A ", "\t", "a,b", 'a"b', '"', '""', "a\\", '\\"', "\\N", "a\nb", "\n", "\nA", "\r", "a\r\nb", "%", "%41", "+", "\u00e9\u00a0", "\u2028", "\U0001f600", "\x00", "#", "NaN", "NULL"]
    numbers = [1.5, None, float("nan"), float("inf"), float("-inf"), -0.0, 5e-324, 1.7976931348623157e308, 0.1]
    kinds = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    kinds += "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    rows, n = [], len(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate([a, "F", texts[(i * 7 + 3) % n]]):
            v = lambda k, i=i, j=j: numbers[(i + j * 2 + k) % len(numbers)]
            rows.append(((1 << 63) - 1 - i if j else -i, [-5, 1, 2][j], [None, 53, 1][j], -(1 << 31) + i, v(0), v(1), v(2), v(3), a, b, None))
    spark.createDataFrame(rows, kinds).write.parquet(folder + "/lineitem.parquet")
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    cur = duckdb.execute(entry.oracle_sql()["q_csv_scan"])
    cols = [d[0] for d in cur.description]
    got = entry.queries()["q_csv_scan"](spark, folder).select(*cols).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, cur.fetchall()))
    assert len(got) == len(rows)
