"""Results in their own order and types, which a comparison sorted by name can't see."""

import datetime

import pytest

from tessera.plans import dialect


def ask(spark, sql, sf="/root/testdata/sf0.001"):
    return dialect.run(spark, sf, sql)


T = "(SELECT 1 AS a, 'x' AS b, 2.5 AS c)"


@pytest.mark.parametrize("sql,columns,rows", [
    (f"SELECT * REPLACE (a * 10 AS a) FROM {T}", ["a", "b", "c"], [(10, "x", 2.5)]),
    (f"SELECT * EXCEPT (b) REPLACE (c + 1 AS c, a + 1 AS a) FROM {T}", ["a", "c"], [(2, 3.5)]),
    (f"SELECT 0 AS z, t.* REPLACE (UPPER(b) AS b), 9 AS y FROM {T} AS t WHERE a = 1", ["z", "a", "b", "c", "y"], [(0, 1, "X", 2.5, 9)]),
    (f"WITH w AS (SELECT * FROM {T}) SELECT * REPLACE ('new' AS b) FROM w", ["a", "b", "c"], [(1, "new", 2.5)]),
    (f"SELECT * FROM (SELECT * REPLACE (a + 5 AS a) FROM {T}) WHERE a = 6", ["a", "b", "c"], [(6, "x", 2.5)]),
    ("SELECT * FROM UNNEST([STRUCT(1 AS a, 'x' AS b), (2, 'y')]) WITH OFFSET AS pos ORDER BY pos", ["a", "b", "pos"], [(1, "x", 0), (2, "y", 1)]),
    ("SELECT u.a, pos FROM UNNEST([STRUCT(1 AS a, 'x' AS b), (2, 'y')]) AS u WITH OFFSET AS pos WHERE pos = 1", ["a", "pos"], [(2, 1)]),
    ("SELECT v, pos FROM UNNEST(['p', 'q']) AS v WITH OFFSET AS pos ORDER BY pos DESC", ["v", "pos"], [("q", 1), ("p", 0)]),
])
def test_columns_in_order(spark, sql, columns, rows):
    got = ask(spark, sql)
    assert got.columns == columns
    assert [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in got.collect()] == rows


@pytest.mark.parametrize("values,want", [
    ("[1, 1, 2, 3, 3, 3]", [(3, 3), (1, 2)]),
    ("['b', 'a', 'b', 'a', 'c']", [("a", 2), ("b", 2)]),
    ("[DATE '2024-01-02', DATE '2024-01-02', NULL]", [(datetime.date(2024, 1, 2), 2)]),
    ("[1.5, 2.5, 2.5]", [(2.5, 2), (1.5, 1)]),
])
def test_top_count_keeps_types(spark, values, want):
    got = ask(spark, f"SELECT APPROX_TOP_COUNT(x, 2) AS r FROM UNNEST({values}) AS x").first()["r"]
    assert [(float(r["value"]) if hasattr(r["value"], "as_tuple") else r["value"], r["count"]) for r in got] == want


def test_top_sum(spark):
    got = ask(spark, "SELECT APPROX_TOP_SUM(x, w, 2) AS r FROM UNNEST([STRUCT(7 AS x, 1.0 AS w), (8, 2.0), (7, 5.0), (9, 2.0), (NULL, 50.0)])").first()["r"]
    assert [(r["value"], r["sum"]) for r in got] == [(7, 6.0), (8, 2.0)]
    assert ask(spark, "SELECT APPROX_TOP_SUM(l_orderkey, l_quantity, 1) AS r FROM lineitem WHERE l_orderkey < 0").first()["r"] == []


def test_top_count_merges_partial_sketches(spark):
    plan = ask(spark, "SELECT APPROX_TOP_COUNT(l_suppkey, 3) AS r FROM lineitem")._jdf.queryExecution().executedPlan().toString()
    assert "partial_approx_top_k" in plan and "collect_list" not in plan


@pytest.mark.parametrize("expression,want", [
    (r"REGEXP_EXTRACT('k=12', r'(?P<key_1>[a-z])=(?:[0-9]+)')", "k"),
    (r"REGEXP_EXTRACT('k=12', r'=(?<v>[0-9]+)')", "12"),
    (r"REGEXP_CONTAINS('ab', r'(?P<first>a)b')", True),
    (r"REGEXP_REPLACE('ab', r'(?P<x>a)(?P<y>b)', r'\2\1')", "ba"),
    (r"REGEXP_EXTRACT('(?P<x>', r'\(\?P<x>')", "(?P<x>"),
    (r"CAST(b'abc' AS STRING)", "abc"),
    (r"SAFE_CAST(b'\xff' AS STRING)", None),
    (r"CAST(TIMESTAMP '2024-01-02 12:34:56.789+00' AS STRING)", "2024-01-02 12:34:56.789+00"),
    (r"CAST(TIMESTAMP '2024-01-02 12:34:56+00' AS STRING)", "2024-01-02 12:34:56+00"),
    (r"CAST(TIMESTAMP '2024-01-02 12:34:56.789012+00' AS STRING)", "2024-01-02 12:34:56.789012+00"),
    (r"SAFE.SUBSTR('abc', 0, -1)", None),
    (r"SUBSTR('abc', 2)", "bc"),
])
def test_scalars(spark, expression, want):
    assert ask(spark, f"SELECT {expression} AS r").first()["r"] == want


def test_invalid_text_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)utf"):
        ask(spark, r"SELECT CAST(b'\xff' AS STRING) AS r").collect()


def test_tables_go_by_their_names(spark):
    got = ask(spark, "SELECT nation.n_name FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey WHERE region.r_regionkey = 0 ORDER BY nation.n_nationkey LIMIT 1")
    assert got.columns == ["n_name"] and got.count() == 1


def test_intervals_can_be_collected(spark):
    got = ask(spark, "SELECT INTERVAL 14 MONTH AS m, INTERVAL '1 2:03:04.5' DAY TO SECOND AS d, 7 AS n").first()
    assert got["m"] == "1-2 0 0:0:0" and got["d"].startswith("0-0 ") and got["n"] == 7


def test_one_file_has_a_limit(spark, tmp_path, monkeypatch):
    from tessera.sources import files

    files.extract(spark.range(10), f"file://{tmp_path}/one.csv", "CSV")
    monkeypatch.setattr(files, "SINGLE_FILE_BYTES", 10)
    with pytest.raises(ValueError, match="single file"):
        files.extract(spark.range(10), f"file://{tmp_path}/two.csv", "CSV")
    files.extract(spark.range(10), f"file://{tmp_path}/more-*.csv", "CSV")
