"""APPROX_TOP_COUNT is exact, also where its sketch no longer is."""

import pytest

from tessera.functions import aggregates
from tessera.plans import dialect
from tessera.plans.translate import translate


class Here(dialect.Hooks):
    def __init__(self, spark):
        self.spark = spark

    def columns(self, sql):
        return dialect.known_columns(self.spark, sql)


def ask(spark, sql):
    dialect.configure(spark)
    return [(*r[:-1], [tuple(t) for t in r[-1]]) for r in spark.sql(translate(sql, Here(spark))).collect()]


@pytest.fixture(scope="module")
def many(spark):
    """200,000 values once each, in a group of their own and in that of null; few in another; none in the last."""
    spark.sql(
        "SELECT if(id % 2 = 0, 'a', NULL) AS g, id div 2 AS x FROM range(400000) UNION ALL SELECT 'a', 123456 UNION ALL SELECT NULL, 77777 "
        "UNION ALL SELECT 'b', id % 3 FROM range(8) UNION ALL SELECT 'c', NULL"
    ).createOrReplaceTempView("top_rows")


@pytest.mark.parametrize("key,by", [("g", "1"), ("g", "g"), ("CONCAT(g, '!') AS h", "h"), ("t.g", "t.g")])
def test_groups(spark, many, key, by):
    got = ask(spark, f"SELECT {key}, APPROX_TOP_COUNT(t.x, 3) AS r FROM top_rows AS t WHERE TRUE GROUP BY {by}")
    want = {"a": [(123456, 2), (0, 1), (1, 1)], None: [(77777, 2), (0, 1), (1, 1)], "b": [(0, 3), (1, 3), (2, 2)], "c": []}
    assert {k and k[0]: r for k, r in got} == want and len(got) == 4


def test_no_groups(spark, many):
    assert ask(spark, "SELECT COUNT(*) AS n, APPROX_TOP_COUNT(x, 2) AS r FROM top_rows WHERE g = 'a'") == [(200_001, [(123456, 2), (0, 1)])]
    assert ask(spark, "SELECT APPROX_TOP_COUNT(x, 2) AS r FROM top_rows WHERE FALSE") == [([],)]
    assert ask(spark, "WITH w AS (SELECT x + 1 AS y FROM top_rows WHERE g IS NULL) SELECT APPROX_TOP_COUNT(y, 1) AS r FROM w") == [([(77778, 2)],)]


def test_sketches_alone(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "SKETCHES", True)
    assert "row_number" not in translate("SELECT APPROX_TOP_COUNT(x, 2) AS r FROM t", Here(spark))
