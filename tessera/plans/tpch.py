"""The decision-support query shapes that the test tables' columns allow, in the dialect.

The date ranges are those of the test data. The plans need no hints: dimensions are broadcast by their size, filters
and columns reach the scans, and the big joins shuffle once on their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import query
from tessera.plans.registry import add, load


@add(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2001-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.count("*").alias("count_order"),
    )


REVENUE = "SUM(l_extendedprice * (1 - l_discount))"

# name: (dialect, SQL for comparison)
QUERIES = {
    "q3": (
        f"""SELECT l_orderkey, ROUND({REVENUE}, 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATETIME '1998-03-15 00:00:00' AND l_shipdate > DATETIME '1998-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
        f"""SELECT l_orderkey, round({REVENUE}, 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    ),
    "q5": (
        f"""SELECT n_name, ROUND({REVENUE}, 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= DATETIME '1996-01-01 00:00:00' AND o_orderdate < DATETIME '1998-01-01 00:00:00' GROUP BY n_name""",
        f"""SELECT n_name, round({REVENUE}, 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name""",
    ),
    "q6": (
        "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATETIME '1997-01-01 00:00:00' AND l_shipdate < DATETIME '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
        "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    ),
    "q7": (
        f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, EXTRACT(YEAR FROM l_shipdate) AS l_year, ROUND({REVENUE}, 2) AS revenue
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation AS n1 ON s_nationkey = n1.n_nationkey JOIN nation AS n2 ON c_nationkey = n2.n_nationkey
        WHERE n1.n_regionkey = 3 AND n2.n_regionkey = 3 AND n1.n_nationkey <> n2.n_nationkey GROUP BY supp_nation, cust_nation, l_year""",
        f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, round({REVENUE}, 2) AS revenue
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation AS n1 ON s_nationkey = n1.n_nationkey JOIN nation AS n2 ON c_nationkey = n2.n_nationkey
        WHERE n1.n_regionkey = 3 AND n2.n_regionkey = 3 AND n1.n_nationkey <> n2.n_nationkey GROUP BY ALL""",
    ),
    "q8": (
        """SELECT o_year, ROUND(SUM(IF(nation = 'BRAZIL', volume, 0.0)) / SUM(volume), 6) AS share FROM (
          SELECT EXTRACT(YEAR FROM o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
          FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation AS n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation AS n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_size < 20) GROUP BY o_year""",
        """SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN n2.n_name = 'BRAZIL' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share
          FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation AS n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation AS n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_size < 20 GROUP BY 1""",
    ),
    "q10": (
        f"""SELECT c_custkey, c_name, ROUND({REVENUE}, 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= DATETIME '1997-01-01 00:00:00' AND o_orderdate < DATETIME '1997-07-01 00:00:00' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
        f"""SELECT c_custkey, c_name, round({REVENUE}, 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01' AND l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""",
    ),
    "q14": (
        "SELECT ROUND(100 * SUM(IF(STARTS_WITH(p_type, 'PROMO'), l_extendedprice * (1 - l_discount), 0.0)) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATETIME '1997-09-01 00:00:00' AND l_shipdate < DATETIME '1997-10-01 00:00:00'",
        "SELECT round(100 * sum(CASE WHEN starts_with(p_type, 'PROMO') THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'",
    ),
    "q18": (
        """SELECT c_name, c_custkey, o_orderkey, ROUND(SUM(l_quantity), 2) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 180) GROUP BY c_name, c_custkey, o_orderkey""",
        """SELECT c_name, c_custkey, o_orderkey, round(sum(l_quantity), 2) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) GROUP BY ALL""",
    ),
    "q17": (
        "SELECT ROUND(SUM(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * AVG(i.l_quantity) FROM lineitem AS i WHERE i.l_partkey = p_partkey)",
        "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem AS i WHERE i.l_partkey = p_partkey)",
    ),
    "q22": (
        "SELECT c_nationkey, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS s FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) GROUP BY c_nationkey",
        "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) GROUP BY 1",
    ),
}

for _name, (_dialect, _oracle) in QUERIES.items():
    query(f"tpch_{_name}", _dialect, _oracle)
