"""Registered queries that are written in the dialect and run over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tessera.functions import dates, udfs
from tessera.plans.registry import TABLES, add, load
from tessera.plans.translate import Hooks, translate
from tessera.session import configure


class Folder(Hooks):
    """Names are the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name, as_of):
        if name[-1] not in TABLES:
            return super().table(name, as_of)
        view = f"_{name[-1]}_{abs(hash(self.sf_dir))}"
        load(self.spark, self.sf_dir, name[-1]).createOrReplaceTempView(view)
        return f"`{view}`"


    def columns(self, sql):
        return known_columns(self.spark, sql)


def known_columns(spark: SparkSession, sql: str) -> list[str] | None:
    """The columns of a query, if it can be analysed by itself."""
    try:
        return spark.sql(sql).columns
    except AnalysisException:
        return None


_ready: set[str] = set()


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    configure(spark)
    if spark.sparkContext.applicationId not in _ready:
        udfs.register(spark)
        _ready.add(spark.sparkContext.applicationId)
    return dates.shown(spark.sql(translate(sql, Folder(spark, sf_dir))))


def query(name: str, sql: str, oracle: str | None) -> None:
    """Register a query in the dialect beside its SQL for comparison."""
    add(name, oracle)(lambda spark, sf_dir: run(spark, sf_dir, sql))


def scalar(name: str, table: str, key: str, expression: str, oracle: str | None) -> None:
    """Register one expression over the rows of a table."""
    query(name, f"SELECT {key}, {expression} AS r FROM {table}", None if oracle is None else f"SELECT {key}, {oracle} AS r FROM {table}")
