"""Relational operators of the dialect that the DataFrame API has no name for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import cluster


def _spare(df: DataFrame, base: str) -> str:
    while base in df.columns:
        base += "_"
    return base


def qualify(df: DataFrame, window_value: Column, keep) -> DataFrame:
    """Rows for whose value over a window ``keep(column)`` is true, as QUALIFY does.

    >>> qualify(orders, F.row_number().over(w), lambda n: n == 1)
    """
    name = _spare(df, "_qualify")
    return df.withColumn(name, window_value).where(keep(F.col(name))).drop(name)


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total for a stable answer."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), lambda n: n == 1)


def select_except(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_replace(df: DataFrame, **columns: Column) -> DataFrame:
    """``* REPLACE``: the columns keep their places."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)[0]} to replace")
    return df.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def unnest(df: DataFrame, array: str, alias: str, offset: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each element, with its 0-based offset if asked; ``outer`` keeps rows of empty arrays."""
    if offset:
        f = F.posexplode_outer if outer else F.posexplode
        return df.select("*", f(array).alias(offset, alias)).withColumn(offset, F.col(offset).cast("long"))
    return df.select("*", (F.explode_outer if outer else F.explode)(array).alias(alias))


def union_wildcard(tables: dict[str, DataFrame], prefix: str) -> DataFrame:
    """All tables whose names begin with a prefix, with ``_TABLE_SUFFIX``; columns one lacks are null."""
    found = [df.withColumn("_TABLE_SUFFIX", F.lit(n[len(prefix) :])) for n, df in sorted(tables.items()) if n.startswith(prefix)]
    if not found:
        raise ValueError(f"no table begins with {prefix}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def sessionize(df: DataFrame, start: str, end: str, keys: list[str], touch: bool = True) -> DataFrame:
    """Gaps and islands: ``session_start`` and ``session_end`` of each row's chain of ranges.

    Ranges that touch belong together, unless ``touch`` is false. Two windows over the same keys and order share one
    shuffle and one sort.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first(), F.col(end).asc_nulls_first())
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reach if touch else F.col(start) >= reach
    marked = df.withColumn("_session", F.sum(F.when(reach.isNull() | apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "_session")
    return marked.select(*df.columns, F.min(start).over(own).alias("session_start"), F.max(end).over(own).alias("session_end"))


def pivot(df: DataFrame, keys: list[str], by: str, values: list, aggregate: Column) -> DataFrame:
    """PIVOT with its values given, so that no pass is needed to find them."""
    return df.groupBy(*keys).pivot(by, values).agg(aggregate)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], label: str, value: str, include_nulls: bool = False) -> DataFrame:
    out = df.unpivot(keys, columns, label, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), lambda n: n <= k)


def spatial_clusters(df: DataFrame, keys: list[str], point: str, metres: float, least: int, alias: str = "cluster") -> DataFrame:
    """DBSCAN over the geographies of each key's rows; noise has no cluster. A key's rows meet in one task."""
    schema = df.withColumn(alias, F.lit(None).cast("long")).schema

    def run(pdf):
        return pdf.assign(**{alias: cluster(list(pdf[point]), metres, least)}).astype({alias: "Int64"})

    return df.groupBy(*keys).applyInPandas(run, schema)
