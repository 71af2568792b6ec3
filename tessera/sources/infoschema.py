"""INFORMATION_SCHEMA views over the catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.storage import NotFound

NAMES = {"bigint": "INT64", "double": "FLOAT64", "string": "STRING", "boolean": "BOOL", "binary": "BYTES", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME", "decimal(38,9)": "NUMERIC", "decimal(38,18)": "BIGNUMERIC"}


def type_name(kind: T.DataType) -> str:
    """The dialect's name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{type_name(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return f"STRUCT<{', '.join(f'{f.name} {type_name(f.dataType)}' for f in kind)}>"
    simple = kind.simpleString()
    if simple.startswith("time("):
        return "TIME"
    return NAMES.get(simple, "NUMERIC" if simple.startswith("decimal") else simple.upper())


def _inside(engine, dataset: str | None, *kinds: str):
    name = dataset or engine.dataset
    if name not in engine.warehouse.datasets:
        raise NotFound(f"Not found: Dataset {name}")
    for key, e in sorted(engine.warehouse.entries.items()):
        if key.rsplit(".", 1)[0] == name and e.kind in (kinds or ("TABLE", "VIEW", "MATERIALIZED VIEW", "SNAPSHOT", "CLONE")):
            yield key, name, key.rsplit(".", 1)[1], e


def _rows(engine, rows: list, schema: str) -> DataFrame:
    return engine.spark.createDataFrame(rows, schema)


def schemata(engine, dataset) -> DataFrame:
    rows = [(engine.project, n, float(d["created"])) for n, d in sorted(engine.warehouse.datasets.items())]
    df = _rows(engine, rows, "catalog_name string, schema_name string, created double")
    return df.select("catalog_name", "schema_name", F.timestamp_seconds("created").alias("creation_time"))


_TABLE_TYPES = {"TABLE": "BASE TABLE", "SNAPSHOT": "SNAPSHOT", "CLONE": "CLONE", "VIEW": "VIEW", "MATERIALIZED VIEW": "MATERIALIZED VIEW"}


def tables(engine, dataset) -> DataFrame:
    rows = [(engine.project, d, t, _TABLE_TYPES[e.kind], "YES" if e.kind in ("TABLE", "CLONE") else "NO", float(e.created), ddl(engine, d, t, e)) for _, d, t, e in _inside(engine, dataset)]
    df = _rows(engine, rows, "table_catalog string, table_schema string, table_name string, table_type string, is_insertable_into string, created double, ddl string")
    return df.withColumn("creation_time", F.timestamp_seconds("created")).drop("created")


def ddl(engine, dataset: str, table: str, e) -> str:
    path = f"`{engine.project}.{dataset}.{table}`"
    if e.kind in ("VIEW", "MATERIALIZED VIEW"):
        return f"CREATE {e.kind} {path} AS {e.query};"
    fields = T.StructType.fromJson(json.loads(e.schema))
    columns = ", ".join(f"{f.name} {type_name(f.dataType)}{' NOT NULL' if f.name in e.required else ''}" for f in fields)
    return f"CREATE {'SNAPSHOT ' if e.kind == 'SNAPSHOT' else ''}TABLE {path} ({columns});"


def _schema(engine, key, e) -> T.StructType:
    return T.StructType.fromJson(json.loads(e.schema)) if e.schema else engine.frame(key).schema


def columns(engine, dataset) -> DataFrame:
    rows = []
    for key, d, t, e in _inside(engine, dataset):
        for k, f in enumerate(_schema(engine, key, e), 1):
            place = e.clustering.index(f.name) + 1 if f.name in e.clustering else None
            rows.append((engine.project, d, t, f.name, k, "NO" if f.name in e.required else "YES", type_name(f.dataType), "YES" if f.name == e.partition_column else "NO", place, e.defaults.get(f.name)))
    return _rows(engine, rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position long, is_nullable string, data_type string, is_partitioning_column string, clustering_ordinal_position long, column_default string")


def table_options(engine, dataset) -> DataFrame:
    rows = [(engine.project, d, t, k, "STRING" if isinstance(v, str) else "FLOAT64" if isinstance(v, float) else "INT64", json.dumps(v) if isinstance(v, str) else str(v)) for _, d, t, e in _inside(engine, dataset) for k, v in sorted(e.options.items())]
    return _rows(engine, rows, "table_catalog string, table_schema string, table_name string, option_name string, option_type string, option_value string")


def views(engine, dataset) -> DataFrame:
    rows = [(engine.project, d, t, e.query) for _, d, t, e in _inside(engine, dataset, "VIEW", "MATERIALIZED VIEW")]
    return _rows(engine, rows, "table_catalog string, table_schema string, table_name string, view_definition string")


_PATTERNS = {"DAY": "yyyyMMdd", "HOUR": "yyyyMMddHH", "MONTH": "yyyyMM", "YEAR": "yyyy"}


def partitions(engine, dataset) -> DataFrame:
    """A row a partition with its number of rows; an unpartitioned table is one."""
    out = _rows(engine, [], "table_catalog string, table_schema string, table_name string, partition_id string, total_rows long")
    for key, d, t, e in _inside(engine, dataset, "TABLE", "CLONE", "SNAPSHOT"):
        df = engine.warehouse.read(key)
        if e.partition in _PATTERNS:
            c = F.col(e.partition_column or "_PARTITIONTIME")
            part = F.coalesce(F.date_format(c, _PATTERNS[e.partition]), F.lit("__NULL__"))
        elif e.partition and e.partition.startswith("RANGE"):
            start, end, step = map(int, e.partition[6:-1].split(","))
            c = F.col(e.partition_column)
            part = F.when(c.isNull(), "__NULL__").when((c < start) | (c >= end), "__UNPARTITIONED__").otherwise((F.lit(start) + F.floor((c - start) / step) * step).cast("string"))
        else:
            part = F.lit(None).cast("string")
        found = df.groupBy(part.alias("partition_id")).agg(F.count("*").alias("total_rows"))
        out = out.unionByName(found.select(F.lit(engine.project).alias("table_catalog"), F.lit(d).alias("table_schema"), F.lit(t).alias("table_name"), "partition_id", "total_rows"))
    return out


def routines(engine, dataset) -> DataFrame:
    rows = [(engine.project, d, t, e.kind, e.query, e.options.get("language", "SQL")) for _, d, t, e in _inside(engine, dataset, "FUNCTION", "PROCEDURE", "TABLE FUNCTION")]
    return _rows(engine, rows, "routine_catalog string, routine_schema string, routine_name string, routine_type string, routine_definition string, routine_body string")


def materialized_views(engine, dataset) -> DataFrame:
    rows = [(engine.project, d, t, float(e.versions[-1]["ts"]) if e.versions else None) for _, d, t, e in _inside(engine, dataset, "MATERIALIZED VIEW")]
    df = _rows(engine, rows, "table_catalog string, table_schema string, table_name string, at double")
    return df.withColumn("last_refresh_time", F.timestamp_seconds("at")).drop("at")


def row_access_policies(engine, dataset) -> DataFrame:
    rows = [(engine.project, d, t, n, p["filter"], list(p["grantees"])) for _, d, t, e in _inside(engine, dataset) for n, p in sorted(e.policies.items())]
    return _rows(engine, rows, "table_catalog string, table_schema string, table_name string, policy_name string, filter_predicate string, grantees array<string>")


VIEWS = {
    "SCHEMATA": schemata, "TABLES": tables, "COLUMNS": columns, "TABLE_OPTIONS": table_options, "VIEWS": views, "PARTITIONS": partitions,
    "ROUTINES": routines, "MATERIALIZED_VIEWS": materialized_views, "ROW_ACCESS_POLICIES": row_access_policies,
}
