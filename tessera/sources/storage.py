"""Versioned tables on Parquet: copy-on-write changes, time travel, snapshots, clones and transactions.

A table's version is a list of folders and files that are never changed once written. Appending adds a folder.
UPDATE, DELETE and MERGE first find the files that hold a row to change, write those rows anew into one folder, and
name all other files as before, so their cost follows the files they touch; snapshots and clones copy the list, not the
data. What is written to a table that is partitioned by the days of a DATE column has a folder for each day, so that
filters on it prune folders; writes too small for that, and other partitions, are sorted by the column, so that filters
prune row groups. The catalog is one JSON file, replaced as a whole, so a change is seen entirely or not at all. One writer at a time.
"""

from __future__ import annotations

import copy
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files

RETENTION_S = 7 * 24 * 3600
_CHANCE = re.compile(r"\b(rand|randn|uuid|random|shuffle)\(", re.IGNORECASE)


class NotFound(ValueError):
    pass


class Duplicate(ValueError):
    pass


@dataclass
class Entry:
    """A table, view, materialized view, snapshot, function, procedure or table function."""

    kind: str
    schema: str | None = None
    versions: list[dict] = field(default_factory=list)
    query: str | None = None
    options: dict = field(default_factory=dict)
    partition: str | None = None
    partition_column: str | None = None
    clustering: list[str] = field(default_factory=list)
    defaults: dict = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    seen: dict = field(default_factory=dict)
    created: float = 0.0
    policies: dict = field(default_factory=dict)
    args: list = field(default_factory=list)
    returns: str | None = None


#: Writes that the optimizer takes to be smaller get no folders by day: thousands of tiny files cost more than they prune.
DAILY_BYTES = 1 << 30


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, daily_bytes: int = DAILY_BYTES):
        self.spark, self.root, self.daily_bytes = spark, files.qualified(spark, root), daily_bytes
        self.datasets: dict[str, dict] = {}
        self.entries: dict[str, Entry] = {}
        self.saved: list[tuple[dict, dict]] = []
        if files.exists(spark, f"{self.root}/catalog.json"):
            held = json.loads(files.read_text(spark, f"{self.root}/catalog.json"))
            self.datasets = held["datasets"]
            self.entries = {k: Entry(**v) for k, v in held["entries"].items()}

    # -- the catalog

    def save(self) -> None:
        """Publish the catalog; inside a transaction nothing is published yet."""
        if not self.saved:
            files.write_text(self.spark, f"{self.root}/catalog.json", json.dumps({"datasets": self.datasets, "entries": {k: asdict(v) for k, v in self.entries.items()}}))

    def begin(self) -> None:
        if self.saved:
            raise ValueError("a transaction is already open")
        self.saved.append((copy.deepcopy(self.datasets), copy.deepcopy(self.entries)))

    def commit(self) -> None:
        if not self.saved:
            raise ValueError("no transaction is open")
        self.saved.pop()
        self.save()

    def rollback(self) -> None:
        if not self.saved:
            raise ValueError("no transaction is open")
        self.datasets, self.entries = self.saved.pop()

    def create_dataset(self, name: str, if_not_exists: bool = False, options: dict | None = None) -> None:
        if name in self.datasets:
            if if_not_exists:
                return
            raise Duplicate(f"Already Exists: Dataset {name}")
        self.datasets[name] = {"options": options or {}, "created": time.time()}
        self.save()

    def drop_dataset(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        if name not in self.datasets:
            if if_exists:
                return
            raise NotFound(f"Not found: Dataset {name}")
        inside = [k for k in self.entries if k.rsplit(".", 1)[0] == name]
        if inside and not cascade:
            raise ValueError(f"Dataset {name} is still in use")
        for k in inside:
            del self.entries[k]
        del self.datasets[name]
        self.save()

    def get(self, name: str, *kinds: str) -> Entry:
        e = self.entries.get(name)
        if e is None or (kinds and e.kind not in kinds):
            raise NotFound(f"Not found: {(kinds or ('Table',))[0].title()} {name}")
        return e

    def put(self, name: str, entry: Entry, or_replace: bool = False, if_not_exists: bool = False) -> bool:
        """Add an entry; False if it was there and that is fine."""
        dataset = name.rsplit(".", 1)[0] if "." in name else ""
        if dataset and dataset not in self.datasets:
            raise NotFound(f"Not found: Dataset {dataset}")
        if name in self.entries and not or_replace:
            if if_not_exists:
                return False
            raise Duplicate(f"Already Exists: Table {name}")
        entry.created = time.time()
        self.entries[name] = entry
        self.save()
        return True

    def drop(self, name: str, *kinds: str, if_exists: bool = False) -> None:
        e = self.entries.get(name)
        if e is None or e.kind not in kinds:
            if if_exists and e is None:
                return
            raise NotFound(f"Not found: {kinds[0].title()} {name}")
        del self.entries[name]
        self.save()

    # -- versions

    def write(self, name: str, df: DataFrame) -> str:
        e, version = self.entries.get(name), uuid.uuid4().hex
        column = e.partition_column if e is not None and e.partition_column in df.columns else None
        order = [*([column] if column else []), *(c for c in (e.clustering if e is not None else []) if c != column)]
        daily = column and e.partition == "DAY" and isinstance(df.schema[column].dataType, T.DateType)
        if daily and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= self.daily_bytes:
            # days go to tasks by size: large ones are split, small ones share a task
            path = f"{self.root}/data/_table={name}/_version={version}"
            df.hint("rebalance", F.col(f"`{column}`")).sortWithinPartitions(*order).write.partitionBy(column).parquet(path)
            return path
        path = f"{self.root}/data/{name.replace('.', '/')}/{version}"
        (df.sortWithinPartitions(*order) if order else df).write.parquet(path)
        return path

    def frame(self, paths: list[str], schema: T.StructType, placed: bool = False) -> DataFrame:
        """The rows of folders and files, of which some may be partitioned by day and others not.

        placed: with ``_file`` and ``_row``, the file and the place that each has, which stay as they are while the files do.
        """
        more = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")] if placed else []
        if not paths:
            found = self.spark.createDataFrame([], schema)
            return found.selectExpr("*", "'' AS _file", "0L AS _row") if placed else found
        within = files.plain(f"{self.root}/data/_table=")
        daily = [p for p in paths if files.plain(p).startswith(within)]
        plain = [p for p in paths if not files.plain(p).startswith(within)]
        found = []
        if daily:
            found.append(self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*daily))
        if plain:
            found.append(self.spark.read.schema(schema).parquet(*plain))
        if daily or more:
            found = [x.select(*[F.col(f"`{f.name}`") for f in schema], *more) for x in found]
        return found[0].union(found[1]) if len(found) > 1 else found[0]

    def written(self, path: str, schema: T.StructType) -> int:
        """The rows of a folder, as its files' footers count them."""
        return self.frame([path], schema).count()

    def split(self, name: str, touched: list[str]) -> tuple[list[str], list[str]]:
        """What the table's version names without the touched files, and the touched files as they are listed."""
        asked, kept, hit = {files.plain(p) for p in touched}, [], []
        for path in self.version_at(name, None)["paths"]:
            own = files.plain(path)
            if not any(p == own or p.startswith(own + "/") for p in asked):
                kept.append(path)
                continue
            for f in files.listing(self.spark, path):
                (hit if files.plain(f) in asked else kept).append(f)
        if len(hit) != len(asked):
            raise ValueError(f"the files of {name} are not where its catalog says")
        return kept, hit

    def rewrite(self, name: str, kept: list[str], rows: DataFrame | None) -> None:
        """Publish a version of the files that are kept and of new rows."""
        self.publish(name, [*kept, *([self.write(name, self.check(name, rows))] if rows is not None else [])])

    def publish(self, name: str, paths: list[str], schema: T.StructType | None = None) -> None:
        e = self.entries[name]
        now = max(time.time(), e.versions[-1]["ts"] + 1e-6 if e.versions else 0)
        if schema is not None:
            e.schema = schema.json()
        e.versions.append({"ts": now, "paths": paths, "schema": e.schema})
        self.save()

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.get(name).schema))

    def version_at(self, name: str, at: float | None) -> dict:
        """The latest version no younger than ``at`` (epoch seconds)."""
        e = self.get(name)
        if not e.versions:
            return {"paths": [], "schema": e.schema}
        if at is None:
            return e.versions[-1]
        if at > time.time() + 1:
            raise ValueError("Cannot read a table in the future")
        if at < time.time() - RETENTION_S:
            raise ValueError("Invalid time travel: before the retention window")
        found = [v for v in e.versions if v["ts"] <= at]
        if not found:
            raise ValueError(f"Invalid snapshot time: before table {name} was created")
        return found[-1]

    def read(self, name: str, at: float | None = None) -> DataFrame:
        v = self.version_at(name, at)
        schema = T.StructType.fromJson(json.loads(v["schema"]))
        return self.frame(v["paths"], schema)

    def purge(self, retention_s: float = RETENTION_S) -> int:
        """Forget versions past retention, and delete the folders that nothing names any more."""
        before = {p for e in self.entries.values() for v in e.versions for p in v["paths"]}
        limit, dropped = time.time() - retention_s, 0
        for e in self.entries.values():
            keep = [v for v in e.versions[:-1] if v["ts"] >= limit] + e.versions[-1:]
            dropped += len(e.versions) - len(keep)
            e.versions = keep
        self.save()
        after = {p for e in self.entries.values() for v in e.versions for p in v["paths"]}
        named = {files.plain(p) for p in after}
        for path in before - after:
            own = files.plain(path)
            if any(own.startswith(p + "/") for p in named):
                continue  # a file of a folder that is still named
            if not any(p.startswith(own + "/") for p in named):
                files.delete(self.spark, path)
                continue
            for f in files.listing(self.spark, path):
                if files.plain(f) not in named:
                    files.delete(self.spark, f)
        return dropped

    # -- tables

    def create_table(self, name: str, schema: T.StructType, rows: DataFrame | None = None, or_replace: bool = False, if_not_exists: bool = False, **more) -> int:
        entry = Entry("TABLE", schema.json(), **more)
        if not self.put(name, entry, or_replace, if_not_exists):
            return 0
        if rows is None:
            self.publish(name, [])
            return 0
        path = self.write(name, self.conform(rows, schema))
        self.publish(name, [path])
        return self.written(path, schema)

    def conform(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """Columns by position, cast to the table's types."""
        if len(df.columns) != len(schema):
            raise ValueError(f"expected {len(schema)} columns, found {len(df.columns)}")
        positional = df.toDF(*[f"_c{k}" for k in range(len(schema))])
        return positional.select(*[F.col(f"_c{k}").cast(f.dataType).alias(f.name) for k, f in enumerate(schema)])

    def check(self, name: str, df: DataFrame) -> DataFrame:
        """REQUIRED columns fail on null while the rows are written."""
        for c in self.get(name).required:
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"Required field {c} cannot be null")).cast(df.schema[c].dataType)))
        return df

    def append(self, name: str, df: DataFrame) -> int:
        self._writable(name)
        path = self.write(name, self.check(name, self.conform(df, self.schema(name))))
        v = self.version_at(name, None)
        self.publish(name, [*v["paths"], path])
        return self.written(path, self.schema(name))

    def replace(self, name: str, df: DataFrame, schema: T.StructType | None = None) -> None:
        self._writable(name)
        self.publish(name, [self.write(name, self.check(name, df))], schema)

    def truncate(self, name: str) -> int:
        self._writable(name)
        n = self.read(name).count()
        self.publish(name, [])
        return n

    def _writable(self, name: str) -> None:
        e = self.get(name)
        if e.kind not in ("TABLE", "CLONE"):
            raise ValueError(f"{name} is a {e.kind.lower()} and cannot be changed")

    def load(self, name: str, df: DataFrame, disposition: str = "WRITE_APPEND", create: str = "CREATE_IF_NEEDED", add_fields: bool = False) -> int:
        """The end of a load, copy or query job: write rows under a disposition."""
        if disposition not in files.DISPOSITIONS:
            raise ValueError(f"no disposition {disposition}")
        if name not in self.entries:
            if create == "CREATE_NEVER":
                raise NotFound(f"Not found: Table {name}")
            return self.create_table(name, df.schema, df)
        if disposition == "WRITE_EMPTY" and not self.read(name).isEmpty():
            raise Duplicate(f"Already Exists: Table {name} is not empty")
        if disposition == "WRITE_TRUNCATE":
            path = self.write(name, df)
            self.publish(name, [path], df.schema)
            return self.written(path, df.schema)
        schema, new = self.schema(name), [f for f in df.schema if f.name not in self.schema(name).names]
        if new and not add_fields:
            raise ValueError(f"Provided schema does not match: {[f.name for f in new]}")
        if new:
            schema = T.StructType([*schema, *new])
            self.get(name).schema = schema.json()
        aligned = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return self.append(name, aligned)

    def copy(self, sources: list[str], target: str, disposition: str = "WRITE_EMPTY") -> int:
        rows = self.read(sources[0])
        for s in sources[1:]:
            rows = rows.unionByName(self.read(s))
        return self.load(target, rows, disposition)

    def snapshot(self, source: str, target: str, at: float | None = None, clone: bool = False, **how) -> None:
        v, e = self.version_at(source, at), self.get(source)
        layout = {"partition": e.partition, "partition_column": e.partition_column, "clustering": list(e.clustering)}
        self.put(target, Entry("CLONE" if clone else "SNAPSHOT", v["schema"], bases=[source], **layout), **how)
        self.publish(target, list(v["paths"]))

    # -- whole warehouses

    def backup(self, target: str) -> int:
        """Copy the catalog and all files that it names under another root; the number of files. What is there must be empty."""
        return _transfer(self, files.qualified(self.spark, target))

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, root: str) -> Warehouse:
        """A warehouse at a new root out of a backup, with all its versions."""
        _transfer(cls(spark, backup), files.qualified(spark, root))
        return cls(spark, root)

    def export(self, folder: str, destination_format: str = "PARQUET") -> list[str]:
        """Every table's latest rows as a folder of files of its name."""
        names = [k for k, e in self.entries.items() if e.kind in ("TABLE", "CLONE", "SNAPSHOT")]
        for name in names:
            files.extract(self.read(name), f"{folder.rstrip('/')}/{name}/*", destination_format)
        return names

    def seed(self, dataset: str, folder: str, tables: list[str], source_format: str = "PARQUET") -> dict[str, int]:
        """Tables of a dataset out of files or folders of their names; the rows of each."""
        self.create_dataset(dataset, if_not_exists=True)
        ending = "" if source_format != "PARQUET" else ".parquet"
        return {t: self.load(f"{dataset}.{t}", files.load(self.spark, f"{folder.rstrip('/')}/{t}{ending}", source_format, autodetect=True)) for t in tables}

    # -- changes, copy-on-write

    def _changed(self, name: str, where: str, alias: str | None) -> tuple[int, list[str], DataFrame | None]:
        """How many rows the predicate holds for, the files without one, and the other files' rows with ``_hit``."""
        paths, schema, alias = self.version_at(name, None)["paths"], self.schema(name), alias or name.rsplit(".", 1)[-1]
        if not paths:
            return 0, [], None
        hit = F.coalesce(F.expr(where), F.lit(False))
        if _CHANCE.search(where):  # what differs from run to run is decided once, for all rows
            from tessera.session import stash

            decided = stash(self.frame(paths, schema).alias(alias).withColumn("_hit", hit), "decided").alias(alias)
            return decided.where("_hit").count(), [], decided
        found = self.frame(paths, schema, placed=True).alias(alias).where(hit).groupBy("_file").count().collect()  # a row a file
        kept, touched = self.split(name, [r[0] for r in found])
        return sum(r[1] for r in found), kept, self.frame(touched, schema).alias(alias).withColumn("_hit", hit)

    def update(self, name: str, changes: dict[str, str], where: str, alias: str | None = None) -> int:
        """Set columns to expressions where the predicate holds; the number of rows changed."""
        self._writable(name)
        n, kept, rows = self._changed(name, where, alias)
        if n:
            schema = self.schema(name)
            out = [F.when(F.col("_hit"), F.expr(changes[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in changes else F.col(f"`{f.name}`") for f in schema]
            self.rewrite(name, kept, rows.select(*out))
        return n

    def delete(self, name: str, where: str, alias: str | None = None) -> int:
        self._writable(name)
        n, kept, rows = self._changed(name, where, alias)
        if n:
            self.rewrite(name, kept, rows.where(~F.col("_hit")).drop("_hit"))
        return n

    def merge(self, name: str, alias: str, source: DataFrame, source_alias: str, on: str, clauses: list[dict]) -> dict[str, int]:
        """WHEN clauses in order, the first that applies wins. A target row that two source rows match fails.

        clause: {"when": matched | source_only | target_only, "and": predicate or None, "do": update | delete | insert, "set": {...}}
        """
        from tessera.session import stash

        self._writable(name)
        schema, paths = self.schema(name), self.version_at(name, None)["paths"]
        source = stash(source.withColumn("_sid", F.monotonically_increasing_id()), "source").alias(source_alias)
        if any(c["when"] == "target_only" for c in clauses):
            kept_paths, hit = [], paths
        else:  # every target row that meets a source row is in these files, so the rest can neither change nor stop an insert
            met = self.frame(paths, schema, placed=True).alias(alias).join(source, F.expr(on), "left_semi").select("_file").distinct().collect() if paths else []
            kept_paths, hit = self.split(name, [r[0] for r in met])
        target = self.frame(hit, schema).withColumn("_tid", F.monotonically_increasing_id()).alias(alias)
        joined = target.join(source, F.expr(on), "full")

        case = F.when(F.lit(False), F.lit(-1))
        for k, c in enumerate(clauses):
            applies = {"matched": "_tid IS NOT NULL AND _sid IS NOT NULL", "source_only": "_tid IS NULL", "target_only": "_sid IS NULL"}[c["when"]]
            case = case.when(F.expr(f"{applies} AND coalesce({c['and'] or 'true'}, false)"), F.lit(k))
        columns = []
        for f in schema:
            value = F.when(F.lit(False), F.lit(None).cast(f.dataType))
            for k, c in enumerate(clauses):
                if f.name in c.get("set", {}):
                    value = value.when(F.col("_do") == k, F.expr(c["set"][f.name]).cast(f.dataType))
                elif c["do"] == "insert":
                    value = value.when(F.col("_do") == k, F.lit(None).cast(f.dataType))
            columns.append(value.otherwise(F.col(f"{alias}.{f.name}")).alias(f.name))
        decided = joined.withColumn("_do", F.coalesce(case, F.lit(-1)))
        done = stash(decided.select(*columns, "_tid", "_do"), "merge")
        kinds = {k: c["do"] for k, c in enumerate(clauses)}
        changed = [k for k, d in kinds.items() if d in ("update", "delete")]
        if changed and not done.where(F.col("_do").isin(changed)).groupBy("_tid").count().where("count > 1").isEmpty():
            raise ValueError("UPDATE/MERGE must match at most one source row for each target row")
        counts = {r["_do"]: r["count"] for r in done.groupBy("_do").count().collect()}
        deletes = [k for k, d in kinds.items() if d == "delete"]
        counts = {d: sum(n for k, n in counts.items() if kinds.get(k) == d) for d in ("update", "delete", "insert")}
        if not any(counts.values()):
            return counts
        # target rows that several source rows meet without a change are kept once
        kept = done.where("_tid IS NOT NULL" + (f" AND _do NOT IN ({', '.join(map(str, deletes))})" if deletes else "")).dropDuplicates(["_tid"])
        inserts = [k for k, d in kinds.items() if d == "insert"]
        added = done.where(F.col("_do").isin(inserts)) if inserts else done.limit(0)
        columns = [f"`{f.name}`" for f in schema]
        if counts["update"] or counts["delete"]:
            self.rewrite(name, kept_paths, kept.unionByName(added).select(*columns))
        else:
            self.rewrite(name, paths, added.select(*columns))
        return counts


def _transfer(warehouse: Warehouse, target: str) -> int:
    """Copy the files that a catalog names, in tasks, then the catalog with their new places."""
    spark, root = warehouse.spark, warehouse.root
    if files.exists(spark, f"{target}/catalog.json"):
        raise Duplicate(f"Already Exists: a warehouse at {target}")
    base = files.plain(root) + "/"
    paths = {p for e in warehouse.entries.values() for v in e.versions for p in v["paths"]}
    within = sorted({files.plain(f).removeprefix(base) for p in paths for f in files.listing(spark, p)})

    def copy_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, there = (pafs.FileSystem.from_uri(files.uri(r)) for r in (root, target))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                to = f"{there[1]}/{name}"
                there[0].create_dir(to.rpartition("/")[0], recursive=True)
                with here[0].open_input_stream(f"{here[1]}/{name}") as source, there[0].open_output_stream(to) as sink:
                    while part := source.read(8 << 20):
                        sink.write(part)
            yield batch

    if within:
        names = spark.createDataFrame([(n,) for n in within], "name string").repartition(min(len(within), 1000), "name")
        names.mapInArrow(copy_files, "name string").count()
    entries = {k: asdict(v) for k, v in warehouse.entries.items()}
    for e in entries.values():
        for v in e["versions"]:
            v["paths"] = [f"{target}/{files.plain(p).removeprefix(base)}" for p in v["paths"]]
    files.write_text(spark, f"{target}/catalog.json", json.dumps({"datasets": warehouse.datasets, "entries": entries}))
    return len(within)
