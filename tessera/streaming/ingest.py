"""Ingest: write streams with their commit protocols, row inserts, read sessions and wire rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import stash
from tessera.sources.storage import Warehouse


class OffsetError(ValueError):
    """ALREADY_EXISTS for an offset that is done, OUT_OF_RANGE for one that skips rows."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


KINDS = ("DEFAULT", "COMMITTED", "PENDING", "BUFFERED")


class WriteStream:
    """Appends to a table. DEFAULT and COMMITTED rows show at once, PENDING ones at commit, BUFFERED ones when flushed.

    Rows not yet visible are folders of Parquet beside the table's; making them visible only changes the catalog.
    """

    def __init__(self, warehouse: Warehouse, table: str, kind: str = "DEFAULT"):
        if kind not in KINDS:
            raise ValueError(f"no stream kind {kind}")
        warehouse.get(table, "TABLE", "CLONE")
        self.warehouse, self.table, self.kind = warehouse, table, kind
        self.next_offset = 0
        self.finalized = self.committed = False
        self.pending: list[tuple[str, int]] = []
        self.flushed = 0

    def append(self, rows: DataFrame, offset: int | None = None) -> int:
        """Write rows at an offset, or at the end; the offset after them."""
        if self.finalized:
            raise ValueError("the stream is finalized")
        if offset is not None:
            if self.kind == "DEFAULT":
                raise ValueError("the default stream takes no offsets")
            if offset < self.next_offset:
                raise OffsetError("ALREADY_EXISTS", f"offset {offset} is below {self.next_offset}")
            if offset > self.next_offset:
                raise OffsetError("OUT_OF_RANGE", f"offset {offset} is beyond {self.next_offset}")
        w = self.warehouse
        shaped = w.check(self.table, w.conform(rows, w.schema(self.table)))
        if self.kind in ("DEFAULT", "COMMITTED"):
            n = w.append(self.table, rows)
        else:
            # _n keeps the rows' order for a flush that cuts the batch; readers of the table don't see it
            path = w.write(self.table, shaped.withColumn("_n", F.monotonically_increasing_id()))
            n = w.written(path, w.schema(self.table))
            self.pending.append((path, n))
        self.next_offset += n
        return self.next_offset

    def finalize(self) -> int:
        self.finalized = True
        return self.next_offset

    def flush(self, last: int) -> int:
        """Make the rows up to and including offset ``last`` of a BUFFERED stream visible."""
        if self.kind != "BUFFERED":
            raise ValueError("only buffered streams are flushed")
        if last >= self.next_offset:
            raise OffsetError("OUT_OF_RANGE", f"offset {last} is not written yet")
        until, at, shown = last + 1, self.flushed, []
        while self.pending and at < until:
            path, n = self.pending[0]
            if at + n <= until:
                self.pending.pop(0)
                shown.append(path)
                at += n
            else:  # cut a batch: its first rows show, the rest waits on
                schema = T.StructType([*self.warehouse.schema(self.table), T.StructField("_n", T.LongType())])
                rows = self.warehouse.frame([path], schema)
                edge = _number(rows, until - at)
                shown.append(self.warehouse.write(self.table, rows.where(F.col("_n") < edge)))
                rest = self.warehouse.write(self.table, rows.where(F.col("_n") >= edge))
                self.pending[0] = (rest, n - (until - at))
                at = until
        if shown:
            self.warehouse.publish(self.table, [*self.warehouse.version_at(self.table, None)["paths"], *shown])
        self.flushed = max(self.flushed, at)
        return self.flushed


def _number(rows: DataFrame, n: int) -> int:
    """The number ``_n`` that n rows stay below: numbers run on inside a writing task, so a row a task tells."""
    tasks = rows.groupBy(F.shiftright("_n", 33).alias("task")).agg(F.min("_n"), F.count("*")).orderBy("task").collect()
    for _, first, many in tasks:
        if n <= many:
            return first + n
        n -= many
    return 1 << 62


def commit(warehouse: Warehouse, streams: list[WriteStream]) -> None:
    """Show all rows of finalized PENDING streams, of one table at one moment."""
    for s in streams:
        if s.kind != "PENDING" or not s.finalized or s.committed:
            raise ValueError("only finalized pending streams that are not committed yet can be committed")
    for table in dict.fromkeys(s.table for s in streams):
        paths = [p for s in streams if s.table == table for p, _ in s.pending]
        warehouse.publish(table, [*warehouse.version_at(table, None)["paths"], *paths])
    for s in streams:
        s.committed = True


def run_stream(warehouse: Warehouse, table: str, source: DataFrame, checkpoint: str) -> int:
    """Drain a streaming frame into a table: each micro-batch is appended once, whatever is replayed.

    The last batch done is kept in the table's catalog entry and published with its rows, so a batch that Spark
    runs again after a crash is known and skipped.
    """
    done = 0

    def put(rows: DataFrame, batch: int) -> None:
        nonlocal done
        entry = warehouse.get(table)
        if batch <= entry.options.get("_last_batch", -1):
            return
        path = warehouse.write(table, warehouse.conform(rows, warehouse.schema(table)))
        entry.options["_last_batch"] = batch
        warehouse.publish(table, [*warehouse.version_at(table, None)["paths"], path])
        done += warehouse.written(path, warehouse.schema(table))

    source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done


def insert_all(warehouse: Warehouse, table: str, rows: list[str], skip_invalid: bool = False) -> list[int]:
    """JSON rows into a table; the places of those that don't fit. Without ``skip_invalid`` one misfit stops all."""
    spark, schema = warehouse.spark, warehouse.schema(table)
    text = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "at int, line string")
    shaped = T.StructType([*schema, T.StructField("_bad", T.StringType())])
    parsed = text.select("at", F.from_json("line", shaped, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    parsed = stash(parsed, "inserts")
    bad = [r["at"] for r in parsed.where("r._bad is not null or r is null").select("at").orderBy("at").collect()]
    if bad and not skip_invalid:
        return bad
    warehouse.append(table, parsed.where("r._bad is null").select(*[F.col(f"r.`{f.name}`") for f in schema]))
    return bad


def list_rows(df: DataFrame, columns: list[str] | None = None, start: int = 0, most: int | None = None) -> DataFrame:
    """A page of rows."""
    page = (df.select(*columns) if columns else df).offset(start)
    return page.limit(most) if most is not None else page


class ReadSession:
    """A projection and restriction of rows, fixed once, read through several streams."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None, restriction: str | None = None, streams: int = 1):
        rows = df.where(restriction) if restriction else df
        rows = rows.select(*columns) if columns else rows
        self.streams = streams
        self.rows = stash(rows.withColumn("_at", F.monotonically_increasing_id()).repartition(streams, "_at").withColumn("_stream", F.spark_partition_id()), "session")

    def stream(self, k: int) -> DataFrame:
        return self.rows.where(F.col("_stream") == k).drop("_stream", "_at")

    def split(self, k: int, fraction: float) -> tuple[DataFrame, DataFrame]:
        """Two streams out of one, by a hash of each row's place."""
        part = self.rows.where(F.col("_stream") == k)
        side = F.pmod(F.xxhash64("_at"), F.lit(1000)) < int(fraction * 1000)
        return part.where(side).drop("_stream", "_at"), part.where(~side).drop("_stream", "_at")


def _wire(c: Column, kind: T.DataType) -> Column:
    """{"v": ...} as JSON text."""
    if isinstance(kind, T.ArrayType):
        inner = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _wire(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        inner = _record(kind, lambda f: c.getField(f.name))
    else:
        text = F.base64(c) if isinstance(kind, T.BinaryType) else F.unix_micros(c).cast("string") if isinstance(kind, T.TimestampType) else c.cast("string")
        quoted = F.to_json(F.struct(text.alias("v")))
        inner = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    return F.concat(F.lit('{"v":'), F.when(c.isNull(), F.lit("null")).otherwise(inner), F.lit("}"))


def _record(schema: T.StructType, get) -> Column:
    return F.concat(F.lit('{"f":['), F.concat_ws(",", *[_wire(get(f), f.dataType) for f in schema]), F.lit("]}"))


def wire_rows(df: DataFrame) -> DataFrame:
    """Rows as the warehouse's REST interface writes them, a JSON text each."""
    return df.select(_record(df.schema, lambda f: F.col(f"`{f.name}`")).alias("row_json"))


def arrow_rows(df: DataFrame, most: int = 10_000) -> DataFrame:
    """(serialized_record_batch, row_count): rows as a read session sends them, in Arrow messages of at most so many rows.

    :func:`arrow_schema` gives the message that goes before them. Each task encodes its own rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.slice(at, most) for at in range(0, batch.num_rows, most)]
            yield pa.record_batch([pa.array([p.serialize().to_pybytes() for p in parts], pa.binary()), pa.array([p.num_rows for p in parts], pa.int64())], names=["serialized_record_batch", "row_count"])

    return df.mapInArrow(encode, "serialized_record_batch binary, row_count long")


def arrow_schema(schema: T.StructType) -> bytes:
    """A schema as the Arrow message that a session sends first."""
    return to_arrow_schema(schema).serialize().to_pybytes()


def from_arrow(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Arrow messages, as a writer of rows sends them, as rows of the schema they were written with."""
    expected = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for message in batch.column(0).to_pylist():
                rows = pa.ipc.read_record_batch(pa.py_buffer(message), expected)
                yield pa.record_batch([rows.column(f.name).cast(f.type) for f in expected], schema=expected)

    return messages.select("serialized_record_batch").mapInArrow(decode, schema)
