"""Small files and listings on whatever file system Spark reads, through the driver's Hadoop client."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession

FORMATS = {"CSV": "csv", "JSON": "json", "NEWLINE_DELIMITED_JSON": "json", "PARQUET": "parquet", "ORC": "orc", "AVRO": "avro"}
DISPOSITIONS = ("WRITE_APPEND", "WRITE_TRUNCATE", "WRITE_EMPTY")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """A folder with its scheme and authority."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def plain(path: str) -> str:
    """A path in one form, whether Hadoop or a scan's metadata names it."""
    scheme, mark, rest = path.partition(":/")
    return f"{scheme}:/{unquote(rest).lstrip('/')}" if mark else "file:/" + unquote(path).lstrip("/")


def uri(path: str) -> str:
    """A Hadoop path as Arrow's file systems want it."""
    scheme, mark, rest = path.partition(":/")
    return f"{scheme}://{'' if rest.startswith('/') else '/'}{quote(rest.removeprefix('/'), safe='/:@=')}" if mark else path


def listing(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, or the file itself."""
    fs, p = _fs(spark, path)
    found, names = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next().getPath()
        if f.getName()[0] not in "._":
            names.append(f.toString())
    return sorted(names)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename, so that a reader never sees half a file."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    _, fresh = _fs(spark, path + ".new")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(fresh, p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def load(spark: SparkSession, uris: str | list[str], source_format: str, schema=None, autodetect: bool = False, skip_rows: int = 1, delimiter: str = ",") -> DataFrame:
    """A load job's rows. CSV has a header line unless ``skip_rows`` is 0; schemas are given or detected."""
    kind = FORMATS.get(source_format.upper())
    if kind is None:
        raise ValueError(f"unsupported source format {source_format}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", skip_rows > 0).option("sep", delimiter).option("inferSchema", schema is None and autodetect)
    elif kind == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(kind).load([uris] if isinstance(uris, str) else uris)


#: What one file may hold, as the optimizer takes the rows' size to be.
SINGLE_FILE_BYTES = 1 << 30


def extract(df: DataFrame, uri: str, destination_format: str, header: bool = True, delimiter: str = ",", compression: str | None = None, overwrite: bool = False, shard_rows: int | None = None) -> None:
    """An extract job or EXPORT DATA: a folder of files of the format; a ``*`` in the name allows many shards.

    Without it one task writes one file, so that larger results are an error, as in the warehouse.
    """
    kind = FORMATS.get(destination_format.upper())
    if kind is None or kind == "orc":
        raise ValueError(f"unsupported destination format {destination_format}")
    if "*" not in uri and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SINGLE_FILE_BYTES:
        raise ValueError("the result is too large for a single file: put a * into the URI")
    out = df if "*" in uri else df.coalesce(1)
    writer = out.write.mode("overwrite" if overwrite else "errorifexists")
    if compression and compression.upper() != "NONE":
        writer = writer.option("compression", compression.lower())
    if kind == "csv":
        writer = writer.option("header", header).option("sep", delimiter)
    if kind == "json":
        writer = writer.option("ignoreNullFields", False)
    if shard_rows:
        writer = writer.option("maxRecordsPerFile", shard_rows)
    writer.format(kind).save(uri.replace("*", "shards"))
