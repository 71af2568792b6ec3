"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
_BLANKS = str.maketrans({c: " " for c in SPACES})
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}) | _BLANKS


def words(text: str | None) -> list[str]:
    """The words of a text, with ASCII letters in lower case."""
    lowered = text.lower() if text and text.isascii() else (text or "")
    return [w for w in lowered.translate(_LOWER).split(" ") if w]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession, max_bytes: int = 16 << 20) -> None:
    """Bound the Arrow batches sent to Python workers by bytes, so that long texts can't pile up.

    A tighter bound that the session already has is left alone. The setting stays with the session, as Spark reads it
    when a plan runs; it costs later queries more, smaller batches and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) if held else 0
    if not 0 < now <= max_bytes:
        spark.conf.set(key, str(max_bytes))


def give_back() -> None:
    """Return a Python worker's free memory to the system at the end of a task, as other operators use the worker next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh(columns: list[str], base: str) -> str:
    """A column name that none of the given has, whatever its case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
