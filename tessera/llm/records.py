"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A file is a sequence of records: length (8 bytes, little-endian), masked checksum of those 8 bytes,
payload, masked checksum of the payload. A checksum is a CRC-32, rotated right by 15 bits plus a
constant, so that checksums over framed data differ from those inside it. A payload is the doc_id (8
bytes, with a byte before it that tells null), the width of an id (2 or 4 bytes, 2 where the vocabulary
fits), and the ids. The index beside it has for each record: offset, ids before it in this file, ids in it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table
from tessera.session import scratch_path, stash

END = 1
CACHE = 800_000
READ = 32 << 20
_MASK = 0xA282EAD8
_HEAD = "<?qB"
_INDEX = np.dtype([("offset", "<i8"), ("start", "<i8"), ("ids", "<i8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload that begins at ``at``, and where the next record does."""
    size = data[at : at + 8]
    if struct.unpack_from("<I", data, at + 8)[0] != masked(size):
        raise ValueError(f"record at {at}: the length's checksum differs")
    end = at + 12 + struct.unpack("<Q", size)[0]
    payload = data[at + 12 : end]
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"record at {at}: the payload's checksum differs")
    return payload, end + 4


class Words:
    """The tokenizer's ids of whole texts, put together from words between spaces that are kept in a bounded cache.

    The normaliser and the pattern of this vocabulary never look across a space, so words can be encoded alone.
    """

    def __init__(self, blob: bytes, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.cache = cache
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, the end id last; only the distinct words of a batch are looked up one by one."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        self.learn(set(keys))
        places = pa.array(list(map(self.new.__getitem__, keys)), pa.large_binary()).take(coded.indices)
        offsets = np.frombuffer(places.buffers()[1], dtype=np.int64)
        data = memoryview(places.buffers()[2] or b"")
        at = offsets[split.offsets.to_numpy()].tolist()
        end = np.array([END], dtype=self.kind).tobytes()
        return [b"".join((data[a:b], end)) for a, b in zip(at, at[1:])]

    def learn(self, keys: set[str]) -> None:
        """Bring the words of a batch into the cache."""
        if len(self.new) > self.cache:
            self.old, self.new = self.new, {}
        missing = keys - self.new.keys()
        for k in (held := missing & self.old.keys()):
            self.new[k] = self.old[k]
        fresh = list(missing - held)
        for at in range(0, len(fresh), 10_000):
            part = fresh[at : at + 10_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.new.update((k, struct.pack(f"<{len(ids := e.ids)}{self.code}", *ids)) for k, e in zip(part, found))


_words: dict[int, Words] = {}


def _own_words(blob: bytes) -> Words:
    key = zlib.crc32(blob)
    if key not in _words:
        _words.clear()
        _words[key] = Words(blob)
    return _words[key]


def write(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write every text's ids, in ascending doc_id order over all files -> a row a file, with its first ids' place.

    Files are the ranges of a range partitioning, so none needs the whole table, and a retried task writes
    the same file again under another name that is moved into place.
    """
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark, 4 << 20)
    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        held = spark.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size
    folder = scratch_path(spark, "records")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own_words(held.value)
        width = np.dtype(own.kind).itemsize
        store, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, attempt = f"{task.partitionId():06d}", f"{task.partitionId():06d}.{task.taskAttemptId()}"
        first, at, total, index = None, 0, 0, []
        out = None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, tokens in zip(ids, own.encode([t or "" for t in batch.column(1).to_pylist()])):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out, first = store.open_output_stream(f"{root}/{attempt}.tmp"), doc
                record = frame(struct.pack(_HEAD, doc is None, doc or 0, width) + tokens)
                out.write(record)
                index.append((at, total, len(tokens) // width))
                at, total = at + len(record), total + len(tokens) // width
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{root}/{attempt}.idx.tmp") as side:
            side.write(np.array(index, dtype=_INDEX).tobytes())
        store.move(f"{root}/{attempt}.idx.tmp", f"{root}/{name}.idx")
        store.move(f"{root}/{attempt}.tmp", f"{root}/{name}.rec")
        row = {"file": [f"{folder}/{name}"], "shard": [task.partitionId()], "bytes": [at], "docs": [len(index)], "ids": [total]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("shard", pa.int32()), ("bytes", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    # ranges over the text's hash too, so that one doc_id in very many rows, or null, is no single range
    ranged = slim.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")
    files = stash(ranged.mapInArrow(put, "file string, shard int, bytes long, docs long, ids long"), "files")
    # one row a file: a running sum over files, not over rows
    return files.withColumn("base", F.expr("coalesce(sum(ids) over (order by shard rows between unbounded preceding and 1 preceding), 0)"))


def _spread(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _index(name: str) -> np.ndarray:
    store, root = pafs.FileSystem.from_uri(name)
    with store.open_input_stream(f"{root}.idx") as side:
        return np.frombuffer(side.read(), dtype=_INDEX)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of about ``block`` bytes of records: a file's index is read once."""
    for batch in batches:
        for name, base, size in zip(*(c.to_pylist() for c in batch.columns)):
            offsets = _index(name)["offset"]
            first = np.unique(np.searchsorted(offsets, np.arange(0, size, block)))
            first = first[first < len(offsets)]
            ends = np.append(first[1:], len(offsets))
            begins = offsets[first]
            sizes = np.append(begins[1:], size) - begins
            columns = [pa.array([name] * len(first), pa.string()), pa.array([base] * len(first), pa.int64()), *(pa.array(x, pa.int64()) for x in (first, ends - first, begins, sizes))]
            yield pa.record_batch(columns, names=["file", "base", "first", "many", "begin", "size"])


def _tokens(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc, width = struct.unpack_from(_HEAD, payload)
    return None if null else doc, np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(_HEAD)).astype("<u4")


def read(files: DataFrame, block: int = READ) -> DataFrame:
    """Read the files back, in blocks that the index delimits -> (doc_id, start, n_tokens, ids_crc32)."""
    spread = files.select("file", "base", "bytes").repartition(_spread(files.sparkSession), "file")
    blocks = spread.mapInArrow(lambda rows: _blocks(rows, block), "file string, base long, first long, many long, begin long, size long")
    blocks = blocks.repartition(_spread(files.sparkSession), "file", "begin")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, first, many, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, root = pafs.FileSystem.from_uri(name)
                with store.open_input_file(f"{root}.idx") as side:
                    starts = np.frombuffer(side.read_at(many * _INDEX.itemsize, first * _INDEX.itemsize), dtype=_INDEX)["start"]
                with store.open_input_file(f"{root}.rec") as f:
                    data = f.read_at(size, begin)
                rows, at = [], 0
                for start in starts.tolist():
                    payload, at = unframe(data, at)
                    doc, tokens = _tokens(payload)
                    rows.append((doc, base + start, len(tokens), zlib.crc32(tokens.tobytes())))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def index(files: DataFrame) -> DataFrame:
    """(file, offset, size, start, n_tokens) of every record: what a loader needs to read any of them alone."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, size in zip(*(c.to_pylist() for c in batch.columns)):
                held = _index(name)
                sizes = np.append(held["offset"][1:], size) - held["offset"]
                columns = [pa.array([name] * len(held), pa.string()), *(pa.array(x, pa.int64()) for x in (held["offset"], sizes, held["start"] + base, held["ids"]))]
                yield pa.record_batch(columns, names=["file", "offset", "size", "start", "n_tokens"])

    spread = files.select("file", "base", "bytes").repartition(_spread(files.sparkSession), "file")
    return spread.mapInArrow(look, "file string, offset long, size long, start long, n_tokens long")


def fetch(located: DataFrame) -> DataFrame:
    """Rows of :func:`index`, in any order and any choice of them -> the same with doc_id and token_ids, read one by one."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def opened(name: str) -> pa.NativeFile:
            store, root = pafs.FileSystem.from_uri(name)
            return store.open_input_file(f"{root}.rec")

        for batch in batches:
            docs, ids = [], []
            for file, offset, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc, tokens = _tokens(unframe(opened(file).read_at(size, offset), 0)[0])
                docs.append(doc)
                ids.append(tokens)
            yield pa.record_batch([*batch.columns, pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))], names=[*batch.schema.names, "doc_id", "token_ids"])

    slim = located.select("file", "offset", "size", "start", "n_tokens")
    return slim.mapInArrow(get, "file string, offset long, size long, start long, n_tokens long, doc_id long, token_ids array<long>")


def shuffled(files: DataFrame, seed: int = 0) -> DataFrame:
    """Every record, in an order that the seed draws over all files: only index rows are shuffled, not the records."""
    order = F.xxhash64(F.lit(seed), "file", "offset")
    drawn = index(files).withColumn("_order", order).repartitionByRange(_spread(files.sparkSession), "_order").sortWithinPartitions("_order")
    return fetch(drawn)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are the end id alone; null doc_ids come first; rows that repeat a doc_id follow each
    other in any order; an empty table gives an empty result."""
    return read(write(table(spark, sf_dir, "documents")))
