"""Byte-level BPE in SQL: recursive contraction to encode, ordered aggregation to decode.

Each Python worker holds a small DuckDB with the merge table (left id, right id -> merged id, which is
also the rank). Texts are cut where no token can cross: at single spaces, or, in texts with longer runs
of white space, by the pre-tokenising pattern itself. Words new to the worker's bounded cache go to the
recursive query together: their token-position rows join the merge table, each word's leftmost pair of
least rank is contracted, and words without a pair stand still. Decoding sends the distinct id words to
an ordered aggregation over the vocabulary's bytes.

In a long word, many places are contracted in one step: each whose rank is the least of all pairs as near as the
longest token. That gives the same ids. A pair could only lose one of its two tokens to a neighbour that has grown
meanwhile; tokens grow through ranks below their own, so the neighbour would hold a pair of lower rank now, and
hold it within its own length. Places of one pair that overlap are contracted from their run's left, two by two.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back, small_batches, table

#: Words of more bytes have many places contracted in a step, shorter ones the one place of their least pair.
OFTEN = 64
#: Bytes of words that go to the query together.
TOGETHER = 1 << 20
CACHE = 200_000
_POS = 1 << 30

#: A step's rows with a pair below; `[:-2]` and `[2:]` are a word's left and right ids.
_TOKEN = """
  token AS (
     SELECT w, unnest(ids[:-2]) * 65536 + unnest(ids[2:]) AS pair, unnest(range(1, len(ids))) AS pos
     FROM parts WHERE len(ids) > 1)"""

_CONTRACT = f"""
WITH RECURSIVE parts AS (
  SELECT w, ids, 0 AS step FROM words
  UNION ALL
  (WITH {_TOKEN},
   best AS (
     SELECT token.w, min(merges.id * {_POS} + token.pos) AS found
     FROM token JOIN merges ON merges.pair = token.pair GROUP BY token.w)
   SELECT parts.w, ids[:(found & {_POS - 1}) - 1] || [found >> 30] || ids[(found & {_POS - 1}) + 2:], step + 1
   FROM parts JOIN best ON best.w = parts.w))
SELECT w, arg_max(ids, step) AS ids FROM parts GROUP BY w ORDER BY w
"""

#: Every place whose rank is the least of its stretch of {reach} positions and of the two stretches beside it.
_CONTRACT_MANY = f"""
WITH RECURSIVE parts(w, ids) USING KEY (w) AS (
  SELECT w, ids FROM words
  UNION
  (WITH {_TOKEN},
   ranked AS (SELECT token.w, token.pos, token.pos // {{reach}} AS stretch, merges.id, merges.twin FROM token JOIN merges ON merges.pair = token.pair),
   near AS (
     SELECT w, stretch + beside AS stretch, min(least) AS least
     FROM (SELECT w, stretch, min(id) AS least FROM ranked GROUP BY w, stretch), (VALUES (-1), (0), (1)) AS b(beside) GROUP BY ALL),
   judged AS (SELECT ranked.*, id = least AS first FROM ranked JOIN near ON near.w = ranked.w AND near.stretch = ranked.stretch),
   twins AS (SELECT w, pos, id, first, pos - row_number() OVER (PARTITION BY w, id ORDER BY pos) AS run FROM judged WHERE twin),
   turns AS (
     SELECT w, pos, id, row_number() OVER own AS turn, bool_and(first) OVER (PARTITION BY w, id, run) AS whole
     FROM twins WINDOW own AS (PARTITION BY w, id, run ORDER BY pos)),
   chosen AS (
     SELECT w, pos, id FROM judged WHERE first AND NOT twin UNION ALL SELECT w, pos, id FROM turns WHERE whole AND turn % 2 = 1),
   piece AS (SELECT w, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM parts WHERE w IN (SELECT w FROM chosen)),
   kept AS (
     SELECT piece.w, piece.pos, coalesce(chosen.id, piece.id) AS id
     FROM piece LEFT JOIN chosen ON chosen.w = piece.w AND chosen.pos = piece.pos
     ANTI JOIN (SELECT w, pos + 1 AS pos FROM chosen) AS gone ON gone.w = piece.w AND gone.pos = piece.pos)
   SELECT w, list(id ORDER BY pos) FROM kept GROUP BY w))
SELECT w, ids FROM parts ORDER BY w
"""

_EXPAND = """
SELECT w, string_agg(piece, '' ORDER BY pos) AS piece
FROM (SELECT w, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM words) JOIN vocabulary USING (id)
GROUP BY w ORDER BY w
"""

_RUN = re.compile(r"\s\s")


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The pair that a token is merged from, always the same one: what inside it ranks before it is contracted first."""
    parts, rank = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(ranks[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in ranks]
        least, i = min(found, default=(rank, 0))
        if least >= rank:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class Vocabulary:
    """A rank file as the merge table, made once on the driver and broadcast; its size is the file's."""

    def __init__(self, blob: bytes, pattern: str):
        ranks = read_ranks(blob)
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("a vocabulary may have ids below 65536")
        merges = {rank: pair for token, rank in ranks.items() if len(token) > 1 and (pair := last_pair(token, ranks))}
        # always so in a vocabulary that was trained by merging; with another, only the least place is contracted
        self.grows = all(part < rank for rank, pair in merges.items() for part in pair)
        self.longest = max(map(len, ranks))
        self.pattern = pattern
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.merges = pa.table({
            "pair": pa.array([a * 65536 + b for a, b in merges.values()], pa.int64()),
            "id": pa.array(merges, pa.int64()),
            "twin": pa.array([a == b for a, b in merges.values()], pa.bool_()),
        })
        # a byte is a character of the same number, so that partial characters can be joined as text
        self.pieces = pa.table({"id": pa.array(ranks.values(), pa.int64()), "piece": [t.decode("latin-1") for t in ranks]})
        self.name = hashlib.sha256(blob + pattern.encode()).hexdigest()


def _rows(flat: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """Numbered rows of ids, cut at the offsets."""
    ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int64, copy=False)))
    return pa.table({"w": pa.array(np.arange(len(offsets) - 1)), "ids": ids})


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and the bytes of a large binary or large string array."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _groups(sizes: np.ndarray) -> list[np.ndarray]:
    """Numbers in groups of about ``TOGETHER`` bytes, or of one where that is larger."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1) if len(sizes) else []


class Words:
    """The rows of a batch as distinct byte strings, the number of each place's string, and where each row's places end."""

    def __init__(self, distinct: list[bytes], codes: np.ndarray, ends: np.ndarray):
        self.distinct, self.codes, self.ends = distinct, codes, ends

    def joined(self) -> tuple[np.ndarray, list[int]]:
        """All rows' bytes one after the other, and where each row begins, with the end last."""
        return _joined(pa.array(self.distinct, pa.large_binary()).take(pa.array(self.codes)), self.ends)

    def rows(self) -> list[bytes]:
        data, at = self.joined()
        return [data[a:b].tobytes() for a, b in zip(at, at[1:])]


def _joined(places: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, list[int]]:
    offsets, data = _parts(places)
    return data, [0, *offsets[ends].tolist()]


class Codec:
    """Encoder and decoder of one vocabulary; keeps two generations of its latest words. Ids are two bytes each."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        import duckdb
        import regex

        self.find = regex.compile(vocabulary.pattern).findall
        self.byte = np.array(vocabulary.byte, dtype=np.int64)
        self.many = _CONTRACT_MANY.format(reach=vocabulary.longest) if vocabulary.grows else _CONTRACT
        self.decimal = pa.array([b"%d," % i for i in range(1 << 16)], pa.large_binary())
        self.cache = cache
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.decoded_old: dict[bytes, bytes] = {}
        # a worker's own scratch, which only words of many megabytes need
        scratch = os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": scratch})
        self.db.execute("SET preserve_insertion_order = false")
        for name, held in (("merges", vocabulary.merges), ("vocabulary", vocabulary.pieces)):
            self.db.register("held", held)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM held")

    def _ask(self, query: str, rows: pa.Table, column: str) -> pa.Array:
        self.db.register("words", rows)
        return self.db.sql(query).to_arrow_table().column(column).combine_chunks()

    def _contract(self, words: pa.Array) -> pa.Array:
        """The id word of each word, both as large binary arrays."""
        sizes, done, order = np.diff(_parts(words)[0]), [], []
        for query, chosen in ((_CONTRACT, sizes <= OFTEN), (self.many, sizes > OFTEN)):
            own = np.flatnonzero(chosen)
            for group in _groups(sizes[own]):
                offsets, data = _parts(words.take(pa.array(own[group])))
                found = self._ask(query, _rows(self.byte[data], offsets), "ids")
                done.append(_binary(found.offsets.to_numpy().astype(np.int64) * 2, found.values.to_numpy().astype("<u2").tobytes()))
                order.append(own[group])
        if not done:
            return pa.array([], pa.large_binary())
        return pa.concat_arrays(done).take(pa.array(np.argsort(np.concatenate(order))))

    def _keyed(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct keys of a batch, every word's number among them, and where each text's words end."""
        runs = [k for k, t in enumerate(texts) if _RUN.search(t)]
        own = {k: self.find(texts[k]) for k in runs}
        split = pc.split_pattern(pa.array(["" if k in own else t for k, t in enumerate(texts)], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        keys, codes, starts = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()[:-1]
        # first words follow no space, and words of texts with runs of white space stand as they are
        marked: dict[str, int] = {}
        first = [marked.setdefault(" " + keys[c], len(keys) + len(marked)) for c in codes[starts].tolist()]
        codes[starts] = first
        sizes = np.diff(np.append(starts, len(codes)))
        if own:
            rows = np.split(codes, starts[1:])
            for k, found in own.items():
                rows[k] = np.array([marked.setdefault(" " + x, len(keys) + len(marked)) for x in found], dtype=np.int64)
                sizes[k] = len(found)
            codes = np.concatenate(rows)
        return [*keys, *marked], codes, np.cumsum(sizes)

    def learn(self, keys: set[str]) -> None:
        """Bring the words of a batch into the cache."""
        if len(self.new) > self.cache:
            self.old, self.new = self.new, {}
        missing = keys - self.new.keys()
        held = missing & self.old.keys()
        for k in held:
            self.new[k] = self.old[k]
        missing -= held
        if not missing:
            return
        pieces, ends = [], [0]
        for k in missing:
            pieces += self.find(k[1:] if k[:1] == " " else " " + k)
            ends.append(len(pieces))
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        offsets, data = _parts(self._contract(coded.dictionary.cast(pa.large_binary())).take(coded.indices))
        at, flat = offsets[ends].tolist(), data.tobytes()
        self.new.update(zip(missing, [flat[a:b] for a, b in zip(at, at[1:])]))

    def rest(self) -> None:
        """Between tasks the latest words are enough; other operators may use the worker meanwhile."""
        self.old, self.decoded_old = {}, {}
        give_back()

    def encode(self, texts: list[str]) -> Words:
        """Every text's id words."""
        if not texts:
            return Words([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, codes, ends = self._keyed(texts)
        self.learn(set(keys))
        return Words(list(map(self.new.__getitem__, keys)), codes, ends)

    def decode(self, words: Words) -> Words:
        """The same, with the bytes that each id word stands for."""
        if len(self.decoded) > self.cache:
            self.decoded_old, self.decoded = self.decoded, {}
        missing = set(words.distinct) - self.decoded.keys()
        held = missing & self.decoded_old.keys()
        for w in held:
            self.decoded[w] = self.decoded_old[w]
        todo = pa.array(list(missing - held - {b""}), pa.large_binary())
        self.decoded[b""] = b""
        for group in _groups(np.diff(_parts(todo)[0]) if len(todo) else np.zeros(0)):
            part = todo.take(pa.array(group))
            offsets, data = _parts(part)
            found = self._ask(_EXPAND, _rows(data.view("<u2"), offsets // 2), "piece").cast(pa.large_string())
            flat = _parts(found)[1].tobytes().decode().encode("latin-1")
            at = np.concatenate([[0], np.cumsum(pc.utf8_length(found).to_numpy())]).tolist()
            self.decoded.update(zip(part.to_pylist(), [flat[a:b] for a, b in zip(at, at[1:])]))
        return Words(list(map(self.decoded.__getitem__, words.distinct)), words.codes, words.ends)


_codecs: dict[str, Codec] = {}


def codec(vocabulary: Vocabulary) -> Codec:
    """The worker's codec of a vocabulary, kept between its tasks."""
    if vocabulary.name not in _codecs:
        _codecs.clear()
        _codecs[vocabulary.name] = Codec(vocabulary)
    return _codecs[vocabulary.name]


def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """By default, the vocabulary that the registered query names."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return Vocabulary(f.read(), pattern or public_tokenizers.PATTERN)


def _over_texts(spark: SparkSession, path: str | None, pattern: str | None, row: Callable) -> Callable:
    """A function over Arrow batches (key, text); the vocabulary, of fixed size, is broadcast once."""
    held = spark.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            yield row(own, batch, [t or "" for t in batch.column(1).to_pylist()])
        own.rest()

    return run


def _with_ids(own: Codec, batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    data, at = own.encode(texts).joined()
    ids = pa.ListArray.from_arrays(pa.array(np.array(at) // 2, pa.int32()), pa.array(data.view("<u2").astype(np.int32)))
    return pa.record_batch([batch.column(0), ids], names=["doc_id", "token_ids"])


def _digests(own: Codec, batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    words = own.encode(texts)
    data, at = words.joined()
    ends = np.array(at, dtype=np.int64) // 2
    decimals, d = _joined(own.decimal.take(pa.array(data.view("<u2"))), ends[1:])
    ids = [hashlib.sha256(decimals[a : max(a, b - 1)]).hexdigest() for a, b in zip(d, d[1:])]
    back, e = own.decode(words).joined()
    whole = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(e, e[1:])]
    columns = [batch.column(0), pa.array(np.diff(ends)), pa.array(ids, pa.string()), pa.array(whole, pa.string())]
    return pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, token_ids) of every whole text; null and empty texts have no ids, null doc_ids stay null, repeated rows
    repeat, whatever else the table holds is ignored, and an empty table gives no rows."""
    small_batches(docs.sparkSession, 4 << 20)
    run = _over_texts(docs.sparkSession, path, pattern, _with_ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, token_ids) -> (doc_id, content binary); null ids count as none."""
    spark = encoded.sparkSession
    small_batches(spark, 4 << 20)
    held = spark.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for batch in batches:
            rows = [np.array(x or [], dtype="<u2").tobytes() for x in batch.column(1).to_pylist()]
            every = np.arange(len(rows))
            yield pa.record_batch([batch.column(0), pa.array(own.decode(Words(rows, every, every + 1)).rows(), pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and its ids decoded again.

    Null and empty texts have no ids; a null doc_id stays null; repeated rows repeat; other columns are
    ignored whatever their names; an empty table gives an empty result. Texts are never cut.
    """
    small_batches(docs.sparkSession, 4 << 20)
    run = _over_texts(docs.sparkSession, path, pattern, _digests)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text. Null and empty texts have no ids; null doc_ids stay null and repeated rows repeat; an empty table
    gives no rows."""
    return round_trip(table(spark, sf_dir, "documents"))
