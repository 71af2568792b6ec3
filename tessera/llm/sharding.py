"""Shard placement by a permutation-filled lookup table, in DataFrame functions alone.

Every shard has its own order of preference over the slots of a prime-sized table, given by an offset and
a skip from its name's hash; shards take turns and each claims the first slot it likes that is still free.
The table's size is fixed, so broadcasting it is safe whatever the data; a row's place is one hash, one
modulus and one look-up. When a shard leaves, nearly only its own slots change hands.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table

SLOTS = 65_537
SHARDS = 64
#: A hash is the first 15 hex digits of an MD5, which fits a signed 64-bit number in every engine.
_DIGITS = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it; work and result are bounded by ``slots``.

    ``slots`` must be prime, so that every skip visits all of them, and no less than the shards.
    """
    if not shards or len(shards) > slots or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, no less than the number of shards, and there must be a shard")
    spot = [_hash(f"offset:{s}") % slots for s in shards]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            if not left:
                break
            while owner[spot[k]] >= 0:
                spot[k] = (spot[k] + skip[k]) % slots
            owner[spot[k]] = k
            left -= 1
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the filled table: ``slots`` rows."""
    filled = F.from_json(F.lit(json.dumps(fill(shards, slots))), "array<int>")
    return spark.range(1).select(F.posexplode(filled).alias("slot", "shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key's text; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of those names are replaced.

    Rows are placed by their own key, so a source or group that holds a third of them is spread over all shards.
    Null keys share one slot; repeated keys go together; an empty table gives an empty result.
    """
    names = shards or [f"shard-{k:05d}" for k in range(SHARDS)]
    seen = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")])
    found = F.broadcast(lookup(docs.sparkSession, names, slots))  # ``slots`` rows of two integers, never more
    name = fresh(seen.columns, "_slot")
    placed = seen.withColumn(name, slot_of(F.col(f"`{key}`"), slots))
    return placed.join(found, placed[name] == found["slot"]).drop(name)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, with the digest of its text that a shard's manifest would carry."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    placed = place(docs)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", "slot", "shard", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"))


def oracle() -> str:
    """The query in SQL, with the filled table written out."""
    filled = ", ".join(map(str, fill([f"shard-{k:05d}" for k in range(SHARDS)])))
    return f"""
WITH filled AS (SELECT [{filled}] AS owner),
placed AS (
  SELECT doc_id, text, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {_DIGITS}))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, owner[slot + 1]::INTEGER AS shard, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS text_md5
FROM placed, filled
"""

