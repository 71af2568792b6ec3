"""SimHash near-duplicates through deletion-variant signatures.

The 64-bit fingerprint is cut into two halves, fewer than the usual four: of three differing bits one
half holds at most one. Each half is indexed under its 32 variants with one bit wiped out, so halves
that differ in one bit or none meet under an equal key, and an equality join with a check of the
whole fingerprint finds every pair within three bits.

Only different fingerprints take part; copies share theirs and need no pairs. Keys with one holder are dropped by
pre-aggregated counts. Crowded keys (over ``CROWD`` fingerprints) never emit all pairs: their holders are first
tied through whole-fingerprint ball keys (holders of one key lie within two bits of each other, so a star to the
least of them loses nothing). Crowded keys whose holders are then still in different components are compared block
against block, so that no task has more than two blocks of them, and emit links between components alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.common import small_batches, table, words
from tessera.llm.graph import components
from tessera.session import stash

SHINGLE = 3
SEED = 42
MAX_BITS = 3
CROWD = 128
#: Holders of a crowded key that meet as many others in one join key.
BLOCK = 1024
#: Spark takes exploded rows to be as few as their sources, and would broadcast tens of them for each fingerprint.
MERGE = "merge"


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles; zero without words."""
    found = words(text)
    if not found:
        return 0
    if len(found) < SHINGLE:
        shingles = [" ".join(found)]
    else:
        shingles = [f"{a} {b} {c}" for a, b, c in zip(found, found[1:], found[2:])]
    digest = xxhash.xxh64_intdigest
    total, step = np.zeros(64, dtype=np.int64), 1 << 15
    for at in range(0, len(shingles), step):  # long texts in steps: 8 bytes of bits a shingle and bit
        block = np.array([digest(s, SEED) for s in shingles[at : at + step]], dtype=">u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(shingles)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
        yield pa.record_batch([batch.column(0), found], names=["doc_id", "fp"])


def _variants(fp: str):
    """(key, wiped) rows: half * 32 + bit in the key's high part, the half with that bit wiped below."""
    halves = [
        F.array(*[
            F.struct(
                F.lit(half * 32 + bit).alias("slot"),
                F.shiftrightunsigned(F.col(fp), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).alias("rest"),
            )
            for bit in range(32)
        ])
        for half in (0, 1)
    ]
    return F.concat(*halves)


def _linked(one: str, other: str, slot: str):
    """Within the limit, and seen under the one slot that stands for the pair in this half."""
    half = f"(shiftrightunsigned({one} ^ {other}, cast({slot} div 32 * 32 as int)) & {0xFFFFFFFF}L)"
    stands = f"({half} = shiftleft(1L, {slot} % 32) or ({half} = 0 and {slot} % 32 = 0))"
    return F.expr(f"{stands} and bit_count({one} ^ {other}) <= {MAX_BITS}")


def _pairs(keys: DataFrame) -> DataFrame:
    """Links (a, b) among (slot, rest, fp) that share a key."""
    left = keys.select("slot", "rest", F.col("fp").alias("a"))
    right = keys.select(F.col("slot").alias("slot2"), F.col("rest").alias("rest2"), F.col("fp").alias("b"))
    return left.join(right.hint(MERGE), F.expr("slot = slot2 and rest = rest2 and a < b") & _linked("a", "b", "slot")).select("a", "b")


def _across(rooted: DataFrame, block: int) -> DataFrame:
    """Links between components among (slot, rest, fp, root), for keys of any size."""
    key = ["slot", "rest"]
    sizes = rooted.groupBy(*key).agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    sizes = sizes.select(*[F.col(c).alias(f"{c}0") for c in key], F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    held = rooted.join(sizes, (F.col("slot") == F.col("slot0")) & (F.col("rest") == F.col("rest0"))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    held = stash(held.select(*key, "fp", "root", "own", "blocks"), "across")
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # a pair meets once: the smaller fingerprint's block is the first, the larger one's the second
    left = held.select(*key, F.col("fp").alias("a"), F.col("root").alias("root_a"), F.col("own").alias("i"), meets.alias("j"))
    right = held.select(F.col("slot").alias("slot2"), F.col("rest").alias("rest2"), F.col("fp").alias("b"), F.col("root").alias("root_b"), meets.alias("i2"), F.col("own").alias("j2"))
    met = F.expr("slot = slot2 and rest = rest2 and i = i2 and j = j2 and a < b and root_a <> root_b")
    return left.join(right.hint(MERGE), met & _linked("a", "b", "slot")).select("a", "b")


def links(fps: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Different fingerprints (fp) -> edges (a, b) with the same components as all pairs within three bits."""
    keys = fps.select("fp", F.explode(_variants("fp")).alias("k")).select("fp", "k.slot", "k.rest")
    shared = keys.groupBy("slot", "rest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("slot").alias("s"), F.col("rest").alias("r"), "n")
    held = stash(keys.join(shared.hint(MERGE), (F.col("slot") == F.col("s")) & (F.col("rest") == F.col("r"))).select("slot", "rest", "fp", "n"), "keys")
    edges = _pairs(held.where(F.col("n") <= crowd))
    hot = held.where(F.col("n") > crowd)
    if hot.limit(1).count() == 0:
        return edges
    edges = stash(edges, "links")
    members = hot.select("fp").distinct()
    balls = F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {b})")) for b in range(64)]))
    ball = members.select("fp", F.explode(balls).alias("ball"))
    star = ball.groupBy("ball").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    tied = ball.join(star.hint(MERGE), "ball").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    edges = stash(edges.union(tied.distinct()), "links")
    roots = components(edges)
    rooted = hot.drop("n").join(roots, hot.fp == roots.node, "left").select("slot", "rest", "fp", F.coalesce("root", "fp").alias("root"))
    return edges.union(_across(stash(rooted, "rooted"), block))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id reachable over links of
    three bits or fewer. Null and empty texts have fingerprint zero and link like any other. Rows with a null id
    get their group's component_id, null only if no row of the group has an id. Repeated rows stay repeated. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stash(slim.mapInArrow(_fingerprints, "doc_id long, fp long"), "prints")
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), crowd, block))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(rooted.join(first, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline's near-duplicate stage: three bits don't stand for a similarity, so :mod:`minhash` groups the texts."""
    return minhash.keep_one(docs)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component. Null and empty texts have fingerprint zero and link like any other; a null
    doc_id names no component unless its group has no other; repeated rows repeat; an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents"))
