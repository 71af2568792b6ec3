"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Rotations are learned on a bounded sample (principal axes, then iterative quantisation from several starts), and
every vector's code is the signs of its rotated components. The radius is learned there too: the code distance
within which the sample's near neighbours lie. A code is split into substrings, each with an index of its own. By the
pigeonhole principle codes within the radius are near in one of the substrings at least, with limits that add up to
the radius; so probing all values that near in every index retrieves every code in the radius. A check of the whole
code follows, and the floats of what is left are ranked in double precision.

Vectors are dealt into blocks; a block's indexes are built once where its rows are, and meet the queries in
blocks of bounded size, so no task holds more than one block of each. Each block returns its best k a query.
A query with fewer than k finds inside the radius is asked again without one, so every query gets k.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.session import stash

K = 10
QUERY_MODULUS = 100
#: Vectors the rotations and the radius are learned from: about so many, drawn by hash; and how many of them ask.
SAMPLE, ASKING = 10_000, 400
#: Rotations, each with a bit for every component: 256 bits for 64 components.
ROTATIONS = 4
SUBSTRING = 8
#: Share of the sample's neighbours that lie within the radius.
WITHIN = 0.98
#: Rows are sent once for each block of the other side: blocks are as large as a task can hold with ease.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 8_192


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that are not null or zero and have only finite components; rows equal in both count once."""
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "vec_id is not null and v is not null and size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return named.where(fine).dropDuplicates(["vec_id", "v"])


def learn(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotations side by side) by principal axes and iterative quantisation."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned, rng, found = centred @ axes, np.random.default_rng(0), []
    for _ in range(rotations):
        spin = np.linalg.qr(rng.standard_normal((turned.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(turned @ spin >= 0, 1.0, -1.0).T @ turned)
            spin = (u @ v).T
        found.append(axes @ spin)
    return mean, np.hstack(found)


def learn_radius(sample: np.ndarray, mean: np.ndarray, rotation: np.ndarray, k: int, n: int) -> int:
    """The code distance that holds ``WITHIN`` of near neighbours.

    Among n vectors the k-th neighbour is about as far as the (k * len(sample) / n)-th in the sample.
    """
    many = min(len(sample) - 1, max(1, -(-k * len(sample) // n)))
    if many < 1:
        return rotation.shape[1]
    code, squares, distances = codes(sample, mean, rotation), (sample**2).sum(axis=1), []
    for k, x in enumerate(sample[:ASKING]):
        far = squares - 2 * (sample @ x)
        far[k] = np.inf
        near = np.argpartition(far, many - 1)[:many]
        distances.append(np.bitwise_count(code[near] ^ code[k]).sum(axis=1, dtype=np.int32))
    return int(np.quantile(np.concatenate(distances), WITHIN, method="higher"))


def codes(v: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as bytes, a substring each; a last partial byte is filled with zeros."""
    return np.packbits((v - mean) @ rotation >= 0, axis=1)


class Indexes:
    """An index for each substring: the rows in the order of its value, and where each value's rows begin."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.order = [np.argsort(code[:, j], kind="stable") for j in range(code.shape[1])]
        self.start = [np.searchsorted(code[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def probed(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows that are near the query in one substring at least: all within the radius, and others.

        The limits add up to radius - m + 1 over m substrings: codes beyond all of them differ in more bits than the radius.
        """
        many = self.code.shape[1]
        limit, more = divmod(radius - many + 1, many)
        seen = np.zeros(len(self.code), dtype=bool)
        values = np.arange(256, dtype=np.uint8)
        for j, (order, start) in enumerate(zip(self.order, self.start)):
            hit = _BITS[values ^ query[j]] <= limit + (j < more)
            seen[order[np.repeat(hit, np.diff(start))]] = True
        return np.flatnonzero(seen)

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from the query's in at most ``radius`` bits, ascending."""
        rows = self.probed(query, radius)
        return rows[np.bitwise_count(self.code[rows] ^ query).sum(axis=1, dtype=np.int32) <= radius]


_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int32)


def _searcher(mean: np.ndarray, rotation: np.ndarray, k: int, radius: int) -> Callable:
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values(["vec_id", "tag"])
            ids, tags, v = vectors["vec_id"].to_numpy(), vectors["tag"].to_numpy(), np.stack(vectors["v"].to_numpy())
            q_ids, q_tags, q = queries["vec_id"].to_numpy(), queries["tag"].to_numpy(), np.stack(queries["v"].to_numpy())
            index = Indexes(codes(v, mean, rotation))
            for q_id, q_tag, x, code in zip(q_ids, q_tags, q, codes(q, mean, rotation)):
                rows = index.within(code, radius)
                rows = rows[(ids[rows] != q_id) | (tags[rows] != q_tag)]
                distance = np.sqrt(((v[rows] - x) ** 2).sum(axis=1))
                best = np.lexsort((tags[rows], ids[rows], distance))[:k]
                out.append(pd.DataFrame({"query_id": q_id, "query_tag": q_tag, "tag": tags[rows[best]], "vec_id": ids[rows[best]], "score": distance[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_tag": [], "tag": [], "vec_id": [], "score": []})

    return search


def _blocks(spark: SparkSession, n: int, size: int) -> int:
    return max(1, -(-n // size))


def _dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Every row once for each block of the other side."""
    return rows.select(
        "vec_id", "tag", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows but itself, by Euclidean distance, ties to the smaller id.

    Both sides are (vec_id, v) as :func:`usable` gives them. With k rows or fewer all are returned; an empty side gives
    an empty result. Equal vectors under different ids are neighbours at distance zero. An id may stand in several rows
    with different vectors, which ``tag`` tells apart: each is a query and a candidate of its own. Vectors of another
    length than most have (of equally many, the longer) have no distance to those and take no part.
    """
    spark = vectors.sparkSession
    vectors, queries = (side.select("vec_id", "v", F.xxhash64("v").alias("tag")) for side in (vectors, queries))
    vectors, queries = stash(vectors, "vectors"), stash(queries, "queries")
    schema = "query_id long, query_tag long, tag long, vec_id long, score double"
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = sizes or (0, 0)
    vectors, queries = (side.where(F.size("v") == d) for side in (vectors, queries))
    m = queries.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a share of the rows by hash, so that each task sends no more than its part of about ``sample`` rows
    drawn = F.pmod(F.xxhash64("vec_id", "tag"), F.lit(1 << 32))
    share = vectors.select(drawn.alias("h"), "v").where(F.col("h") < (1 << 32) * min(1.0, sample / n))
    taught = share.toPandas().sort_values("h", kind="stable")["v"]
    if not len(taught):  # a share that hit none of few rows
        taught = vectors.limit(sample).toPandas()["v"]
    taught = np.stack(taught.to_numpy())
    mean, rotation = learn(taught)
    radius = learn_radius(taught, mean, rotation, k, n)

    def ask(asked: DataFrame, count: int, within: int) -> DataFrame:
        vb, qb = _blocks(spark, n, VECTOR_BLOCK), _blocks(spark, count, QUERY_BLOCK)
        left = _dealt(vectors, "vb", vb, "qb", qb).groupBy("vb", "qb")
        right = _dealt(asked, "qb", qb, "vb", vb).groupBy("vb", "qb")
        search = _searcher(mean, rotation, k, within)
        return left.cogroup(right).applyInPandas(lambda a, b: search(a, b), schema)

    first = stash(ask(queries, m, radius), "found")
    enough = first.groupBy("query_id", "query_tag").agg(F.count("*").alias("c")).where(F.col("c") >= min(k, n - 1))
    own = (queries["vec_id"] == enough["query_id"]) & (queries["tag"] == enough["query_tag"])
    short = stash(queries.join(enough, own, "left_anti"), "short")
    left = short.count()
    if left:
        again = short.select(F.col("vec_id").alias("query_id"), F.col("tag").alias("query_tag"))
        first = first.join(again, ["query_id", "query_tag"], "left_anti").select(*first.columns).unionByName(ask(short, left, rotation.shape[1]))
    order = Window.partitionBy("query_id", "query_tag").orderBy("score", "vec_id", "tag")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's neighbours. Null, zero and non-finite vectors and null ids take no part; ties go to the
    smaller vec_id; rows equal in id and vector count once; fewer than eleven rows give all others; an empty table none."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(f"vec_id % {QUERY_MODULUS} = 0"))
