"""The pipeline's stages against brute force, with null and repeated ids among the rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ann, minhash, mixing, simhash


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    """The group of each text: links are Jaccard similarities of 0.8 or more; all texts without words are equal."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first, held = {}, defaultdict(list)
    for k, s in enumerate(sets):
        if s in first:
            parent[k] = first[s]
            continue
        first[s] = k
        for other, both in Counter(o for x in s for o in held[x]).items():
            if 5 * both >= 4 * (len(s) + len(sets[other]) - both):
                parent[find(k)] = find(other)
        for x in s:
            held[x].append(k)
    return [find(k) for k in range(len(texts))]


def brute_kept(rows):
    """The least id of each group, nulls last."""
    groups = defaultdict(list)
    for (doc_id, text), g in zip(rows, brute_groups([t for _, t in rows])):
        groups[g].append((doc_id is None, doc_id or 0))
    return sorted(min(ids) for ids in groups.values())


def kept(docs):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.keep_one(docs).collect())


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert kept(docs) == brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("stars,block", [(0, 256), (0, 5), (1, 2), (2, 3)])
def test_near_duplicate_links(spark, monkeypatch, stars, block):
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = [f"word{k}" for k in range(200)]
    texts = []
    for k in range(12):  # a chain: each text differs from the one before in four words, ends are far apart
        texts.append(" ".join([f"new{j}" if j < 8 * k else w for j, w in enumerate(base)]))
    texts += [" ".join(base[100:] + [f"own{k}x{j}" for j in range(100)]) for k in range(12)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert kept(docs) == brute_kept(list(enumerate(texts))) and len(kept(docs)) == 13


def test_shared_shingles(monkeypatch):
    monkeypatch.setattr(minhash, "_STEP", 7)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 40, 40, 41, 200)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    above = np.triu_indices(len(sets), 1)
    assert minhash._shared(sets)[above].tolist() == want[above].tolist()
    assert minhash._shared([sets[0], sets[0]]).tolist() == [[0, 0], [0, 0]]


def test_one_row_of_each_group(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(None, text)] * 50 + [(7, text + " end"), (3, text.upper())]  # one group with an id
    rows += [(None, "a text that only rows without an id have")] * 50
    rows += [(1, "first text under an id that is repeated"), (1, "second text under it"), (2, "second  text under it"), (1, "second text under it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = simhash.keep_one(docs)
    assert kept(docs) == brute_kept(rows) == [(False, 1), (False, 1), (False, 3), (True, 0)]
    assert simhash.keep_one(docs.where("doc_id is null")).count() == 2
    assert {r["text"] for r in found.where("doc_id = 1").collect()} == {rows[-4][1], rows[-1][1]}


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    plans, stash = {}, simhash.stash

    def kept_plan(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stash(df, name)

    monkeypatch.setattr(simhash, "stash", kept_plan)
    fps = spark.createDataFrame([(1 << k,) for k in range(9)], "fp long")
    found = simhash.links(simhash.stash(fps, "fps"), crowd=2, block=2)
    plans["found"] = [found._jdf.queryExecution().executedPlan().toString()]
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    for name in ("keys", "links", "found"):  # keys and counts; pairs, then balls; blocks of crowded keys
        assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans[name]), name


def test_mixed_takes_each_row_by_its_own_copies(spark):
    rows = [(None, "a", " ".join(["w"] * 10) + f" n{k}") for k in range(1000)] + [(5, "b", f"x y n{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    given = mixing.mix(mixing.sized(docs), (1, 20)).collect()
    want = {s: sum(r["copies"] for r in given if r["source"] == s) for s in "ab"}
    assert 0 < sum(r["copies"] == 0 for r in given) < len(given)
    out = mixing.mixed(docs, (1, 20)).collect()
    assert Counter(r["source"] for r in out) == want
    assert max(Counter(out).values()) <= mixing.CAP and set(map(tuple, out)) <= set(rows)


def test_neighbours_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(k // 2, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((60, 16)))]
    vectors = ann.usable(spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>"))
    assert vectors.count() == 60
    got = ann.nearest(vectors, vectors.where("vec_id % 3 = 0"), 100).collect()
    want = []
    for a, (q, x) in enumerate(rows):
        found = sorted((math.dist(x, y), d) for b, (d, y) in enumerate(rows) if a != b)
        want += [(q, rank, d, round(score, 9)) for rank, (score, d) in enumerate(found, 1) if q % 3 == 0]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)
