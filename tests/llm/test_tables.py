import hashlib
import io
import math
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, graph, mixing, qda, sharding, warc


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- archives


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("force", [False, True])
def test_directory(force):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(3):
            with z.open(zipfile.ZipInfo(f"m{k}"), "w", force_zip64=force) as f:
                f.write(b"x" * k + b"payload")
        z.comment = b"a comment"
    f = Bytes(out.getvalue())
    found = warc.directory(f)
    assert [m.name for m in found] == ["m0", "m1", "m2"]
    assert [f.read_at(m.size, warc.begin(f, m)) for m in found] == [b"payload", b"xpayload", b"xxpayload"]


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first", b"a" * 50)
        z.writestr("second", b"b" * 60)
    f = Bytes(out.getvalue())
    assert warc.LOCATOR64_SIGNATURE in f.data
    assert [f.read_at(m.size, warc.begin(f, m)) for m in warc.directory(f)] == [b"a" * 50, b"b" * 60]


def test_directory_rejects():
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(Bytes(b"nothing here"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 100)
    f = Bytes(out.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        warc.begin(f, warc.directory(f)[0])


def test_warc_records_are_valid():
    payload, digest = "é".encode() * 10, hashlib.sha1("é".encode() * 10).hexdigest()
    own = warc.record_id("a", 1)
    assert own == warc.record_id("a", 1) != warc.record_id("a", 2)
    data = warc.record("response", own, 5, "http://a.org/x", "2024-01-02T03:04:05Z", payload, digest)
    whole = zlib.decompress(data, wbits=31)
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    fields, http, body = warc.parse(data)
    assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(fields) and fields["content-type"].startswith("application/http")
    assert body == payload and http["content-length"] == "20" and fields["x-page-id"] == "5"
    fields, http, body = warc.parse(warc.record("revisit", own, None, "u", "2024-01-02T03:04:05Z", payload, digest, ("<urn:uuid:b>", 9)))
    assert body == b"" and http["content-length"] == "20" and fields["warc-refers-to"] == "<urn:uuid:b>" and "x-page-id" not in fields


@pytest.mark.parametrize("uri,key", [("http://www.a.org/B?c=d", "org,a,www)/b?c=d"), ("https://a.org:80", "org,a:80)/"), ("x y", "x%20y"), ("", "-")])
def test_warc_sort_keys(uri, key):
    assert warc.sort_key(uri) == key


@pytest.mark.parametrize("few", [0, 10])
def test_warc_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc.write, "__defaults__", (*warc.write.__defaults__[:-1], few))
    long = "é" * 600  # 1200 bytes
    data = [(1, "http://a/", long), (2, "u v\n", long), (3, None, "short"), (4, "x", "short"), (5, "x", None), (6, "x", long + "!"), (None, "x", long), (7, "x", "y" * 1000), (7, "x", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string")
    want = []
    for page, _, html in data:
        body = (html or "").encode()
        same = [p for p, _, h in data if (h or "").encode() == body and p is not None]
        again = len(body) >= 1000 and len([1 for _, _, h in data if (h or "").encode() == body]) > 1 and page != max(same)
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert rows(warc.round_trip(pages)) == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_many_archives(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 2000).alias("html"))
    archives = warc.write(pages, archive_bytes=200)
    assert archives.count() > 10
    lines = []
    for r in archives.collect():
        with zipfile.ZipFile(r["archive"].removeprefix("file://")) as z:
            own = z.read(warc.INDEX).decode().splitlines()
            assert own == sorted(own)
            lines += own
    assert len(lines) == 40
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(archives).collect()}
    assert got == {k: str(k) * 2000 for k in range(40)}


# -- mixing


def brute_targets(sizes):
    """sizes by source, in order -> targets, by sharing round after round."""
    total, full = sum(sizes), {}
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    while True:
        rest = total - sum(full.values())
        sharing = sum(w for k, w in enumerate(weights) if k not in full)
        share = {k: rest * w / sharing for k, w in enumerate(weights) if k not in full}
        over = {k: 3 * sizes[k] for k in share if share[k] > 3 * sizes[k]}
        if not over:
            return [full[k] if k in full else share[k] for k in range(len(sizes))]
        full |= over


def test_targets(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 20):
        sizes = [int(x) for x in 10 ** rng.uniform(0, 5, n)]
        per = spark.createDataFrame([(f"s{k:02d}", 1, s) for k, s in enumerate(sizes)], "source string, docs long, source_size long")
        got = [r["target"] for r in mixing.targets(per).orderBy("source").collect()]
        assert np.allclose(got, brute_targets(sizes))


def test_duals_against_bisection(spark):
    """The tilt of each source by bisection over all documents, one by one."""
    rng = np.random.default_rng(3)
    own = {f"s{k}": [int(x) for x in rng.lognormal(3 + k, 0.7, 150)] for k in range(5)}
    docs = spark.createDataFrame([(s, x) for s, sizes in own.items() for x in sizes], "h_source string, size long")
    histogram = docs.groupBy("h_source", "size").agg(F.count("*").alias("n"))
    per = histogram.groupBy(F.col("h_source").alias("source")).agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = mixing.targets(per)
    want = {}
    for r in goal.collect():
        sizes = np.array(own[r["source"]], dtype=float)
        if r["target"] < 3 * sizes.sum():
            low, high = -60.0, 60.0
            for _ in range(200):
                lam = (low + high) / 2
                over = (sizes * np.minimum(np.exp(np.minimum(lam * sizes / sizes.mean(), 50)), 3)).sum() > r["target"]
                low, high = (low, lam) if over else (lam, high)
            want[r["source"]] = lam
    got = {r["source"]: r["lam"] for r in mixing.balance(histogram, goal).collect()}
    assert set(got) == set(want) and len(want) >= 2
    assert all(math.isclose(got[s], want[s], rel_tol=1e-6, abs_tol=1e-8) for s in want)
    again = {r["source"]: r["lam"] for r in mixing.balance(histogram.repartition(13, "size"), goal).collect()}
    assert again == got  # to the last bit, whatever the partitioning


def test_targets_of_very_large_sources(spark):
    sizes = [3 * 10**17 + k for k in range(30)]
    per = spark.createDataFrame([(f"s{k:02d}", 1, s) for k, s in enumerate(sizes)], "source string, docs long, source_size long")
    got = [r["target"] for r in mixing.targets(per).orderBy("source").collect()]
    assert np.allclose(got, brute_targets(sizes))


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    data = [(k, None if s == "zz" else s, int(rng.lognormal(4, 1.2)) if k % 17 else 0) for k, s in enumerate(rng.choice(["a", "b", "c", "zz"], 1200, p=[0.7, 0.1, 0.15, 0.05]).tolist())]
    sizes = spark.createDataFrame(data, "doc_id long, source string, size long")
    got = mixing.mix(sizes).collect()
    assert len(got) == len(data)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(0.01 * own[0]["target"], 5)
        assert max(r["copies"] for r in own) <= 3
    assert rows(mixing.mix(sizes.repartition(7))) == sorted(map(tuple, got), key=str)


def test_mix_edges(odd_docs, no_docs, spark):
    assert mixing.mix(mixing.sized(no_docs)).count() == 0
    got = mixing.mix(mixing.sized(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0
    same = spark.createDataFrame([(1, "a", 10)] * 500 + [(2, "b", 10)] * 10, "doc_id long, source string, size long")
    assert sum(r["size"] * r["copies"] for r in mixing.mix(same).collect()) == pytest.approx(5100, rel=0.02)


# -- sharding


def test_table_is_filled_in_turns():
    names, slots = [f"s{k}" for k in range(7)], 101
    table = sharding.fill(names, slots)
    counts = np.bincount(table, minlength=7)
    assert counts.max() - counts.min() <= 1
    # by the definition: each shard's whole permutation, turn after turn
    orders = [[(sharding._hash(f"offset:{n}") + j * (sharding._hash(f"skip:{n}") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    own, turn = {}, 0
    while len(own) < slots:
        k = turn % 7
        own[next(s for s in orders[k] if s not in own)] = k
        turn += 1
    assert [own[s] for s in range(slots)] == table


def test_few_slots_move():
    names = [f"s{k}" for k in range(20)]
    a, b = sharding.fill(names, 10007), sharding.fill(names[:-1], 10007)
    assert sum(x != y for x, y in zip(a, b) if x != 19) / 10007 < 0.05


@pytest.mark.parametrize("shards,slots", [([], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_place(odd_docs, no_docs):
    placed = sharding.place(odd_docs)
    assert placed.count() == odd_docs.count() and set(placed.columns) == set(odd_docs.columns) | {"shard"}
    assert sharding.place(no_docs).count() == 0
    assert placed.where("slot is null or shard is null").count() == 0


def test_place_is_native(odd_docs):
    plan = sharding.place(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


# -- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 24)).astype(np.float32)
    v[10] = v[11]
    data = [(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(600, None), (601, [0.0] * 24), (602, [float("nan")] * 24), (603, [None] + [1.0] * 23)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    vectors = ann.usable(df)
    assert vectors.count() == 600
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0 or vec_id = 10"), 10).collect()
    x = v.astype(np.float64)
    hits = 0
    for q in {r["query_id"] for r in got}:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and q not in [r["vec_id"] for r in own]
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(math.isclose(r["score"], d[r["vec_id"]], rel_tol=1e-12) for r in own)
        d[q] = np.inf
        hits += len({r["vec_id"] for r in own} & set(np.argsort(d)[:10].tolist()))
    assert hits / len({r["query_id"] for r in got}) / 10 >= 0.9
    assert next(r["vec_id"] for r in got if r["query_id"] == 10 and r["rank"] == 1) == 11


def test_index_retrieves_the_whole_radius():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    code[:40] = code[5] ^ (1 << rng.integers(0, 8, (40, 8))).astype(np.uint8) * (rng.random((40, 8)) < 0.5)
    index = ann.Indexes(code)
    for radius in (0, 3, 7, 8, 15, 16, 20, 30, 64):
        want = np.flatnonzero(np.bitwise_count(code ^ code[5]).sum(axis=1) <= radius)
        assert index.within(code[5], radius).tolist() == want.tolist()
    assert len(index.probed(code[5], 7)) < 200  # selective where the radius is small


@pytest.mark.parametrize("spread,probed,reranked", [(0.15, 0.15, 0.01), (None, 1.0, 0.15)])
def test_how_much_is_probed(spread, probed, reranked):
    """Clustered vectors have a small radius, which the indexes select by; without clusters only the whole codes do."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((10_000, 64))
    if spread:
        x = np.repeat(x[:200], 50, axis=0) + x * spread
    mean, rotation = ann.learn(x[::2])
    radius = ann.learn_radius(x[::2], mean, rotation, 10, len(x))
    code = ann.codes(x, mean, rotation)
    index, hits, near, seen = ann.Indexes(code), 0, 0, 0
    for q in range(0, len(x), 200):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        rows = index.within(code[q], radius)
        seen, near = seen + len(index.probed(code[q], radius)), near + len(rows)
        hits += len(set(rows.tolist()) & set(np.argpartition(d, 10)[:10].tolist()))
    assert hits / 500 >= 0.95 and near / 50 / len(x) <= reranked and seen / 50 / len(x) <= probed


def test_neighbours_in_several_blocks(spark, monkeypatch):
    """Clustered vectors, so that the radius selects; queries without enough finds are asked again."""
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((30, 16)) * 5, 20, axis=0) + rng.standard_normal((600, 16)) * 0.3
    x[-1] += 100  # alone
    data = [(k, [float(c) for c in row]) for k, row in enumerate(x)] + [(900, [1.0, 2.0])]  # of another length
    vectors = ann.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0 or vec_id in (599, 900)"), 5).collect()
    assert len(got) == 31 * 5
    hits = 0
    for q in {r["query_id"] for r in got}:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        hits += len({v for _, v in own} & set(np.argsort(d, kind="stable")[:5].tolist()))
    assert hits >= 0.95 * 31 * 5


def test_neighbours_edges(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "vec_id long, embedding array<float>")
    v = ann.usable(df)
    assert ann.nearest(v, v.where("vec_id = 0"), 10).count() == 3
    assert ann.nearest(v, v.where("false"), 10).count() == 0
    assert ann.nearest(v.where("false"), v, 10).count() == 0
    assert ann.usable(df.unionAll(df)).count() == 4


# -- classifier


def test_qda_against_numpy():
    rng = np.random.default_rng(4)
    x = {0: rng.standard_normal((200, 3)) @ np.diag([1, 2, 3]), 1: rng.standard_normal((300, 3)) + 2}
    found = {k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}
    model = qda.fit(found, pool=0.0, ridge=0.0)
    for k, v in x.items():
        mean, inverse, constant = model[k]
        cov = np.cov(v.T, bias=True)
        p = np.array([0.3, -0.2, 1.0])
        want = np.log(len(v) / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (p - v.mean(axis=0)) @ np.linalg.solve(cov, p - v.mean(axis=0))
        z = inverse @ (p - mean)
        scale = np.sqrt(sum(n / 500 * np.diag(np.cov(x[j].T, bias=True)) for j, (n, *_) in found.items()))
        assert constant - 0.5 * z @ z == pytest.approx(want + np.log(scale).sum())


def brute_statistics(text):
    """The twelve statistics by the book."""
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    chars, many = max(len(t), 1), max(len(w), 1)

    def count(letters):
        return sum(t.count(c) for c in letters)

    sizes = [len(t), len(w), t.count("\n") + 1]
    ratios = [
        (len(t) - count(" \t\n\x0b\x0c\r")) / many / 10, count("#*$%&<>") / chars, t.count("|") / many, t.count("!") / many, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        count("0123456789") / chars, count(".,;:?") / many, len(set(w)) / many, sum(a == b for a, b in zip(w, w[1:])) / many,
    ]
    return [math.log1p(x) for x in sizes] + [math.log(x + 1e-3) for x in ratios]


def test_scores_against_numpy(spark):
    """Statistics, shrinkage and density differences anew, with determinants and solved systems instead of factors."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality", F.lit("clash").alias("text"), F.lit(1).alias("score"))
    x = {r["doc_id"]: np.array(brute_statistics(r["text"])) for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in x}
    by = {k: np.array([x[d] for d, q in known.items() if q == k]) for k in (0, 1)}
    total = sum(map(len, by.values()))
    cov = {k: np.cov(v.T, bias=True) for k, v in by.items()}
    pooled = sum(len(v) / total * cov[k] for k, v in by.items())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    every = np.array(list(x.values()))
    density = {}
    for k, v in by.items():
        unit = ((1 - qda.POOL) * cov[k] + qda.POOL * pooled) / np.outer(scale, scale)
        unit = (1 - qda.RIDGE) * unit + qda.RIDGE * max(np.trace(unit) / 12, 1e-3) * np.eye(12)
        z = (every - v.mean(axis=0)) / scale
        density[k] = math.log(len(v) / total) - 0.5 * np.linalg.slogdet(unit)[1] - 0.5 * (z * np.linalg.solve(unit, z.T).T).sum(axis=1)
    want = dict(zip(x, 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))))
    got = qda.classify(docs, labels).collect()
    assert len(got) == len(x)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)


def test_classifier_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = qda.classify(docs.select("doc_id", "text"), labels)
    assert got.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())
    judged = got.where("held_out").join(labels, "doc_id")
    assert judged.where("predicted = quality").count() / judged.count() > 0.95


def test_classifier_edges(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = qda.classify(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert qda.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in qda.classify(odd_docs, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in qda.classify(odd_docs, labels.where("quality = 1")).collect()} == {1.0}


# -- components


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {k: find(k) for k in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
