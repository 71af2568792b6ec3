import base64
import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tessera.llm import bpe, pii, records, rules, simhash
from tests.llm.conftest import TEXTS


def brute_rules(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return con.execute(rules.ORACLE).fetchall()


def test_rules_agree_with_sql(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = rules.judge(docs).select("doc_id", *[f"quality.{c}" for c in rules.COUNTS]).collect()
    assert sorted(map(tuple, got)) == sorted(brute_rules(docs))


def test_rules_of_punctuation(spark):
    """Signs inside a long line don't excuse its end; closing quotes and blanks behind a mark do no harm."""
    words = " ".join(f"w{k}" for k in range(60))
    endings = {"": False, ".": True, '."': True, "!) \t\r": True, " # | $ *": False, ", and": False, "。": True, "…": True, ".x": False}
    docs = spark.createDataFrame([(k, f"a. b, c; {words}{e}") for k, e in enumerate(endings)], "doc_id long, text string")
    assert [r["kept"] for r in rules.judge(docs).select("doc_id", "quality.kept").orderBy("doc_id").collect()] == list(endings.values())


def test_rules_compare_words_behind_hashes(spark, monkeypatch):
    """With a hash that is the same for many windows, the counts must not change."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(list("abcd"), 60))) for k in range(20)], "doc_id long, text string")
    want = [r[0] for r in rules.judge(docs).orderBy("doc_id").select("quality.n_repeat_words").collect()]
    expr = rules.F.expr
    monkeypatch.setattr(rules.F, "expr", lambda text: expr(text.replace("xxhash64(_w[i], _w[i + 1], _w[i + 2])", "xxhash64(_w[i])")))
    assert [r[0] for r in rules.judge(docs).orderBy("doc_id").select("quality.n_repeat_words").collect()] == want


def test_rules_edges(odd_docs, no_docs):
    assert rules.judge(no_docs).count() == 0
    assert rules.judge(odd_docs).count() == len(TEXTS) + 1
    cleaned = rules.clean(odd_docs)
    assert cleaned.columns == odd_docs.columns


def test_rules_lines(spark):
    good, more = (" ".join(f"{w}{k}" for k in range(60)) + "." for w in ("word", "term"))
    bad = "Home | News | Sport | Weather | About\nAll rights reserved.\nWOW!! BUY!! NOW!!"
    docs = spark.createDataFrame([(1, f"{good}\n{bad}\n{more}"), (2, "\n".join([bad] * 9))], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in rules.clean(docs).collect()}
    assert set(kept) == {1} and "Sport" not in kept[1] and "rights" not in kept[1] and "WOW" not in kept[1] and kept[1] == f"{good}\n{more}"


@pytest.fixture(scope="session")
def reference_bpe():
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_library(odd_docs, reference_bpe):
    got = bpe.round_trip(odd_docs).collect()
    want = []
    for r in odd_docs.collect():
        ids = reference_bpe.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def ids_of(own, texts):
    return [np.frombuffer(x, dtype="<u2").tolist() for x in own.encode(texts).rows()]


def test_bpe_long_words_agree(reference_bpe):
    own = bpe.Codec(bpe.vocabulary())
    rng = np.random.default_rng(1)
    for letters in ("aehinorst", "ACGT", "x", "xy", "0123456789", "абвг", "-=_*"):
        texts = ["".join(rng.choice(list(letters), n)) for n in (1, 2, 7, bpe.OFTEN, bpe.OFTEN + 1, 257, 900, 5000)]
        assert ids_of(own, texts) == [reference_bpe.encode_ordinary(t) for t in texts]


def test_bpe_words_of_a_megabyte(reference_bpe):
    own = bpe.Codec(bpe.vocabulary())
    text = "x" * (1 << 20) + " " + "".join(np.random.default_rng(2).choice(list("ACGT"), 1 << 20))
    words = own.encode([text])
    assert np.frombuffer(words.rows()[0], dtype="<u2").tolist() == reference_bpe.encode_ordinary(text)
    assert own.decode(words).rows() == [text.encode()]


def test_bpe_one_place_a_step(reference_bpe):
    """What a vocabulary takes whose tokens may have pairs of lower rank."""
    kind = bpe.vocabulary()
    assert kind.grows
    kind.grows = False
    texts = ["".join(np.random.default_rng(k).choice(list("aehinorst"), 300)) for k in range(20)]
    assert ids_of(bpe.Codec(kind), texts) == [reference_bpe.encode_ordinary(t) for t in texts]


def test_bpe_small_cache(reference_bpe):
    own = bpe.Codec(bpe.vocabulary(), cache=2)
    for text in ["a b c d e f", "f e d  c\n\nb a", " lead", "trail ", "é è́", "", " ", "  ", "\x00a \x00a"]:
        words = own.encode([text, "a", text])
        assert [np.frombuffer(x, dtype="<u2").tolist() for x in words.rows()] == [reference_bpe.encode_ordinary(t) for t in (text, "a", text)]
        assert own.decode(words).rows() == [text.encode(), b"a", text.encode()]


def test_bpe_frames(odd_docs, no_docs):
    assert bpe.round_trip(no_docs).count() == 0
    back = bpe.decode(bpe.encode(odd_docs))
    assert sorted(bytes(r["content"]).decode() for r in back.collect()) == sorted(r["text"] or "" for r in odd_docs.collect())


def test_records_round_trip(odd_docs, no_docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(records.read(records.write(odd_docs)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd_docs.collect()), key=lambda d: (d is not None, d))
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    at = 0
    for r in got:
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert records.read(records.write(no_docs)).count() == 0


def test_records_small_blocks(odd_docs):
    files = records.write(odd_docs)
    assert sorted(records.read(files, block=1000).collect(), key=str) == sorted(records.read(files).collect(), key=str)


def test_records_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(k, None if k < 900 else 5, f"text {k}") for k in range(1000)], "k int, doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = records.write(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.where("docs > 500").count() == 0
    got = records.read(files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 900 + [5] * 100
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]


def test_records_read_in_any_order(odd_docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    files = records.write(odd_docs)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    one, other = (records.shuffled(files, seed).collect() for seed in (1, 2))
    assert sorted(one) == sorted(other) and one != other
    assert [r["start"] for r in one] != sorted(r["start"] for r in one)
    for r in one:
        assert r["token_ids"] == tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1] and len(r["token_ids"]) == r["n_tokens"]
    some = records.index(files).where("start > 0 and n_tokens < 100")
    assert records.fetch(some).count() == some.count() > 0
    assert records.shuffled(files.where("false")).count() == 0


def test_record_checksums():
    data = records.frame(b"abc") + records.frame(b"")
    one, at = records.unframe(data, 0)
    assert one == b"abc" and records.unframe(data, at) == (b"", len(data))
    for k in range(len(data) - 1):
        broken = data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]
        with pytest.raises(Exception):
            _, at = records.unframe(broken, 0)
            records.unframe(broken, at)


def brute_fingerprint(text):
    """By the contract, bit by bit."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k : k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=3):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[k][0], f"{prints[k]:016x}", least[find(k)]) for k in range(len(rows))), key=str)


def test_simhash_edges(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(odd_docs).collect()), key=str) == brute_components(rows)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (1, 2)").count() == 0


@pytest.mark.parametrize("crowd,block", [(1, 1024), (1, 3), (128, 1024)])
def test_simhash_groups(spark, crowd, block):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(500)]
    rows, base = [], [list(rng.choice(words, 120)) for _ in range(4)]
    for k in range(160):
        text = list(base[k % 4])
        for _ in range(k // 40):
            text[rng.integers(len(text))] = "changed"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(docs, crowd=crowd, block=block).collect()), key=str) == brute_components(rows)


def brute_base(text):
    """The fixed patterns as they stand."""
    checks = (
        lambda m: True,
        lambda m: all(int(x) <= 255 for x in m.split(".")),
        lambda m: 16 <= len(d := [int(c) for c in m if c.isdigit()]) <= 19 and sum(d[-1::-2] + [sum(divmod(2 * x, 10)) for x in d[-2::-2]]) % 10 == 0,
        lambda m: 8 <= sum(c.isdigit() for c in m) <= 15,
    )
    return [(k, m.start(), m.end()) for k, p in enumerate(pii.BASE) for m in re.finditer(p, text) if checks[k](m.group())]


def test_pii_base():
    text = "a.b@x.org, 1.2.3.4, 1.2.3.400, 4111 1111 1111 1111, 4111 1111 1111 1112, +1 (487) 555-7209 or +1 2"
    found = {(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)}
    assert {("email", "a.b@x.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (487) 555-7209")} <= found
    assert not any(kind == "ip" and t.endswith("400") or kind == "card" and t.endswith("1112") for kind, t in found)


@pytest.mark.parametrize("letters", ["a@.", "a@.-é ", "12.", "0123456789.x", "41 -", "+1() .-", "a@.b1+2 -", "0123456789 -+()"])
def test_pii_base_against_plain_patterns(letters):
    rng = np.random.default_rng(7)
    for n in (3, 8, 20, 60, 200):
        for _ in range(150):
            text = "".join(rng.choice(list(letters), n))
            assert pii.base_spans(text) == brute_base(text)


def test_pii_base_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.find_all(docs).collect():
        base = brute_base(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for k, *_ in base) for kind in range(4)]
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_pii_takes_time_in_proportion():
    million = 1 << 20
    began = time.perf_counter()
    for text in ("7" * million, "a" * million, "a" * million + "@x", "a@" * (million // 2), "1." * (million // 2), "1 " * (million // 2), "+1" * (million // 2), "+1" + " " * million, "a@b.cd " * (million // 7), "token=" * (million // 6), "a(at)" * (million // 5)):
        pii.all_spans(text, set(range(0, pii.CODES, 3)))
    assert time.perf_counter() - began < 60


def test_pii_codes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        kind, votes = int(rng.integers(len(pii.KINDS))), tuple(int(v) for v in rng.integers(-1, 2, pii.VOTES))
        code = pii._code(kind, votes, 30, "call me ", "x")
        assert 0 <= code < pii.CODES and pii._unpack(code)[:2] == (kind, list(votes)) and pii._unpack(code)[2][:3] == [2, 0, 1]
    assert pii._code(len(pii.KINDS) - 1, (1,) * pii.VOTES, 10**6, "x;", ";") < pii.CODES


def test_pii_frames(odd_docs, no_docs):
    got = pii.find_all(odd_docs)
    assert got.columns == pii.NAMES and got.count() == len(TEXTS) + 1
    assert pii.find_all(no_docs).count() == 0
    changed = pii.redacted(odd_docs)
    assert changed.columns == odd_docs.columns
    by = {r["doc_id"]: r["text"] for r in changed.collect()}
    assert "555-7209" not in by[7] and "[PHONE]" in by[7] and by[0] is None and by[5] == TEXTS[5]


def test_pii_learns_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((4000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    rows, n = np.unique(votes, axis=0, return_counts=True)
    p, theta, prior = pii.reliabilities(rows, n.astype(float))
    assert abs(prior - 0.4) < 0.05
    assert np.allclose(theta[:, 1, 2], right, atol=0.06)
