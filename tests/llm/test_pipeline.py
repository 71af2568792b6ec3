"""Every stage of the pipeline against a brute-force version on what the stage before it kept."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, mixing, pii
from tests.llm.test_stages import brute_groups
from tests.llm.test_text import brute_base

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = re.compile(r"""[.!?:;…。]["')\]»”’]*[ \t\r]*\Z""")


def bad(line):
    words = WORD.findall(line)
    n, bars, symbols, shouts = len(words), line.count("|"), sum(line.count(c) for c in "#*$%&<>"), line.count("!!")
    boiler = any(x in line.lower() for x in ("all rights reserved", "privacy policy", "tous droits réservés"))
    return 2 <= bars and n <= 4 * bars or 3 <= symbols and n <= 2 * symbols or 2 <= shouts and n <= 2 * shouts or 8 <= n >= 4 * len(set(words)) or n >= 10 and not END.search(line) or boiler


def brute_clean(text):
    """The text that is kept, or None."""
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    twice = {k + o for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for o in range(3)}
    lines = (text or "").split("\n")
    lost = sum(len(WORD.findall(x)) for x in lines if WORD.search(x) and bad(x))
    if len(words) < 50 or 100 * len(twice) > 50 * len(words) or 100 * lost > 50 * len(words):
        return None
    return "\n".join(x for x in lines if not (WORD.search(x) and bad(x)))


def prose(seed, n=70):
    return " ".join(f"w{seed}x{k}" + ("." if k % 9 == 8 else "") for k in range(n)) + "."


ROWS = [
    (1, prose(1)), (2, prose(1)), (3, prose(1).replace("w1x5 ", "other ")), (4, prose(1).upper()),
    (5, prose(5) + "\nHome | News | Sport | About\nAll rights reserved.\n" + prose(6)), (6, prose(7) + "\nno end of this line of more than ten words in it"),
    (7, "too short."), (8, "again and again. " * 40), (9, None), (10, ""), (11, prose(11) + "\nWOW!! BUY!! NOW!!"),
    (12, prose(12) + "\nmail a.b@example.org or +1 (487) 555-7209, host 10.1.2.3, card 4111 1111 1111 1111."),
    (None, prose(13)), (None, prose(13)), (None, prose(14)), (15, prose(15)), (15, prose(16)), (15, prose(16)),
    *[(20 + k, prose(20 + k, 60 + 7 * k)) for k in range(20)],
]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned, written and reread."""
    folder = f"file://{tmp_path_factory.mktemp('pipeline')}"
    docs = [(d, t, "en", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (d, t) in enumerate(ROWS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    held, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, folder).write.parquet(f"{folder}/{k}")
        found.append((held, spark.read.parquet(f"{folder}/{k}")))
        held = found[-1][1]
    return folder, found


def rows(df, *columns):
    return sorted(((r if not columns else tuple(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_rules_stage(stages):
    before, after = stages[1][0]
    want = [(r["doc_id"], t, r["source"], len(t)) for r in before.collect() if (t := brute_clean(r["text"])) is not None]
    assert rows(after, "doc_id", "text", "source", "n_chars") == sorted(want, key=repr)
    assert after.columns == before.columns and 0 < len(want) < before.count()


def test_near_duplicates_stage(stages):
    before, after = stages[1][1]
    held = before.collect()
    groups = {}
    for r, g in zip(held, brute_groups([r["text"] for r in held])):
        groups.setdefault(g, []).append(r)
    kept = after.collect()
    assert len(kept) == len(groups) < len(held) and after.columns == before.columns
    assert set(kept) <= set(held)
    least = sorted((min((r["doc_id"] is None, r["doc_id"] or 0) for r in g) for g in groups.values()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == least


def test_personal_data_stage(stages):
    before, after = stages[1][2]
    accepted, want = pii.learn(before), []
    for r in before.collect():
        base, spans = pii.all_spans(r["text"], accepted)
        assert base == brute_base(r["text"]) and set(base) <= set(spans)
        text, at = "", 0
        for start, end, kind in sorted((s, e, k) for k, s, e in spans):
            if start >= at:
                text += r["text"][at:start] + pii.TAGS[kind]
            at = max(at, end)
        want.append((r["doc_id"], text + r["text"][at:], r["source"]))
    assert rows(after, "doc_id", "text", "source") == sorted(want, key=repr) and after.columns == before.columns
    assert not any("555-7209" in r["text"] or "a.b@" in r["text"] for r in after.collect())


def test_mixing_stage(stages):
    before, after = stages[1][3]
    held, out = before.collect(), Counter(after.collect())
    assert set(out) <= set(held) and max(out.values()) <= mixing.CAP * max(Counter(held).values())
    size = {s: 0 for s in {r["source"] for r in held}}
    largest = dict(size)
    for r in held:
        n = len(WORD.findall(r["text"]))
        size[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    # targets round after round, sources by code point, null last
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while True:
        rest, sharing = sum(size.values()) - sum(full.values()), sum(w for s, w in weight.items() if s not in full)
        target = {s: full.get(s, rest * weight[s] / sharing) for s in order}
        over = {s: 3 * size[s] for s in order if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        taken = sum(n * len(WORD.findall(r["text"])) for r, n in out.items() if r["source"] == s)
        assert abs(taken - target[s]) <= largest[s]


def test_tokens_stage(stages):
    before, after = stages[1][4]
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before.collect():
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert rows(after, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_run_is_its_stages(spark, stages):
    folder, found = stages
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows(out) == rows(found[-1][1]) and len(corpus_pipeline.STAGES) == 5


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
