"""Personal data by weak supervision.

Fixed patterns give base spans, which always stay. Wider patterns give candidates; on each, labelers vote
(format and checksum rules, gazetteers, context words). Candidates with the same votes and shape share a
code, and codes are counted over the whole corpus: that table is bounded by the number of codes, so the
driver can run expectation-maximisation on it, which estimates each labeler's reliability and each code's
probability, and then train a logistic span classifier on the probabilistic labels. The classifier also sees what
no labeler votes on: the kinds of the characters around the span, and the word before it, hashed. A second pass adds
the candidates the classifier accepts.

Every pattern takes time in proportion to the text. The base patterns are the fixed ones in another form: an address
is looked for around its ``@``, and a number begins where its run of digits does, as no later place of the run could match.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table

# Kinds in the order of results, patterns, gazetteers and cue words.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
WIDER = (
    r"\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z0-9-]{2,63})+",
    r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    r"(?<![0-9])(?:\+|00)?[0-9]{0,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])|\+[0-9][\x20().0-9-]{6,18}[0-9](?![0-9])",
    r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\x20]?[=:][\x20]?[\"']?[A-Za-z0-9+/_=-]{16,}[\"']?",
)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev de fr es it uk us ca nl pl se no fi dk ch at be pt br ru cn jp in au".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CUES = (
    ("mail", "contact", "write to", "reach me"),
    ("ip", "host", "server", "address", "login from"),
    ("card", "visa", "mastercard", "amex", "account", "payment"),
    ("tel", "phone", "call", "fax", "mobile", "cell"),
    ("token", "secret", "password", "key", "credential"),
)
COUNTER_CUES = ("isbn", "version", "order", "invoice", "serial", "doi", "figure", "section", "example.org")
TAGS = tuple(f"[{k.upper()}]" for k in KINDS)

VOTES = 5
REACH = 32
#: A candidate's code holds, beside its kind and votes: length class, character kinds before and after, hashed word before.
LENGTHS, SIDES, WORDS = 4, 4, 8
CODES = len(KINDS) * 3**VOTES * LENGTHS * SIDES * SIDES * WORDS


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _holds(kind: int, found: str) -> bool:
    """Whether a base match passes its check."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == 2:
        digits = _digits(found)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 8 <= len(_digits(found)) <= 15
    return True


_DIGIT = re.compile("[0-9]")
_base = [re.compile(p) for p in BASE]
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_wider = [re.compile(p, re.IGNORECASE if k in (0, 4) else 0) for k, p in enumerate(WIDER)]
_SECRET = re.compile("token|secret|passw|key", re.IGNORECASE)
_AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern: the run of local characters before an ``@``, and the domain behind it."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        domain = _domain.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def _wide_emails(text: str) -> Iterator[tuple[int, int]]:
    """Around every sign that can stand for an ``@``: 2 to 64 local characters, a white space or none, and a spelt domain."""
    low = 0
    for m in _AT.finditer(text):
        if m.start() < low:
            continue
        end = m.start() - (m.start() > low and text[m.start() - 1].isspace())
        first = max(low, end - 64)
        start = first + len(text[first:end].rstrip(LOCAL))
        domain = _wider[0].match(text, m.end()) if end - start >= 2 else None
        if domain:
            yield start, domain.end()
            low = domain.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and then start: what the base patterns match and their checks keep."""
    digit = _DIGIT.search(text) is not None
    found = [(0, *span) for span in _emails(text)]
    for kind, pattern in ((1, _ip), (2, _base[2]), (3, _base[3])):
        if digit and (kind != 3 or "+" in text):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _holds(kind, m.group())]
    return found


def _votes(kind: int, found: str, before: str) -> tuple[int, ...]:
    """Format, checksum, gazetteer, cue and counter-cue: 1 for personal data, -1 against, 0 for no opinion."""
    digits = _digits(found)
    shape = check = gazetteer = 0
    if kind == 0:
        shape = 1 if _base[0].fullmatch(found) else -1 if found.count("@") > 1 else 0
        gazetteer = 1 if re.split(r"[^A-Za-z]+", found.rstrip(")]"))[-1].lower() in DOMAINS else -1
    elif kind == 1:
        shape = 1 if ":" in found or found.count(".") == 3 else 0
        check = 1 if ":" in found or _holds(1, found) else -1
        gazetteer = -1 if found.startswith(("0.", "127.", "255.")) else 0
    elif kind == 2:
        shape = 1 if 16 <= len(digits) <= 19 else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == 3:
        shape = 1 if 8 <= len(digits) <= 15 else -1
        check = 1 if found.startswith(("+", "00")) else 0
        lead = digits.removeprefix("00")
        gazetteer = 1 if found.startswith(("+", "00")) and (lead[:1] in CALLING or lead[:2] in CALLING) else 0
    else:
        value = re.split(r"[=:]", found, maxsplit=1)[-1].strip(" \"'")
        shape = 1 if len(value) >= 20 else 0
        check = 1 if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else -1
        gazetteer = -1 if len(set(value)) < 6 else 1
    cue = 1 if kind == 4 or any(c in before for c in CUES[kind]) else 0
    counter = -1 if any(c in before for c in COUNTER_CUES) else 0
    return shape, check, gazetteer, cue, counter


def _side(c: str) -> int:
    """The kind of a character beside a span: none or white space, letter, digit, other."""
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def _code(kind: int, votes: tuple[int, ...], size: int, before: str, after: str) -> int:
    """Kind, votes, length class and surroundings as one number below ``CODES``."""
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    words = before.split()
    word = zlib.crc32(words[-1].strip(":=(,.").encode("utf-8", "surrogatepass")) % (WORDS - 1) + 1 if words else 0
    for value, many in ((min(size // 12, LENGTHS - 1), LENGTHS), (_side(before[-1:]), SIDES), (_side(after), SIDES), (word, WORDS)):
        code = code * many + value
    return code


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of the wider patterns' matches."""
    digit, found = _DIGIT.search(text) is not None, []
    asked = (False, digit, digit, digit, _SECRET.search(text))
    spans = [(0, *span) for span in _wide_emails(text)]
    for kind, pattern in enumerate(_wider):
        if asked[kind]:
            spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    for kind, start, end in spans:
        before = text[max(0, start - REACH) : start].lower()
        found.append((kind, start, end, _code(kind, _votes(kind, text[start:end], before), end - start, before, text[end : end + 1])))
    return found


def _unpack(code: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes, and the rest: length class, the sides, the word."""
    rest, votes = [], []
    for many in (WORDS, SIDES, SIDES, LENGTHS):
        code, value = divmod(code, many)
        rest.append(value)
    for _ in range(VOTES):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], rest[::-1]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for one kind: (probability of each row of votes, P(vote | class) by labeler, class and vote, prior).

    The pseudo-counts say that a labeler is right more often than wrong, which tells the two classes apart.
    """
    prior_counts = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
    p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    chosen = np.stack([votes == v for v in (-1, 0, 1)], axis=-1).astype(float)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        theta = np.einsum("yp,plv->lyv", weight, chosen) + prior_counts
        theta /= theta.sum(axis=-1, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        score = np.einsum("plv,lyv->py", chosen, np.log(theta)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
        if np.abs(new - p).max() < 1e-10:
            break
        p = new
    return p, theta, float(prior)


def _features(codes: list[int]) -> np.ndarray:
    """Indicators of a code's kind, its votes by kind, and the rest of it."""
    many = (LENGTHS, SIDES, SIDES, WORDS)
    starts = np.cumsum([1 + len(KINDS), *many])
    x = np.zeros((len(codes), int(starts[-1]) + len(KINDS) * VOTES * 2), dtype=np.float32)
    x[:, 0] = 1
    for row, code in zip(x, codes):
        kind, votes, rest = _unpack(code)
        row[1 + kind] = 1
        row[[int(s) + v for s, v in zip(starts, rest)]] = 1
        for k, v in enumerate(votes):
            if v:
                row[int(starts[-1]) + (kind * VOTES + k) * 2 + (v > 0)] = 1
    return x


def train(counted: dict[int, int]) -> set[int]:
    """Counts by code -> the codes that the span classifier accepts."""
    if not counted:
        return set()
    codes = np.array(sorted(counted))
    counts = np.array([counted[int(c)] for c in codes], dtype=float)
    parts = [_unpack(int(c)) for c in codes]
    soft = np.zeros(len(codes))
    for kind in range(len(KINDS)):
        own = np.array([p[0] == kind for p in parts])
        if own.any():
            votes = np.array([p[1] for p, o in zip(parts, own) if o])
            soft[own] = reliabilities(votes, counts[own])[0]
    x = _features(codes.tolist())
    w, scale = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(50):  # Newton steps of a ridge-penalised logistic regression on soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (scale * (p - soft)) + 1e-4 * w
        hessian = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return {int(c) for c, z in zip(codes, x @ w) if z >= 0}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for *_, code in candidates(text or ""):
                counts[code] = counts.get(code, 0) + 1
    yield pa.record_batch([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], names=["code", "n"])


def learn(docs: DataFrame, text_col: str = "text") -> set[int]:
    """Count the codes over all documents, in each task first; at most ``CODES`` rows reach the driver, whatever the corpus."""
    small_batches(docs.sparkSession, 8 << 20)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return train({r["code"]: r["n"] for r in counted.collect()})


def all_spans(text: str, accepted: set[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): accepted candidates are added where they meet no span yet."""
    base, more = base_spans(text), [c for c in candidates(text) if c[3] in accepted]
    spans = list(base)
    if more:
        taken = bytearray(len(text))
        for _, start, end in base:
            taken[start:end] = b"\1" * (end - start)
        for kind, start, end, _ in more:
            if 1 not in taken[start:end]:
                spans.append((kind, start, end))
                taken[start:end] = b"\1" * (end - start)
    return base, sorted(spans)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a tag in place of each stretch of spans."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], TAGS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _finder(accepted: set[int]) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", accepted)
                counts = [sum(k == kind for k, *_ in base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], names=NAMES)

    return find


NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def find_all(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of base spans by kind, digest of the base spans, all spans) of every row.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows repeat; texts are read whole,
    whatever their length; other columns are ignored; an empty table gives an empty result.
    """
    accepted = learn(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_finder(accepted), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind's tag; the columns stay as they are.

    Null texts stay null, empty ones empty; repeated rows get the same text each; long texts are read whole; an empty
    table gives an empty result; ``n_chars``, if there, becomes the new length.
    """
    accepted = learn(docs)
    place, names, schema = docs.columns.index("text"), docs.columns, docs.schema
    chars = names.index("n_chars") if "n_chars" in names else None

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, all_spans(t, accepted)[1]) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], batch.column(chars).type)
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(change, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans. Null and empty texts have none; equal starts go by kind; null doc_ids stay null and repeated
    rows repeat; an empty table gives no rows."""
    return find_all(table(spark, sf_dir, "documents"))
