"""Personal data by weak supervision.

1. Base spans: one pattern for each of email, ip, card and phone, leftmost and non-overlapping; matches that fail their check
   (parts of an ip, digits and Luhn sum of a card, digits of a phone) are dropped without another try.
2. Candidates: the base spans, and looser forms that the patterns miss (emails written with "at" and "dot", numbers with
   other separators or without a plus sign, numbers that fail a check).
3. Labelers vote yes, no or nothing on each candidate: the pattern with its check, gazetteers (endings of domains, prefixes of
   cards, private address ranges, country codes), context words on either side, and its form.
4. For each kind, expectation-maximisation over the counts of vote patterns of all documents estimates the labelers'
   reliabilities and each pattern's probability. There are at most 3^6 patterns and 512 feature sets a kind, whatever the
   input, so only their counts reach the driver.
5. A logistic classifier over form and context features is trained on those probabilities. A candidate that it accepts, and
   that overlaps no base span and no accepted one before it, is added; base spans always stay.

Candidates, a few bytes each, are written once, so texts are read by one pass only.

Looser forms are bounded: a number has 7 to 24 characters, the name of a written-out address 64 at most. Base spans have no bound.

Defined results: null and empty texts have no spans; repeated rows and null doc_ids give a row each; an empty table gives none. Columns
besides doc_id and text are ignored."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, read_table

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9

# What may stand in an address, the four patterns, and word lists.
EMAIL_LEFT = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9]+(?:\.[0-9]+)*")  # whole runs of dotted numbers; four numbers at a time are a match
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_AT = re.compile(rb"\[at\]|\(at\)|\{at\}| at ", re.I)
LOOSE_DOMAIN = re.compile(rb"\s{0,3}[A-Za-z0-9-]{1,63}(?:\s{0,3}(?:\[dot\]|\(dot\)|\{dot\}| dot |\.)\s{0,3}[A-Za-z0-9-]{1,63}){1,8}", re.I)
LOOSE_NUMBER = re.compile(rb"\(?[0-9][0-9().\x20/-]{5,22}[0-9]")
DOMAIN_ENDINGS = frozenset(b"com org net edu gov io de fr es uk it nl eu info co".split())
CARD_PREFIXES = (b"4", b"51", b"52", b"53", b"54", b"55", b"34", b"37", b"6011", b"65", b"35")
PRIVATE_RANGES = (b"10.", b"127.", b"192.168.", b"169.254.", b"0.")
COUNTRY_CODES = (b"1", b"33", b"34", b"39", b"41", b"43", b"44", b"49", b"61", b"81", b"86", b"91")
CONTEXT = {
    "email": frozenset(b"mail email e-mail correo courriel contact write address".split()),
    "ip": frozenset(b"ip host server address addr serveur servidor from".split()),
    "card": frozenset(b"card visa mastercard credit karte carte tarjeta payment number".split()),
    "phone": frozenset(b"phone tel call fax mobile telefon telephone telefono cell".split()),
}

N_VOTES = 6


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(x: bytes) -> bytes:
    return bytes(c for c in x if 48 <= c <= 57)


def check(kind: str, x: bytes) -> bool:
    """What a match of the kind's pattern must satisfy."""
    if kind == "ip":
        return all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in x.split(b"."))
    if kind == "card":
        d = _digits(x)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(x)) <= 15
    return True


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from their @: the pattern alone would try every word."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in EMAIL_LEFT:
            left -= 1
        m = EMAIL.match(text, left) if left < at else None
        if m:
            done = m.end()
            yield left, done
        at = text.find(b"@", max(done, at + 1))


def addresses(text: bytes) -> Iterator[tuple[int, int]]:
    """Matches of four numbers with dots between, leftmost first: linear in the text, however long its runs of digits are."""
    for m in IP.finditer(text):
        if m.group().count(b".") >= 3:
            parts, at = m.group().split(b"."), m.start()
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                yield at, at + size
                at += size + 1


def loose_emails(text: bytes) -> Iterator[tuple[int, int]]:
    """A name, "at" in words or brackets, and a domain whose dots may be in words or brackets."""
    done = 0
    for m in LOOSE_AT.finditer(text):
        domain = LOOSE_DOMAIN.match(text, m.end())
        right = left = m.start()
        while right > max(done, m.start() - 3) and text[right - 1] in b" \t\n":
            right -= 1
        left = right
        while left > max(done, right - 64) and text[left - 1] in EMAIL_LEFT:
            left -= 1
        if domain and left < right and (m.group() != b" at " or re.search(rb"dot|\.", domain.group(), re.I)):
            done = domain.end()
            yield left, done


_NUMERIC = re.compile(rb"[0-9]")


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, in bytes."""
    out = [(0, a, b) for a, b in emails(text)]
    if _NUMERIC.search(text):
        out += [(1, a, b) for a, b in addresses(text) if check("ip", text[a:b])]
        for k, pattern in ((2, CARD), (3, PHONE)):
            out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if check(KINDS[k], m.group())]
    return out


def candidates(text: bytes) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base): the base spans and what the looser patterns add."""
    out = [(k, a, b, True) for k, a, b in base_spans(text)]
    known = {(k, a, b) for k, a, b, _ in out}
    loose = [(0, a, b) for a, b in loose_emails(text)]
    if _NUMERIC.search(text):
        for m in LOOSE_NUMBER.finditer(text):
            d = len(_digits(m.group()))
            if 13 <= d <= 19:
                loose.append((2, m.start(), m.end()))
            if 7 <= d <= 15:
                loose.append((3, m.start(), m.end()))
            if m.group().count(b".") == 3 and d <= 12:
                loose.append((1, m.start(), m.end()))
    return out + [(*x, False) for x in loose if x not in known]


def votes(text: bytes, kind: int, a: int, b: int, base: bool) -> tuple[list[int], list[int]]:
    """(votes, features): votes are 1, -1 or 0 (abstains), one of each labeler; features are 0 or 1."""
    name, x = KINDS[kind], text[a:b]
    d = _digits(x)
    near = set(re.findall(rb"[a-z-]+", text[max(0, a - 48) : a].lower() + b" " + text[b : b + 24].lower()))
    own = bool(near & CONTEXT[name])
    other = any(near & words for k, words in CONTEXT.items() if k != name and not near & CONTEXT[name])
    bounded = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
    if name == "email":
        gazetteer = re.split(rb"[^A-Za-z0-9]+", x.rstrip(b")]} "))[-1].lower() in DOMAIN_ENDINGS
        form = b"@" in x
        odd = len(x) > 80
    elif name == "ip":
        gazetteer = not x.startswith(PRIVATE_RANGES)
        form = x.count(b".") == 3
        odd = any(len(p) > 3 or (len(p) > 1 and p.startswith(b"0")) for p in x.split(b"."))
    elif name == "card":
        gazetteer = d.startswith(CARD_PREFIXES)
        form = len(d) in (15, 16)
        odd = not luhn(d)
    else:
        gazetteer = d.startswith(COUNTRY_CODES)
        form = x.startswith(b"+") or b"(" in x
        odd = len(d) not in (10, 11, 12) or (len(d) == len(x))
    vote = [1 if base else 0, 1 if gazetteer else -1, 1 if own else 0, -1 if other else 0, 1 if form and bounded else -1, -1 if odd else 1]
    sides = re.split(rb"[0-9]+", x)
    uniform = len(set(sides[1:-1])) <= 1
    return vote, [int(base), int(gazetteer), int(own), int(other), int(form), int(bounded), int(odd), int(uniform), int(len(d) > 9)]


N_FEATURES = 9
SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "first", "last", "base", "vote", "feature")])


def _char_places(text: bytes, places: list[int]) -> dict[int, int]:
    """Byte places -> code point places."""
    if text.isascii():
        return {p: p for p in places}
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(text[at:p].decode("utf-8", "replace"))
        out[p], at = n, p
    return out


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): each document's candidates, with places in code points, votes (base 3) and features (bits)."""
    source = docs.select("doc_id", F.col("text").alias("__text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("found", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1).cast(pa.binary()):
                text, found = value.as_py() or b"", []
                spans = candidates(text)
                place = _char_places(text, [p for s in spans for p in s[1:3]])
                for k, a, b, base in spans:
                    v, f = votes(text, k, a, b, base)
                    found.append({"kind": k, "first": place[a], "last": place[b], "base": int(base), "vote": sum((x + 1) * 3**i for i, x in enumerate(v)), "feature": sum(x << i for i, x in enumerate(f))})
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "found"])

    return source.mapInArrow(run, schema)


def em(vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability of each vote pattern's being true (Dawid-Skene with two classes; abstaining says nothing).

    Starts from the majority and keeps a little prior weight on labelers that are right more often than not."""
    p = 1 / (1 + np.exp(-vote.sum(axis=1)))
    yes, no = (vote == 1).astype(float), (vote == -1).astype(float)
    for _ in range(rounds):
        w1, w0 = p * count, (1 - p) * count
        right1 = (w1 @ yes + 4) / (w1 @ (yes + no) + 5)  # votes yes on what is true
        wrong0 = (w0 @ yes + 1) / (w0 @ (yes + no) + 5)  # votes yes on what is false
        prior = np.clip((w1.sum() + 1) / (count.sum() + 2), 0.01, 0.99)
        odds = np.log(prior / (1 - prior)) + yes @ np.log(right1 / wrong0) + no @ np.log((1 - right1) / (1 - wrong0))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def fit_logistic(x: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights (the last is the constant) by gradient descent on the expected log loss."""
    x = np.column_stack([x, np.ones(len(x))])
    w, share = np.zeros(x.shape[1]), count / count.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ ((q - p) * share) * 4 + 1e-3 * w)
    return w


def fit(found: DataFrame) -> dict[int, np.ndarray]:
    """A classifier for each kind, from the counts of (votes, features) over all candidates."""
    counts = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.vote", "s.feature").count().collect()  # bounded: see above
    out = {}
    for k in range(len(KINDS)):
        rows = sorted((r["vote"], r["feature"], r["count"]) for r in counts if r["kind"] == k)
        if rows:
            vote = np.array([[r[0] // 3**i % 3 - 1 for i in range(N_VOTES)] for r in rows])
            x = np.array([[r[1] >> i & 1 for i in range(N_FEATURES)] for r in rows], float)
            n = np.array([r[2] for r in rows], float)
            out[k] = fit_logistic(x, em(vote, n), n)
    return out


def spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (base spans), spans (all of them), n_added."""
    found = materialize(find_candidates(docs), "candidates")
    weights = fit(found)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = T.StructType([found.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names[1:5]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def probability(s: dict) -> float:
        w = weights[s["kind"]]
        return 1 / (1 + np.exp(-(w[-1] + sum(w[i] for i in range(N_FEATURES) if s["feature"] >> i & 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column(1).to_pylist():
                base = sorted((s["kind"], s["first"], s["last"]) for s in own if s["base"])
                starts = sorted(x[1:] for x in base)
                ends = list(accumulate((x[1] for x in starts), max))  # the furthest end so far
                added, last = [], 0
                for s in sorted((s for s in own if not s["base"]), key=lambda s: (s["first"], s["last"], s["kind"])):
                    before = bisect_left(starts, (s["last"],))
                    if s["first"] >= last and not (before and ends[before - 1] > s["first"]) and probability(s) >= accept:
                        added.append((s["kind"], s["first"], s["last"]))
                        last = s["last"]
                join = lambda x: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in x)
                rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(join(base).encode()).hexdigest(), join(sorted(base + added)), len(added)))
            columns = list(zip(*rows)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(names[1:], columns)], names=names)

    return found.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
