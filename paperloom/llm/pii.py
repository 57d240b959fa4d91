"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always stay. Wider
patterns propose further candidates (spelt-out addresses, numbers without a plus sign or with other
separators). Labelers vote yes, no or nothing on every candidate: regular expressions on its form, gazetteers
(public suffixes, calling codes, card issuers) and words of context around it. Expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability and each pattern's probability. On these soft labels a
logistic classifier of spans is trained: its features are the votes, the shape of the span, pieces of that shape, and
the words around it, hashed. It accepts candidates that overlap no base span.

All candidates of all documents count in the estimates; what reaches the driver is one row a pattern of votes,
of which there are at most 3 ** labelers a kind, and the features of about train_spans candidates a kind, chosen by a
hash of their document and place, on which the classifier is fitted.

Null and empty texts have no spans. Positions are code points, ends exclusive. Every row gives a row, repeated
ids too, and texts of any length are read whole; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import documents, map_batches
from paperloom.scratch import discard, written

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9  #: least probability of a candidate that is added
TRAIN_SPANS = 8_000  #: candidates of a kind to fit the classifier on, about
SLOTS = 512  #: hashed features of spans and contexts

# Base patterns. An e-mail match starts where the run of local characters before an @ does.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; each kind leftmost and not overlapping."""
    found, end = [], 0
    if "@" in text:
        for m in EMAIL_TAIL.finditer(text):
            start = m.start()
            while start > end and LOCAL.match(text[start - 1]):
                start -= 1
            if start < m.start():
                found.append((start, m.end(), "email"))
                end = m.end()
    for m in IP.finditer(text):
        if all(len(q := p.lstrip("0") or "0") <= 3 and int(q) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(only_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Wider patterns for candidates.
CANDIDATES = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?[A-Za-z0-9-]++(?:\s?(?:\.|[\[({]\s?(?:dot|DOT)\s?[\])}])\s?[A-Za-z0-9-]++)+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\) ?|00[0-9]{2}[ .-]|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,4}[0-9]{2,4}(?![0-9A-Za-z])")),
)

# Gazetteers and context words.
SUFFIXES = frozenset("com org net edu gov info io de fr es uk eu ch at it nl example test".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 55 60 61 62 64 65 81 82 86 90 91".split())
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
CONTEXT = {
    "email": frozenset("email e-mail mail contact correo courriel kontakt write address".split()),
    "ip": frozenset("ip ipv4 ipv6 address server host client adresse dirección login".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment pay".split()),
    "phone": frozenset("phone tel telephone telefon téléphone teléfono mobile cell call fax handy móvil appel ruf whatsapp".split()),
}
AGAINST = frozenset("order invoice version isbn id no nr ref page pages article item date token line total code".split())
LABELERS = ("form", "check", "gazetteer", "context", "against")
AROUND = 40  #: characters before and after a candidate that are its context
WORDS = re.compile(r"[\w-]+")


def votes(text: str, start: int, end: int, kind: str) -> list[int]:
    """1 yes, -1 no, 0 abstains; one of each labeler."""
    span = text[start:end]
    digits = only_digits(span)
    near = {w.lower() for w in WORDS.findall(text[max(0, start - AROUND) : start])} | {w.lower() for w in WORDS.findall(text[end : end + AROUND // 2])}
    context = 1 if near & CONTEXT[kind] else 0
    against = -1 if near & AGAINST else 0
    if kind == "email":
        suffix = re.split(r"[^A-Za-z]+", span)[-1].lower()
        return [1 if re.search(r"\.|dot|DOT", span) else -1, 0, 1 if suffix in SUFFIXES else -1, context, against]
    if kind == "ip":
        return [1, 1 if len(set(span.split(":"))) > 2 else -1, 0, context, against]
    if kind == "card":
        return [1 if len(digits) == 16 else -1, 1 if luhn(digits) else -1, 1 if digits.startswith(CARD_ISSUERS) else -1, context, against]
    code = digits[2:] if digits.startswith("00") else ""
    form = 1 if span[0] == "(" or 9 <= len(digits) <= 11 else -1
    check = 1 if 9 <= len(digits) <= 15 else -1
    return [form, check, (1 if any(code.startswith(c) for c in CALLING_CODES) else -1) if code else 0, context, against]


def shape(span: str) -> str:
    """Digits as 9, letters as a, other characters as they are."""
    return "".join("9" if c.isdecimal() else "a" if c.isalpha() else c for c in span)


def hashed_features(text: str, start: int, end: int) -> list[int]:
    """Slots of the span's shape, its pieces of three, its length, and the words before and behind it."""
    form = shape(text[start:end])
    names = {f"s{form}", f"n{min(40, end - start)}", *("p" + form[i : i + 3] for i in range(len(form) - 2))}
    names |= {"b" + w.lower() for w in WORDS.findall(text[max(0, start - AROUND) : start])}
    names |= {"e" + w.lower() for w in WORDS.findall(text[end : end + AROUND // 2])}
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in names})


def merged(intervals: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of intervals, in order."""
    starts, ends = [], []
    for s, e in sorted(intervals):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def extra_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that overlap no base span, nor one of an earlier kind."""
    taken, out = [(s, e) for s, e, _ in base], []
    for kind, pattern in CANDIDATES:
        if kind == "email" and not (("at" in text or "AT" in text) and any(b in text for b in "[({")):
            continue
        starts, ends = merged(taken)
        for m in pattern.finditer(text):
            start, end = m.span()
            at = bisect.bisect_left(starts, end)
            if at == 0 or ends[at - 1] <= start:
                taken.append((start, end))
                out.append((start, end, kind))
    return sorted(out)


FOUND = "doc_id long, base array<struct<start:int,end:int,kind:string>>, extra array<struct<start:int,end:int,kind:string,votes:array<int>,slots:array<int>>>"


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra) of every row of docs (doc_id, text)."""

    def work(batch):
        base, extra = [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text or "")
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in own])
            extra.append([{"start": s, "end": e, "kind": k, "votes": votes(text, s, e, k), "slots": hashed_features(text, s, e)} for s, e, k in extra_candidates(text or "", own)])
        return {"doc_id": batch.column("doc_id"), "base": base, "extra": extra}

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), lambda: work, FOUND, rows=500)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of two classes over vote patterns: each pattern's probability and the share of yes.
    Smoothing by one vote of each sort at the prior reliability keeps labelers that agree with none apart."""
    m = patterns.shape[1]
    p = np.clip(0.5 + 0.5 * patterns.sum(axis=1) / np.maximum(1, np.abs(patterns).sum(axis=1)), 0.05, 0.95)
    share = 0.5
    for _ in range(rounds):
        yes, no = counts * p, counts * (1 - p)
        share = (yes.sum() + 1) / (counts.sum() + 2)
        like = np.zeros((len(patterns), 2))
        for j in range(m):
            for v in (-1, 1):
                at = patterns[:, j] == v
                prior = (0.8, 0.2) if v == 1 else (0.2, 0.8)
                voted = patterns[:, j] != 0
                a = (yes[at].sum() + 10 * prior[0]) / (yes[voted].sum() + 10)
                b = (no[at].sum() + 10 * prior[1]) / (no[voted].sum() + 10)
                like[at, 0] += np.log(a)
                like[at, 1] += np.log(b)
        odds = np.log(share / (1 - share)) + like[:, 0] - like[:, 1]
        after = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(after - p).max() < 1e-6:
            break
        p = after
    return p, share


def dense(votes: np.ndarray, slots: list) -> np.ndarray:
    """Rows of features: one, votes for yes, votes for no, hashed features."""
    hashed = np.zeros((len(votes), SLOTS))
    for row, own in zip(hashed, slots, strict=True):
        row[own] = 1.0
    return np.concatenate([np.ones((len(votes), 1)), votes == 1, votes == -1, hashed], axis=1)


def soft_logistic(x: np.ndarray, p: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weights of the logistic model of probabilities p, with a ridge penalty, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (p - q) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(found: DataFrame, *, train_spans: int = TRAIN_SPANS) -> dict[str, np.ndarray]:
    """Weights of the span classifier of each kind, from soft labels that all candidates estimate."""
    each = found.select("doc_id", F.explode("extra").alias("c")).select("doc_id", "c.*")
    table = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    soft, share = {}, F.lit(0.0)
    for kind in KINDS:
        own = sorted((tuple(r["votes"]), r["n"]) for r in table if r["kind"] == kind)
        if own:
            patterns, counts = np.array([v for v, _ in own]), np.array([n for _, n in own], float)
            soft[kind] = dict(zip((v for v, _ in own), reliabilities(patterns, counts)[0].tolist(), strict=True))
            share = F.when(F.col("kind") == kind, min(1.0, train_spans / counts.sum())).otherwise(share)
    if not soft:
        return {}
    chosen = each.filter(F.pmod(F.xxhash64("doc_id", "start", "kind"), F.lit(1_000_000)) < share * 1_000_000)
    rows = sorted(map(tuple, chosen.select("kind", "votes", "slots").collect()))
    ridge = np.concatenate((np.full(1 + 2 * len(LABELERS), 0.1), np.full(SLOTS, 2.0)))
    weights = {}
    for kind, by_votes in soft.items():
        own = [(v, s) for k, v, s in rows if k == kind]
        # A kind of which the sample has none is decided by the votes alone.
        own = own or [(list(v), []) for v in by_votes]
        weights[kind] = soft_logistic(dense(np.array([v for v, _ in own]), [s for _, s in own]), np.array([by_votes[tuple(v)] for v, _ in own]), ridge)
    return weights


def probability(weights: dict[str, np.ndarray], kind: str, votes: list[int], slots: list[int]) -> float:
    w = weights.get(kind)
    if w is None:
        return 0.0
    m = len(LABELERS)
    total = w[0] + sum(w[1 + j] if v == 1 else w[1 + m + j] if v == -1 else 0.0 for j, v in enumerate(votes)) + w[[1 + 2 * m + s for s in slots]].sum()
    return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def spans(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, spans) of every row of docs (doc_id, text); spans hold base ones and those added."""
    found = written(found_spans(docs), "pii-found")
    weights = train(found)

    def work(batch):
        out = []
        for base, extra in zip(batch.column("base").to_pylist(), batch.column("extra").to_pylist(), strict=True):
            own = [(x["start"], x["end"], x["kind"]) for x in base]
            own += [(x["start"], x["end"], x["kind"]) for x in extra if probability(weights, x["kind"], x["votes"], x["slots"]) >= threshold]
            out.append([{"start": s, "end": e, "kind": k} for s, e, k in in_order(own)])
        return {"doc_id": batch.column("doc_id"), "base": batch.column("base"), "spans": out}

    return map_batches(found, lambda: work, f"doc_id long, base {SPANS}, spans {SPANS}")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def masked_text(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; other columns as they are."""
    found = written(found_spans(docs), "pii-found")
    weights = train(found)
    discard(found)
    def masked(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        own = base + [(s, e, k) for s, e, k in extra_candidates(text, base) if probability(weights, k, votes(text, s, e, k), hashed_features(text, s, e)) >= threshold]
        if not own:
            return text
        out, at = [], 0
        for start, end, kind in in_order(own):
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def work(batch):
        return {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"text": [masked(t) for t in batch.column("text").to_pylist()]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, lambda: work, schema, rows=500)
