"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Terms and word beginnings that are far more frequent in documents labelled toxic form a trie. Its
intersection with the Levenshtein automaton of every term (one edit for terms of 5 letters or more, two for 9 or
more) is determinised as words are read, so that a word costs one look-up a letter. A word without a term is read
again with digits and signs as the letters they stand for and with letters that are drawn out once. Words of all lengths
are learned and matched. A window of words around each hit
tells quotation (quotation marks, words of reporting or denial) from abuse (words of address). A logistic
model over a text's hits gives the score.

A term is in the lexicon if its likelihood ratio against chance beats what the number of terms looked at makes likely; how
many these are is not bounded. The lexicon and the model are fitted on a bounded sample of the labelled rows (train_rows, chosen by a hash
of the id); texts are scored whole. Null and empty texts, and all texts when no row is labelled, get the score
of a text without hits. A label other than 0 and 1 and a null one are not learned; of repeated labels of a
document the largest counts. Repeated rows give a row each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import documents, fold, map_batches
from paperloom.scratch import discard, written

TRAIN_ROWS = 24_000  #: labelled rows to fit on, about
LEAST_ODDS = 2.0  #: log-odds of a term
STEM = 5  #: letters of a word's beginning
#: Letters that digits and signs stand for.
STANDS_FOR = str.maketrans("0134578@$", "oieastbas")
DRAWN_OUT = re.compile(r"(.)\1{2,}")
WINDOW = 6
CACHE_WORDS = 400_000
REPORTING = frozenset("said says quoted quote quotes wrote writes called reported cited term word never not sagte schrieb zitat nicht dit cité écrit pas dijo escribió citado".split())
ADDRESS = frozenset("you your youre du dich dir dein ihr tu toi vous votre te tú usted eres".split())
QUOTES = "\"'“”„«»‘’`"
WORDS = re.compile(r"[^\W_]+").findall
PIECES = re.compile(r"[\W_]*[^\W_]+(?:[\W_]+$)?").findall  #: each word with the marks before it, the last with those behind


def edits_allowed(letters: int) -> int:
    """How many edits a term of so many letters may be away."""
    return 0 if letters < 5 else 1 if letters < 9 else 2


class Matcher:
    """Terms in words: match(word) is (term, edits) of the best term or None."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        """terms: text, whether it is a beginning of words rather than a word, weight."""
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.deep: list[int] = [0]  # edits that any term through a node allows
        for i, (text, stem, _) in enumerate(terms):
            at, own = 0, 0 if stem else edits_allowed(len(text))
            self.deep[0] = max(self.deep[0], own)
            for c in text:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.deep.append(0)
                at = self.child[at][c]
                self.deep[at] = max(self.deep[at], own)
            if self.ends[at] < 0 or terms[self.ends[at]][1] and not stem:
                self.ends[at] = i
        self.stems = {t: i for i, (t, stem, _) in enumerate(terms) if stem}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, members: set[tuple[int, int]]) -> int:
        """Number of a set of (trie node, edits so far); letters of the term may be missing next."""
        todo = list(members)
        while todo:
            node, edits = todo.pop()
            for n in self.child[node].values():
                if edits < self.deep[n] and (n, edits + 1) not in members:
                    members.add((n, edits + 1))
                    todo.append((n, edits + 1))
        # A node with fewer edits makes the same with more needless.
        members = frozenset(m for m in members if not any((m[0], e) in members for e in range(m[1])))
        if not members:
            return -1
        if members not in self.states:
            self.states[members] = len(self.members)
            self.members.append(members)
            self.moves.append({})
        return self.states[members]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.members[state]:
            n = self.child[node].get(c)
            if n is not None:
                after.add((n, edits))
            if edits < self.deep[node]:
                after.add((node, edits + 1))
            after |= {(m, edits + 1) for m in self.child[node].values() if m != n and edits < self.deep[m]}
        self.moves[state][c] = out = self._state(after)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        found = self._match(word)
        if found is None:
            # As it may be meant: signs for letters, letters drawn out to one or two.
            plain = word.translate(STANDS_FOR) if not word.isalpha() and not word.isdecimal() else word
            for other in dict.fromkeys((plain, DRAWN_OUT.sub(r"\1", plain), DRAWN_OUT.sub(r"\1\1", plain))):
                if other != word and (found := self._match(other)) is not None:
                    return found[0], max(1, found[1])
        return found

    def _match(self, word: str) -> tuple[int, int] | None:
        best = None
        if len(self.members) > 100_000:
            self._reset()
        state, moves = self.start, self.moves
        for c in word:
            state = moves[state][c] if c in moves[state] else self._move(state, c)
            if state < 0:
                break
        else:
            for node, edits in self.members[state]:
                i = self.ends[node]
                if i >= 0 and edits <= (0 if self.terms[i][1] else edits_allowed(len(self.terms[i][0]))) and (not self.terms[i][1] or len(word) == len(self.terms[i][0])):
                    found = (edits, -self.terms[i][2], i)
                    best = min(best, found) if best else found
        if best and best[0] == 0:
            return best[2], 0
        stem = self.stems.get(word[:STEM]) if len(word) > STEM else None
        if stem is not None:
            return stem, 0
        return (best[2], best[0]) if best else None


FEATURES = 8


class Scorer:
    def __init__(self, terms: list[tuple[str, bool, float]], weights: np.ndarray | None):
        self.matcher, self.weights = Matcher(terms), weights
        self.seen: dict[str, tuple[list, list] | None] = {}

    def _look(self, token: str) -> tuple[list[str], list[tuple[int, int] | None]] | None:
        """The pieces of a token, one a word, and the hit of each; None for one word or none without a hit."""
        lowered, found = token.lower(), None
        hits = [self.matcher.match(w) for w in WORDS(lowered)]
        any_hit = any(h is not None for h in hits)
        if len(hits) > 1:
            # Words joined by marks; where none is a hit, a mark may stand for a letter.
            whole = None if any_hit else self.matcher.match(lowered.strip("\"'“”„«»‘’`.,;:!?()[]{}*&%$#|<>/\\-_+=~"))
            found = (PIECES(lowered), hits) if whole is None else ([token], [whole])
        elif any_hit:
            found = ([token], hits)
        if len(token) < 40:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            self.seen[token] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(FEATURES)
        x[0] = 1
        if not text or not self.matcher.terms:
            return x
        tokens = text.split()
        get, look = self.seen.get, self._look
        found = [(i, f) for i, w in enumerate(tokens) if (f := get(w, 0)) is not None and (f or (f := look(w)))]
        words, hits, at = [], [], 0
        for i, (pieces, own) in found:
            words += tokens[at:i]
            hits += [(len(words) + k, h) for k, h in enumerate(own) if h is not None]
            words += pieces
            at = i + 1
        words += tokens[at:]
        terms, kinds, quoted = self.matcher.terms, set(), 0.0
        for i, (term, edits) in hits:
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            lowered = [w.lower().strip(".,;:!?") for w in around]
            own = words[i]
            marks = own[0] in QUOTES or own.rstrip(".,;:!?")[-1:] in QUOTES
            if not marks:
                before = any(w[0] in QUOTES for w in words[max(0, i - WINDOW) : i])
                after = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in words[i + 1 : i + WINDOW + 1])
                marks = before and after
            context = 0.7 * marks + 0.3 * any(w in REPORTING for w in lowered) - 0.3 * any(w in ADDRESS for w in lowered)
            quoted += max(0.0, context)
            weight = terms[term][2]
            kinds.add(term)
            if terms[term][1]:
                x[2] += weight
            elif edits:
                x[3] += weight
            else:
                x[1] += weight
        n = len(hits)
        x[1:4] = np.log1p(x[1:4])
        x[4] = math.log1p(len(kinds))
        x[5] = quoted / n if n else 0.0
        x[6] = math.log1p(1000 * n / (len(words) + 20)) if n else 0.0
        x[7] = n > 0
        return x

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + math.exp(-float(np.clip(self.features(text) @ self.weights, -40, 40)))))


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, stem, n0, p0, n1, p1): documents that hold a word or a beginning of words, clean and toxic, in each half
    of sample (text, toxic, half). Counted by batch before they are dealt."""

    def work(batch):
        counts: dict[tuple[str, bool], list[int]] = {}
        for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            words = set(WORDS(text.lower()))
            at = 2 * half + toxic
            for key in [*((w, False) for w in words), *((s, True) for s in {w[:STEM] for w in words if len(w) > STEM})]:
                if key not in counts:
                    counts[key] = [0, 0, 0, 0]
                counts[key][at] += 1
        return {"term": [k[0] for k in counts], "stem": [k[1] for k in counts]} | {n: [v[i] for v in counts.values()] for i, n in enumerate(("n0", "p0", "n1", "p1"))}

    rows = map_batches(sample.select("text", "toxic", "half"), lambda: work, "term string, stem boolean, n0 long, p0 long, n1 long, p1 long")
    return rows.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")])


def lexicon(counts: DataFrame, terms: int, positive: int, negative: int, p: Column, q: Column) -> list[tuple[str, bool, float]]:
    """Words and beginnings of words whose documents are toxic (p of positive, q of negative) more often than chance makes
    likely for the best of so many terms."""
    if not positive or not negative:
        return []
    share, n = positive / (positive + negative), p + q
    odds = F.log((p + 0.5) / (positive + 1)) - F.log((q + 0.5) / (negative + 1))
    ratio = 2 * (p * F.log(p / (n * share)) + F.when(q > 0, q * F.log(q / (n * (1 - share)))).otherwise(0.0))
    wanted = counts.filter(p > 0).withColumn("odds", odds).filter((F.col("odds") > LEAST_ODDS) & (ratio >= 2 * math.log(max(1, terms))))
    return [(r["term"], r["stem"], float(r["odds"])) for r in wanted.select("term", "stem", "odds").orderBy("term", "stem").collect()]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method with a ridge penalty on all but the first."""
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> tuple[list, np.ndarray | None]:
    """Lexicon and weights from docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, train_rows / n) if n else 0.0
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    sample = written(docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id").withColumn("half", half), "toxic-sample")
    n = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, p0, n1, p1 = (n.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
    counts = written(term_counts(sample), "toxic-terms")
    # The lexicon that weighs a row is learned from the other half, so that weights are not too sure of it.
    terms = counts.count()
    by_0 = lexicon(counts, terms, p0, n0, F.col("p0"), F.col("n0"))
    by_1 = lexicon(counts, terms, p1, n1, F.col("p1"), F.col("n1"))
    table = _featured(sample.filter("half = 1"), by_0).union(_featured(sample.filter("half = 0"), by_1)).toArrow()
    whole = lexicon(counts, terms, p0 + p1, n0 + n1, F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1"))
    discard(sample, counts)
    if table.num_rows == 0 or len(set(table["y"].to_pylist())) < 2:
        return [], None
    # In one order, so that sums and weights are the same in every run.
    rows = sorted(zip(table["x"].to_pylist(), table["y"].to_pylist(), table["n"].to_pylist(), strict=True))
    x, y, n = (np.array([r[i] for r in rows], float) for i in range(3))
    return whole, logistic(x, y, n)


def _featured(sample: DataFrame, terms: list) -> DataFrame:
    """Equal rows of features are counted on the executors."""
    shared, name = sample.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def make():
        own = scorer(name, lambda: Scorer(shared.value, None))

        def work(batch):
            return {"x": [np.round(own.features(t), 3).tolist() for t in batch.column("text").to_pylist()], "y": batch.column("toxic")}

        return work

    return map_batches(sample.select("text", "toxic"), make, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


SCORERS: dict[str, Scorer] = {}


def scorer(name: str, new) -> Scorer:
    """One for each worker process and model, which goes on from task to task."""
    if name not in SCORERS:
        SCORERS.clear()
        SCORERS[name] = new()
    return SCORERS[name]


def scored(docs: DataFrame, model: tuple[list, np.ndarray | None]) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        own = scorer(name, lambda: Scorer(*shared.value))
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": [own.score(t) for t in batch.column("text").to_pylist()]}

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id")) == 0
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
