"""Periodic runs of words: stretches that repeat one period at least LEAST_POWER times, found by block matching.

For every power of two B the blocks of B words at multiples of B are the keys of an automaton over word numbers, which is
run over the document. A run with a period q of B to 2B - 1 holds at least one such block wholly, and so does the stretch q words
behind it: every place of a block again at a distance of B to 2B - 1 is a seed, which is extended word by word to both
sides as far as words q apart are equal. Nothing depends on hashes. Two things keep the work near to the length of the text, and
lose no run: each word of a run is in it LEAST_POWER times, so only stretches of words that the text holds that often are
searched; and a seed inside a known run of a shorter period that covers block, distance and block again cannot be primitive
(two periods p < B and q on p + q words have a common divisor as period), so it is not extended.

A null text has no words; a document without words or runs has n_runs 0, nulls for the run and the digest of nothing or of
all its words. A null id means that no word is replaced. Every row stands for itself, so repeated rows get
equal results; of runs with one exponent the one with the least start, then the least period is named. Texts of any length are
read whole; memory holds a batch of texts and what one text needs. An empty table gives no rows. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import WORD, crc32_sql, documents, map_batches

LEAST_LENGTH, LEAST_POWER = 6, 4
STEP = 64  #: words compared at once when a seed is extended; doubled from step to step


def numbers(words: list[bytes]) -> np.ndarray:
    """Words as whole numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def frequent_stretches(x: np.ndarray, least_length: int, power: int) -> list[tuple[int, int]]:
    """Stretches [a, b) all of whose words x holds at least `power` times; taken again in each stretch until it stays."""
    todo, done = [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        if b - a < least_length:
            continue
        part = x[a:b]
        _, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[inverse] < power)
        if not len(rare):
            done.append((a, b))
            continue
        edges = np.concatenate(([-1], rare, [b - a]))
        todo += [(a + int(edges[i]) + 1, a + int(edges[i + 1])) for i in np.flatnonzero(np.diff(edges) > least_length)]
    return done


def seeds(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of aligned blocks of `size` words that stand again at a distance of size to 2 * size - 1."""
    letters = tuple(x.tolist())
    keys, starts = {}, range(0, len(x) - size + 1, size)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    block_key = np.empty(len(starts), np.int64)
    for i, s in enumerate(starts):
        block = letters[s : s + size]
        block_key[i] = keys.setdefault(block, len(keys))
    for block, key in keys.items():
        automaton.add_word(block, key)
    automaton.make_automaton()
    # Keys have one length, so at most one ends at a word; places come in order.
    found = np.array(list(automaton.iter(letters)), np.int64).reshape(-1, 2)
    places = np.sort(found[:, 1] * len(x) + found[:, 0] - size + 1)
    first = block_key * len(x) + np.arange(len(starts)) * size
    low = np.searchsorted(places, first + size)
    high = np.searchsorted(places, np.minimum(first + 2 * size, (block_key + 1) * len(x)))
    n = high - low
    each = np.repeat(np.arange(len(starts)), n)
    at = places[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())] % len(x)
    return each * size, at - each * size


def extended(x: np.ndarray, start: int, q: int) -> tuple[int, int]:
    """[a, b) around start where words q apart are equal; b is behind the later of the two."""
    a, step = start, STEP
    while a > 0:
        low = max(0, a - step)
        unlike = np.flatnonzero(x[low:a] != x[low + q : a + q])
        if len(unlike):
            a = low + int(unlike[-1]) + 1
            break
        a, step = low, 2 * step
    b, step = start, STEP
    while b + q < len(x):
        high = min(len(x) - q, b + step)
        unlike = np.flatnonzero(x[b:high] != x[b + q : high + q])
        if len(unlike):
            b += int(unlike[0])
            break
        b, step = high, 2 * step
    return a, b + q


def not_covered(start: np.ndarray, end: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the stretches [start, end) lie in none of runs (start, length, period)."""
    if not runs:
        return np.ones(len(start), bool)
    known = np.array(sorted((s, s + n) for s, n, _ in runs))
    reach = np.maximum.accumulate(known[:, 1])
    at = np.searchsorted(known[:, 0], start, side="right") - 1
    return (at < 0) | (reach[at] < end)


def runs_of(x: np.ndarray, least_length: int = LEAST_LENGTH, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of x, by start, then period."""
    out = []
    for a, b in frequent_stretches(x, least_length, power):
        part, runs, size = x[a:b], [], 1
        while power * size <= len(part):
            start, distance = seeds(part, size)
            fresh = not_covered(start, start + distance + size, runs)
            order = np.lexsort((start[fresh], distance[fresh]))
            # A block that starts before `reached` is in the stretch that was found last for this period.
            last, reached, found = 0, -1, []
            for s, q in zip(start[fresh][order].tolist(), distance[fresh][order].tolist(), strict=True):
                if q == last and s < reached:
                    continue
                left, right = extended(part, s, q)
                last, reached = q, right - q
                if right - left >= max(least_length, power * q):
                    found.append((left, right - left, q))
            runs += found
            size *= 2
        out += [(a + s, n, q) for s, n, q in runs]
    return sorted(out, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equal ones the first, then that of the least period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run contains after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def replaced(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract's test: of every tenth id, by crc32, the words from one on are made periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def detected(docs: DataFrame, *, least_length: int = LEAST_LENGTH, power: int = LEAST_POWER, planted: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row of docs (doc_id, text): its runs, and its words without repeats joined by a blank.
    `planted` replaces words as the contract of the query asks."""
    if power < 2 or least_length < power:
        raise ValueError("a run repeats its period at least twice, and each word of it at least once")

    def work(batch):
        out = {"doc_id": batch.column("doc_id"), "n_words": [], "runs": [], "text": []}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            if planted:
                words = replaced(words, doc_id)
            runs = runs_of(numbers(words), least_length, power)
            out["n_words"].append(len(words))
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            out["text"].append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass"))
        return out

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), lambda: work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string", rows=500)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(batch):
        out = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        for found, text in zip(batch.column("runs").to_pylist(), batch.column("text").to_pylist(), strict=True):
            runs = [(r["start"], r["length"], r["period"]) for r in found]
            best = best_run(runs)
            values = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            for k, v in zip(out, (*values, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()), strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_batches(detected(documents(spark, sf_dir), planted=True), lambda: work, schema)


OP13_SQL = rf"""
WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {crc32_sql('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
cut AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS g FROM raw),
docs AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END]) ELSE w END AS w FROM cut),
words AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
often AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word) AS c FROM words) WHERE c >= 4),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM often a JOIN often b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM marked GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretches s WHERE NOT EXISTS (SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM runs GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY better, start, q) AS r FROM (
  SELECT s.*, (SELECT count(*) FROM runs t WHERE t.doc_id = s.doc_id AND t.length * s.q > s.length * t.q) AS better FROM runs s)) WHERE r = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed ON listed.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
