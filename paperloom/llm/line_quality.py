"""Quality rules by line-first cleaning: lines that fail a rule go first, then documents that lose too much text.

Every line with a word is judged alone, by rules that need no language:
  punctuation  more than ODD_PERCENT of the characters in its words are odd marks
  open_end     fewer than PARAGRAPH_WORDS words, and the last character ends no sentence (a longer one is a paragraph that was cut)
  navigation   at least LEAST_SEPARATORS words, and SEPARATOR_PERCENT of all, are separators that stand alone
  shouting     LEAST_WORDS words or more, and more than CAPITAL_PERCENT of its letters A-Z are capitals
  boilerplate  fewer than BOILERPLATE_WORDS words, and a phrase of BOILERPLATE in them
  repeated     an earlier line of the document is equal
A document is kept if it passes the base rules (least words, share of words in repeated windows) and its failing lines
hold at most LOST_PERCENT of its words.

A null text has no words and fails. Rows stand for themselves: repeated ids and texts get equal results. Texts of any length are
read whole; memory holds one text at a time. An empty table gives no rows. Further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import WORD, documents, map_batches
from paperloom.llm.periodic_runs import numbers

BLANKS = " \t\n\x0b\x0c\r"
LEAST_TEXT_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30  #: base rules
SYMBOLS, ODD_MARKS = r"[#*$%&|<>]", r"[#*$%&|<>{}\[\]=~^\\_!?]"
ODD_PERCENT, CAPITAL_PERCENT, LEAST_WORDS, LOST_PERCENT = 10, 60, 5, 50
SENTENCE_ENDS = ".!?:;…。！？\"')]»”’"
SEPARATORS, LEAST_SEPARATORS, SEPARATOR_PERCENT = ("|", "||", ">", ">>", "»", "«", "·", "•", "/", "::"), 2, 15
PARAGRAPH_WORDS, BOILERPLATE_WORDS = 30, 30
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "click here", "read more", "sign up", "log in", "subscribe", "lorem ipsum", "back to top",
    "alle rechte vorbehalten", "datenschutz", "impressum", "tous droits", "mentions légales", "todos los derechos", "aviso legal",
)
RULES = ("punctuation", "open_end", "navigation", "shouting", "boilerplate", "repeated")

_odd, _symbol = re.compile(ODD_MARKS), re.compile(SYMBOLS)
_capital, _small = re.compile("[A-Z]"), re.compile("[a-z]")
_phrase = re.compile("|".join(map(re.escape, BOILERPLATE)))
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def characters(text: str) -> int:
    """Code points in words."""
    return len(text) - sum(map(text.count, BLANKS))


def failed_rule(line: str, words: list[bytes]) -> str | None:
    """The first rule that a line (with a word) fails by itself."""
    n = len(words)
    if 100 * len(_odd.findall(line)) > ODD_PERCENT * characters(line):
        return "punctuation"
    if n < PARAGRAPH_WORDS and line.rstrip(BLANKS)[-1] not in SENTENCE_ENDS:
        return "open_end"
    alone = sum(w.decode("utf-8", "surrogatepass") in SEPARATORS for w in words if len(w) <= 4)
    if alone >= LEAST_SEPARATORS and 100 * alone >= SEPARATOR_PERCENT * n:
        return "navigation"
    if n >= LEAST_WORDS:
        large = len(_capital.findall(line))
        if 100 * large > CAPITAL_PERCENT * (large + len(_small.findall(line))):
            return "shouting"
    if n < BOILERPLATE_WORDS and _phrase.search(line.translate(_lower)):
        return "boilerplate"
    return None


def lines_of(text: str) -> Iterator[tuple[str, int, str | None]]:
    """Every line with a word: the line, its number of words and the rule that it fails."""
    seen = set()
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if words:
            rule = failed_rule(line, words)
            yield line, len(words), rule or ("repeated" if line in seen else None)
            seen.add(line)


def repeat_words(x: np.ndarray, window: int) -> int:
    """Words in windows that x (equal numbers for equal words) holds twice or more. Ranks of words are joined to ranks of
    longer pieces, so that windows are compared exactly."""
    if len(x) <= window:
        return 0
    ranks, size = x, 1
    while size < window:
        step = min(size, window - size)
        ranks = ranks[: len(ranks) - step] * (len(x) + 1) + ranks[step:]
        ranks = np.unique(ranks, return_inverse=True)[1]
        size += step
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(len(x) + 1, np.int64)
    edges[again] += 1
    edges[again + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def cleaned(docs: DataFrame) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lost (words in failing lines), failed_lines (a rule's name for each), kept and text, its passing lines."""

    def work(batch):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "failed_lines", "kept", "text")
        out = {k: [] for k in names}
        for text in batch.column("text").to_pylist():
            text = text or ""
            words = text.encode("utf-8", "surrogatepass").split()
            lines = list(lines_of(text))
            n, repeats = len(words), repeat_words(numbers(words), REPEAT_WINDOW)
            lost = sum(k for _, k, rule in lines if rule)
            failed = n < LEAST_TEXT_WORDS or 100 * repeats > REPEAT_PERCENT * n
            values = (
                n, characters(text), len(_symbol.findall(text)), len(lines) - len({line for line, _, _ in lines}), repeats, failed,
                lost, [rule for _, _, rule in lines if rule], not failed and 100 * lost <= LOST_PERCENT * n, "\n".join(line for line, _, rule in lines if not rule),
            )
            for k, v in zip(names, values, strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lost long, failed_lines array<string>, kept boolean, text string"
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), lambda: work, schema, rows=500)


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir)).drop("failed_lines", "text")


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i, w FROM (SELECT k, regexp_extract_all(text, '{WORD}') AS w FROM docs)),
windows AS (SELECT k, i, CASE WHEN len(w) >= i + 7 THEN array_to_string(list_slice(w, i, i + 7), ' ') END AS t FROM words),
again AS (SELECT k, i, CAST(t IS NOT NULL AND count(t) OVER (PARTITION BY k, t) > 1 AS INT) AS r FROM windows),
covered AS (SELECT k, max(r) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM again),
repeats AS (SELECT k, count(*) AS n_words, sum(c) AS n_repeat_words FROM covered GROUP BY 1),
split AS (SELECT k, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT k, string_split(text, chr(10)) AS l FROM docs)),
parts AS (SELECT *, regexp_extract_all(line, '{WORD}') AS w FROM split),
judged AS (SELECT k, i, line, len(w) AS n,
    100 * len(regexp_extract_all(line, '{ODD_MARKS}')) > {ODD_PERCENT} * length(array_to_string(w, '')) AS odd,
    len(w) < {PARAGRAPH_WORDS} AND NOT contains({_quoted(SENTENCE_ENDS)}, right(w[-1], 1)) AS open_end,
    list_sum(list_transform(w, lambda x: CAST(x IN ({", ".join(map(_quoted, SEPARATORS))}) AS INT))) AS alone,
    len(regexp_extract_all(line, '[A-Z]')) AS large, len(regexp_extract_all(line, '[a-z]')) AS small,
    {" OR ".join(f"contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(p)})" for p in BOILERPLATE)} AS phrase,
    row_number() OVER (PARTITION BY k, line ORDER BY i) > 1 AS repeated FROM parts WHERE len(w) > 0),
lines AS (SELECT k, CAST(sum(CAST(repeated AS INT)) AS BIGINT) AS n_dup_lines,
    sum(CASE WHEN odd OR open_end OR alone >= {LEAST_SEPARATORS} AND 100 * alone >= {SEPARATOR_PERCENT} * n OR n >= {LEAST_WORDS} AND 100 * large > {CAPITAL_PERCENT} * (large + small)
      OR n < {BOILERPLATE_WORDS} AND phrase OR repeated THEN n ELSE 0 END) AS n_lost FROM judged GROUP BY 1),
all_of AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost
  FROM docs LEFT JOIN repeats USING (k) LEFT JOIN lines USING (k))
SELECT *, n_words < {LEAST_TEXT_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_TEXT_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * n_lost <= {LOST_PERCENT} * n_words AS kept FROM all_of
"""
