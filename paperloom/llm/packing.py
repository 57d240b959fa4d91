"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's ids are cut at every multiple of the window; full pieces are windows of their own and the
rest of each document is placed, longest first, into the open window with the least room that still
holds it. A segment tree over remaining room finds that window.

Only ids' lengths and checksums leave the tokenising pass; pieces are dealt by a hash of (doc_id, start)
to shards of a bounded number of pieces, each packed by one task in a fixed order, so that a lost task is
repeated with the same result.

Null and empty texts are the end id alone. Repeated ids of documents are packed as separate rows;
a document with a null id as any other. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import documents, map_batches
from paperloom.scratch import written

WINDOW, END_ID = 4096, 2
PIECES_A_SHARD = 4096
CACHE_WORDS = 300_000  #: entries a worker process keeps over its tasks
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than blank, tab and line ends: a text with any is tokenised in one call.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file whose pieces never go past white space; words are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}  # of letters alone, in lower case
        self.others: dict[str, bytes] = {}
        # The characters that stand for bytes: printable ones for themselves, the others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _fresh(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """A lower-case word of letters is one piece: the model alone, without normalising and splitting."""
        spelled = word if word.isascii() else "".join(map(self.byte_chars.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _kept(self, held: dict[str, bytes], key: str, fresh) -> bytes:
        found = held.get(key)
        if found is None:
            found = fresh(key)
            if len(key) < 64:
                if len(held) >= CACHE_WORDS:
                    held.clear()
                held[key] = found
        return found

    def _word(self, word: str) -> bytes:
        """Letters followed by marks are two pieces, and case makes no difference to ids."""
        core = word.rstrip(MARKS)
        lowered = core.lower()
        found = self.words.get(lowered)
        if found is None:
            if not (lowered.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core))):
                return self._kept(self.others, word, self._fresh)
            found = self._kept(self.words, lowered, self._letters)
        if "Σ" in core:
            return self._kept(self.others, word, self._fresh)
        return found if len(core) == len(word) else found + self._kept(self.others, word[len(core) :], self._fresh)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if RARE_SPACE.search(text):
            return self._fresh(text)
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w) for w in text.split()])


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, which goes on from task to task."""
    return WordTokenizer(path)


class RoomTree:
    """Segment tree over room 0..window: how many open windows have each; finds the least room >= need."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        count, at = self.count, need + self.size
        if not count[at]:
            # Up to the first ancestor with an open window on its right, then down to its leftmost.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        sequence = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, sequence


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; lengths come longest first."""
    tree, sequences, offsets, opened = RoomTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found = window, opened
            opened += 1
        room, sequence = found
        sequences.append(sequence)
        offsets.append(window - room)
        if room > length:
            tree.add(room - length, sequence)
    return sequences, offsets


def pieces(docs: DataFrame, *, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of docs (doc_id, text)."""

    def make():
        import public_tokenizers

        tokenizer = word_tokenizer(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        end, step = np.array([end_id], "<u4").tobytes(), 4 * window

        def work(batch):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = (tokenizer.encode(text) if text else b"") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for k, v in zip(out, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        out[k].append(v)
            return out

        return work

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", rows=500)


def packed(docs: DataFrame, *, window: int = WINDOW, **options) -> DataFrame:
    """pieces() with sequence_id and offset."""
    cut = written(pieces(docs, window=window, **options), "pieces")
    shards = max(1, -(-cut.count() // PIECES_A_SHARD))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequences, offsets = best_fit(pdf["length"].tolist(), window)
        # Shards take turns in the ids, so that every id is used by one shard only.
        pdf["sequence_id"] = np.array(sequences, dtype=np.int64) * shards + pdf["shard"].to_numpy(np.int64)
        pdf["offset"] = offsets
        return pdf.drop(columns="shard")

    # Pieces with the same id and start, as those of rows without an id, are told apart by what they hold.
    shard = F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(shards))
    return cut.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
