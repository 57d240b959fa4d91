"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. Storing these
last tokens gives the encoding by walking back, lets bytes be appended without touching earlier entries,
and lets an edit be re-encoded from the changed byte on.

A null text counts as empty and gives no tokens. Every text is encoded whole, a piece at a time; caches of a worker
are cleared at a fixed size. Every row gives a row: repeated ids and texts get equal results, null ids stay null. An
empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import documents, map_batches

CACHE_PIECES, CACHE_CHUNKS, CACHE_PREFIXES = 600_000, 400_000, 400_000  #: entries a worker process keeps over its tasks
SHORT = 48  #: bytes of a piece whose prefixes are kept
NEVER = 1 << 62  #: later than any rank


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    """Encoder and decoder over ranks (token bytes -> id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.reachable: set[int] = set()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._borders: tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]] = {}, {}
        self._prefixes: dict[bytes, int] = {}
        # In order of rank: a token's halves are the two tokens its bytes have under lower ranks.
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[i] = (i, i)
                self.reachable.add(i)
                continue
            parts = self.walk_back(self.extend([], token))
            if len(parts) == 2:
                self.halves[i] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = i
                self.reachable.add(i)
                self._pairs.pop((parts[0], parts[1]), None)

    def _border(self, token: int, side: int) -> tuple[int, ...]:
        """What stands at one border of a token (0 its beginning, 1 its end) while it is merged: a byte first, the token last."""
        found = self._borders[side].get(token)
        if found is None:
            inner = self.halves[token][side]
            found = self._borders[side][token] = (token,) if inner == token else (*self._border(inner, side), token)
        return found

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves left and right apart where they meet.

        As long as nothing is merged over the border, both sides go through their own merges, each at the rank of what it makes. So
        the pairs that meet at the border are known, in order of time, and for each how long it lasts: until the next merge of either
        side. A pair with a token of its own is merged if that token's rank comes before; of equal ranks the place further left goes
        first, so the border gives way to the left side and goes before the right one."""
        ends, begins = self._border(left, 1), self._border(right, 0)
        i = j = 0
        while True:
            left_next = ends[i + 1] if i + 1 < len(ends) else NEVER
            right_next = begins[j + 1] if j + 1 < len(begins) else NEVER
            if self.joined.get((ends[i], begins[j]), NEVER) < min(left_next, right_next + 1):
                return False
            if left_next == right_next == NEVER:
                return True
            if left_next <= right_next:
                i += 1
            else:
                j += 1

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """last[i]: the token that ends the encoding of data[:i + 1]; filled in place up to the whole of data.
        Entries that are there already must belong to a prefix of data: an append keeps them all, an edit
        those before it."""
        ranks, token_bytes, reachable, pairs = self.ranks, self.token_bytes, self.reachable, self._pairs
        if len(pairs) > 500_000:
            pairs.clear()
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(data[start:end])
                if token is None or token not in reachable:
                    continue
                if start:
                    before = last[start - 1]
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = pairs[before, token] = self._may_follow(before, token)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        ids, token_bytes, end = [], self.token_bytes, len(last)
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= len(token_bytes[token])
        return ids[::-1]

    def _encode_short(self, data: bytes) -> list[int]:
        """As extend and walk_back, with the last tokens kept by prefix, so that words share those of
        their common beginnings."""
        ranks, reachable, pairs, known = self.ranks, self.reachable, self._pairs, self._prefixes
        if len(pairs) > 500_000:
            pairs.clear()
        if len(known) > CACHE_PREFIXES:
            known.clear()
        n = first = len(data)
        while first and data[:first] not in known:
            first -= 1
        for end in range(first + 1, n + 1):
            for start in range(end):
                token = ranks.get(data[start:end])
                if token is None or token not in reachable:
                    continue
                if start:
                    pair = known[data[:start]], token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self._may_follow(*pair)
                    if not fits:
                        continue
                known[data[:end]] = token
                break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")
        ids, token_bytes = [], self.token_bytes
        while n:
            token = known[data[:n]]
            ids.append(token)
            n -= len(token_bytes[token])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self._encode_short(data) if len(data) <= SHORT else self.walk_back(self.extend([], data))

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token is that token, whether merges reach it or not."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode(data)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class TextEncoder:
    """Encodes texts piece by piece; each match of pattern is a piece. Ids are decimal, joined by commas."""

    def __init__(self, bpe: PrefixBPE, pattern: str):
        import regex

        self.bpe = bpe
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, str] = {}
        self.chunks: dict[str, str] = {}
        self.spelled = {str(i): b for i, b in bpe.token_bytes.items()}

    def _piece(self, piece: str) -> str:
        found = self.pieces.get(piece)
        if found is None:
            found = ",".join(map(str, self.bpe.encode_piece(piece.encode())))
            if len(piece) < 64:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> str:
        found = ",".join(map(self._piece, self.find(chunk)))
        if len(chunk) < 64:
            if len(self.chunks) >= CACHE_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> str:
        """No piece goes on past a single space between two characters that are not white space, as the
        space starts the next piece; so what stands between such spaces is encoded by itself."""
        get, out, held = self.chunks.get, [], ""
        for i, part in enumerate(text.split(" ")):
            chunk = " " + part if i else part
            if held:
                if part and not part[0].isspace() and not held[-1].isspace():
                    out.append(get(held) or self._chunk(held))
                    held = chunk
                else:
                    held += chunk
            else:
                held = chunk
        if held:
            out.append(self._chunk(held))
        return ",".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.split(","))) if ids else b""


@functools.cache
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process, which goes on from task to task."""
    return TextEncoder(PrefixBPE(load_ranks(path)), pattern)


def _public(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encoded(docs: DataFrame, *, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of docs (doc_id, text); ids decimal and comma-joined."""
    return _mapped(docs, "doc_id long, n_tokens long, ids string, decoded binary", vocabulary, pattern, lambda enc, ids: (ids, enc.decode(ids)), ("ids", "decoded"))


def _mapped(docs, schema, vocabulary, pattern, derive, names):
    def make():
        path, own = _public("byte_bpe_multi_50k.tiktoken")
        enc = text_encoder(vocabulary or path, pattern or own)

        def work(batch):
            ids = [enc.encode(t) if t else "" for t in batch.column("text").to_pylist()]
            made = [derive(enc, x) for x in ids]
            return {"doc_id": batch.column("doc_id"), "n_tokens": [x.count(",") + 1 if x else 0 for x in ids]} | {n: [m[k] for m in made] for k, n in enumerate(names)}

        return work

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _mapped(documents(spark, sf_dir), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", None, None, lambda enc, ids: (sha(ids.encode()), sha(enc.decode(ids))), ("ids_sha256", "decoded_sha256"))
