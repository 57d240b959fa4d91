"""Providers of pixels, words and model answers.

A provider is a picklable object that workers call; what a library would be needed for and is not here
raises Unavailable instead of guessing. Whatever a provider raises, for one file or prompt, ends there: that file has no pages
or no words, that prompt no answer, and the others go on."""

from __future__ import annotations

import re
import struct
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paperloom.operators import jpeg


class Unavailable(RuntimeError):
    """A format or service for which no provider is configured."""


class PageProvider(Protocol):
    def pages(self, kind: str, content: bytes) -> list[np.ndarray]:
        """Images of all pages, height x width x channels, 8 bits."""


class WordProvider(Protocol):
    def words(self, kind: str, content: bytes) -> list[dict]:
        """page, word_idx, text, confidence (0-100), x, y, width, height, block_num, par_num, line_num."""


class ModelProvider(Protocol):
    def complete(self, prompt: str) -> str: ...


def decode_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB, RGBA or palette PNG without interlacing; alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, palette = 8, [], None
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
    if depth != 8 or interlaced:
        raise Unavailable("PNG with other than 8 bits or with interlacing")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int32), out[y - 1].astype(np.int32) if y else np.zeros(width * n, np.int32)
        if kind in (0, 2):
            out[y] = (line + (up if kind == 2 else 0)) & 255
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(-1, n), axis=0) & 255).ravel()
        else:
            row = out[y]
            for i in range(width * n):
                left, corner = (int(row[i - n]), int(up[i - n])) if i >= n else (0, 0)
                if kind == 3:
                    guess = (left + int(up[i])) // 2
                else:
                    p = left + int(up[i]) - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - int(up[i])), 1, int(up[i])), (abs(p - corner), 2, corner)))[2]
                row[i] = (int(line[i]) + guess) & 255
    image = out.reshape(height, width, n)
    if colour == 3:
        return palette[image[:, :, 0]]
    return np.repeat(image[:, :, :1], 3, axis=2) if n < 3 else image[:, :, :3]


def decode_netpbm(data: bytes) -> np.ndarray:
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[4]) > 255:
        raise ValueError("no 8-bit PGM or PPM")
    n = 3 if m[1] == b"P6" else 1
    width, height = int(m[2]), int(m[3])
    image = np.frombuffer(data, np.uint8, width * height * n, m.end()).reshape(height, width, n)
    return np.repeat(image, 3, axis=2) if n == 1 else image


@dataclass
class ImagePages:
    """PNG, JPEG and netpbm pictures, one page each. Other formats need a library: pass a provider that has one."""

    def pages(self, kind: str, content: bytes) -> list[np.ndarray]:
        if content[:4] == b"\x89PNG":
            return [decode_png(content)]
        if content[:2] == b"\xff\xd8":
            return [jpeg.decoded(content)]
        if content[:2] in (b"P5", b"P6"):
            return [decode_netpbm(content)]
        raise Unavailable(f"no renderer for {kind} files is configured")


@dataclass
class Fallback:
    """Models in order: one that fails is followed by a pause and the next, an empty answer by the next at once."""

    models: list[ModelProvider]
    pause: float = 0.5

    def complete(self, prompt: str) -> str:
        last: Exception | None = None
        for model in self.models:
            try:
                answer = model.complete(prompt)
                if answer and answer.strip():
                    return answer.strip()
            except Exception as error:  # noqa: BLE001  any failure of a service leads to the next
                last = error
                time.sleep(self.pause)
        raise Unavailable(f"no model answered; the last error was {last}")


def read_pages(files: DataFrame, provider: PageProvider) -> DataFrame:
    """(document_id, page, height, width, channels, pixels); a file that cannot be decoded, or for which no decoder is
    configured, has no page and does not stop the others."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                try:
                    images = provider.pages(row.kind, bytes(row.content))
                except Exception:  # noqa: BLE001  broken input, or no decoder
                    images = []
                if images:
                    yield pd.DataFrame([(row.document_id, i + 1, *m.shape, m.tobytes()) for i, m in enumerate(images)], columns=["document_id", "page", "height", "width", "channels", "pixels"])

    return files.select("document_id", "kind", "content").mapInPandas(run, "document_id string, page int, height int, width int, channels int, pixels binary")


WORD_COLUMNS = "page int, word_idx int, text string, confidence double, x int, y int, width int, height int, block_num int, par_num int, line_num int"


def read_words(files: DataFrame, provider: WordProvider) -> DataFrame:
    """Words of every page with confidences from 0 to 1."""
    names = [c.split()[0] for c in WORD_COLUMNS.split(", ")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                try:
                    words = provider.words(row.kind, bytes(row.content))
                except Exception:  # noqa: BLE001  a recogniser that fails
                    words = []
                if words:
                    out = pd.DataFrame(words)[names]
                    out["confidence"] = (out["confidence"] / 100).round(4)
                    out.insert(0, "document_id", row.document_id)
                    yield out

    return files.select("document_id", "kind", "content").mapInPandas(run, "document_id string, " + WORD_COLUMNS)


def ask(prompts: DataFrame, provider: ModelProvider, tries: int = 1, good=None, at_once: int = 1) -> DataFrame:
    """(document_id, raw) of prompts (document_id, prompt); asked again while good(raw) is false, up to tries times. A
    model that fails gives null. A task has at most `at_once` prompts under way, so a job at most that many times its cores."""

    def answer(prompt: str) -> str | None:
        raw = None
        for _ in range(tries):
            try:
                raw = provider.complete(prompt)
            except Exception:  # noqa: BLE001  a service that fails
                raw = None
            if raw is not None and (good is None or good(raw)):
                break
        return raw

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in pdfs:
                yield pd.DataFrame({"document_id": pdf["document_id"], "raw": list(pool.map(answer, pdf["prompt"]))})

    return prompts.select("document_id", "prompt").mapInPandas(run, "document_id string, raw string")
