"""What a PDF says of itself: its pages, times and software, from its objects.

The newest cross-reference comes first and leads to older ones; tables and compressed streams of references are read, and objects
in compressed streams. Where the references are broken, the file is searched for objects, and the last of each number counts.
Encrypted files say how many pages they have, and nothing else. Anything that cannot be read is left out."""

from __future__ import annotations

import re
import zlib
from typing import Any

WHITE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
DEEPEST, LARGEST = 60, 64 << 20  #: nested values; bytes of a decompressed stream


class Name(str):
    """A name of a PDF, without its slash."""


class Reference(int):
    """The number of an object that is meant."""


class Stream:
    def __init__(self, about: dict, data: bytes):
        self.about, self.data = about, data


BLANKS = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*(?:[\r\n]|\Z))*")
TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_WS, _WORD = rb"[\x00\t\n\x0c\r ]", rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
_SKIP = rb"(?>(?:" + _WS + rb"+|%[^\r\n]*(?:[\r\n]|\Z))*)"
#: What most values begin with or are: a dictionary, a list, a name, a number, a reference.
NEXT = re.compile(_SKIP + rb"(?:(<<)|(\[)|/" + _SKIP + rb"(" + _WORD + rb"*)|(\d+)(?!" + _WORD + rb")(" + _WS + rb"+\d+" + _WS + rb"+R(?!" + _WORD + rb"))?)")
#: The end of a dictionary, or its next key.
KEY = re.compile(_SKIP + rb"(?:(>>)|/" + _SKIP + rb"(" + _WORD + rb"*))")
PLAIN = re.compile(rb"[^\\()]*")
OCTAL = re.compile(rb"[0-7]{1,3}")


def _name(word: bytes) -> Name:
    return Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), word) if b"#" in word else word).decode("latin-1"))


class Reader:
    """Values of a byte string, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = BLANKS.match(self.data, self.at).end()

    def token(self) -> bytes:
        found = TOKEN.match(self.data, BLANKS.match(self.data, self.at).end())
        self.at = found.end()
        return found[0]

    def text(self) -> bytes:
        """A string in brackets, which may nest, with its escapes undone."""
        out, depth = bytearray(), 1
        self.at += 1
        while self.at < len(self.data):
            plain = PLAIN.match(self.data, self.at)
            out += plain[0]
            self.at = plain.end()
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                octal = OCTAL.match(self.data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                c = self.data[self.at : self.at + 1]
                self.at += 1
                if c == b"\r" and self.data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                if c not in b"\r\n":
                    out += ESCAPES.get(c, c)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                return bytes(out)
            out += c
        raise ValueError("a string without an end")

    def value(self, depth: int = 0) -> Any:
        if depth > DEEPEST:
            raise ValueError("nested too deep")
        m = NEXT.match(self.data, self.at)
        kind = m.lastindex if m else 0
        if kind:
            self.at = m.end()
        if kind == 1:
            out = {}
            while True:
                m = KEY.match(self.data, self.at)
                if m is None:
                    raise ValueError("no name where a key should be")
                self.at = m.end()
                if m.lastindex == 1:
                    return out
                out[str(_name(m[2]))] = self.value(depth + 1)
        if kind == 2:
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if kind == 3:
            return _name(m[3])
        if kind:
            return Reference(int(m[4])) if kind == 5 else int(m[4])
        self.skip()
        one = self.data[self.at : self.at + 1]
        if one == b"(":
            return self.text()
        if one == b"<":
            end = self.data.index(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        word = self.token()
        if word in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False}.get(word)
        return float(word)


def unpredicted(data: bytes, columns: int) -> bytes:
    """Rows with a PNG filter before each, as they were."""
    out, before = bytearray(), bytes(columns)
    for at in range(0, len(data) - columns, columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(columns):
            left, up, corner = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            if kind == 4:
                p = left + up - corner
                guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                guess = (0, left, up, (left + up) // 2)[kind]
            row[i] = (row[i] + guess) & 255
        out += row
        before = bytes(row)
    return bytes(out)


class Document:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.held, self.opened = data, {}, {}, {}, {}
        try:
            self._references()
        except (ValueError, IndexError, KeyError, TypeError, zlib.error):
            self.places, self.trailer = {}, {}
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self._searched()

    def get(self, value: Any) -> Any:
        """What a value means: the object, if it is a reference."""
        for _ in range(DEEPEST):
            if not isinstance(value, Reference):
                return value
            value = self._object(int(value))
        return None

    def _object(self, number: int) -> Any:
        if number not in self.held:
            self.held[number] = None  # an object that needs itself is none
            place = self.places.get(number)
            try:
                if place is not None:
                    self.held[number] = self._inside(*place[1:]) if place[0] else self._read(place[1], number)
            except (ValueError, IndexError, KeyError, TypeError, zlib.error):
                self.held[number] = None
        return self.held[number]

    def _read(self, at: int, number: int | None = None) -> Any:
        reader = Reader(self.data, at)
        found, _, word = int(reader.token()), reader.token(), reader.token()
        if word != b"obj" or number not in (None, found):
            raise ValueError("another object than the one that should be there")
        value = reader.value()
        reader.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", reader.at):
            start = reader.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            size = self.get(value.get("Length"))
            end = start + size if isinstance(size, int) and self.data[start + size : start + size + 20].lstrip().startswith(b"endstream") else self.data.index(b"endstream", start)
            return Stream(value, self.data[start:end])
        return value

    def content(self, stream: Stream) -> bytes:
        data, about = stream.data, stream.about
        kinds, options = self.get(about.get("Filter")) or [], self.get(about.get("DecodeParms")) or {}
        for kind in [kinds] if isinstance(kinds, Name) else kinds:
            if kind != "FlateDecode":
                raise ValueError("another filter than Flate")
            data = zlib.decompressobj().decompress(data, LARGEST)
        options = options[0] if isinstance(options, list) else options
        if isinstance(options, dict) and options.get("Predictor", 1) >= 10:
            data = unpredicted(data, self.get(options.get("Columns", 1)) * (self.get(options.get("Colors", 1)) or 1))
        return data

    def _inside(self, holder: int, index: int) -> Any:
        """An object in a stream of objects."""
        stream = self._object(holder)
        if not isinstance(stream, Stream):
            raise ValueError("no stream of objects where one should be")
        if self.opened.get(holder, (None,))[0] is not stream:
            # Decompressed and its heads read once, not for every object; the last stream only, as it may be large.
            data = self.content(stream)
            reader = Reader(data)
            heads = [int(reader.token()) for _ in range(2 * self.get(stream.about["N"]))]
            self.opened = {holder: (stream, data, heads)}
        _, data, heads = self.opened[holder]
        return Reader(data, self.get(stream.about["First"]) + heads[2 * index + 1]).value()

    def _references(self) -> None:
        marks = list(re.finditer(rb"startxref\s+(\d+)", self.data))
        todo, seen = [int(marks[-1][1])] if marks else [], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            about = self._table(at) if self.data[at : at + 200].lstrip(WHITE).startswith(b"xref") else self._stream(at)
            for key, value in about.items():
                self.trailer.setdefault(key, value)
            # Streams beside a table come before older tables.
            todo += [about[k] for k in ("Prev", "XRefStm") if isinstance(about.get(k), int)]

    def _table(self, at: int) -> dict:
        reader = Reader(self.data, at)
        reader.token()
        while True:
            word = reader.token()
            if word == b"trailer":
                return reader.value()
            first, n = int(word), int(reader.token())
            for number in range(first, first + n):
                offset, _, kind = int(reader.token()), reader.token(), reader.token()
                self.places.setdefault(number, (0, offset) if kind == b"n" else None)

    def _stream(self, at: int) -> dict:
        stream = self._read(at)
        about, data = stream.about, self.content(stream)
        widths = about["W"]
        index = about.get("Index") or [0, about["Size"]]
        numbers = (k for first, n in zip(index[::2], index[1::2], strict=True) for k in range(first, first + n))
        step, first, second = sum(widths), sum(widths[:1]), sum(widths[:2])
        for number, row in zip(numbers, range(0, len(data) - step + 1, step), strict=False):
            kind = int.from_bytes(data[row : row + first], "big") if widths[0] else 1
            a, b = int.from_bytes(data[row + first : row + second], "big"), int.from_bytes(data[row + second : row + second + widths[2]], "big")
            self.places.setdefault(number, (0, a) if kind == 1 else (1, a, b) if kind == 2 else None)
        return about

    def _searched(self) -> None:
        """Objects where they are found, without references to help."""
        self.held = {}
        self.places = {int(m[1]): (0, m.start(1)) for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b", self.data)}
        for number in list(self.places):
            held = self._object(number)
            if isinstance(held, Stream) and held.about.get("Type") == "ObjStm":
                try:
                    reader = Reader(self.content(held))
                    for i in range(self.get(held.about["N"])):
                        self.places.setdefault(int(reader.token()), (1, number, i))
                        reader.token()
                except (ValueError, KeyError, TypeError, zlib.error):
                    continue
            if isinstance(held, Stream) and held.about.get("Type") == "XRef":
                self.trailer |= held.about
        self.held = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= Reader(self.data, m.end()).value()
            except (ValueError, IndexError, TypeError):
                continue
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for number in self.places:
                if isinstance(held := self._object(number), dict) and held.get("Type") == "Catalog":
                    self.trailer["Root"] = Reference(number)

    def pages(self) -> int:
        """Leaves of the tree of pages; what it says of their number if it has none."""
        root = self.get(self.trailer.get("Root"))
        top = self.get(root.get("Pages")) if isinstance(root, dict) else None
        todo, seen, leaves = [top], set(), 0
        while todo:
            node = self.get(todo.pop())
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += kids
            else:
                leaves += 1
        count = self.get(top.get("Count")) if isinstance(top, dict) else None
        return leaves or (count if isinstance(count, int) else 0)

    def said(self, key: str) -> str | None:
        info = self.get(self.trailer.get("Info"))
        value = self.get(info.get(key)) if isinstance(info, dict) and "Encrypt" not in self.trailer else None
        if not isinstance(value, bytes) or not value:
            return None
        if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
            return value.decode("utf-16", "replace") or None
        return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")
