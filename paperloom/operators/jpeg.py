"""The parts of JPEG that pictures of papers need: what a saving loses, and a decoder of baseline files.

recompressed() is a saving and reading back without the entropy coding in between, which loses nothing: YCbCr, chroma of half
the size, cosine transform of 8 x 8 blocks, quantisation, and the way back. decoded() reads 8-bit Huffman files in sequence, with
any sampling factors and restart markers; progressive, arithmetic and 12-bit files are Unsupported.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the standard: quantisation of brightness and colour at quality 50, row by row.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of a block in the order of its diagonals, up and down in turn.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
COSINES = np.array([[(1 if u else np.sqrt(0.5)) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class Unsupported(ValueError):
    """A kind of file that is not read here."""


def quantisation(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base).reshape(8, 8) * scale + 50) // 100, 1, 255)


def to_ycc(rgb: np.ndarray) -> np.ndarray:
    weights = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
    return np.clip(np.rint(rgb.astype(float) @ weights.T + (0, 128, 128)), 0, 255)


def to_rgb(ycc: np.ndarray) -> np.ndarray:
    weights = np.array([[1, 0, 1.402], [1, -0.344136286, -0.714136286], [1, 1.772, 0]])
    return np.clip(np.rint((ycc - (0, 128, 128)) @ weights.T), 0, 255).astype(np.uint8)


def halved(plane: np.ndarray) -> np.ndarray:
    """Means of 2 x 2; halves are rounded down and up in turn along a row."""
    sums = plane[0::2, 0::2] + plane[1::2, 0::2] + plane[0::2, 1::2] + plane[1::2, 1::2]
    return (sums + 1 + np.arange(sums.shape[1]) % 2) // 4


def doubled(plane: np.ndarray, rows: bool = True) -> np.ndarray:
    """Twice the width, and with `rows` the height: three parts of the nearer value, one of the next; edges repeat."""
    scale = 4
    if rows:
        tall, scale = np.pad(plane, ((1, 1), (0, 0)), mode="edge"), 16
        out = np.empty((2 * plane.shape[0], plane.shape[1]))
        out[0::2], out[1::2] = 3 * plane + tall[:-2], 3 * plane + tall[2:]
        plane = out
    wide = np.pad(plane, ((0, 0), (1, 1)), mode="edge")
    out = np.empty((plane.shape[0], 2 * plane.shape[1]))
    half = scale // 2
    out[:, 0::2], out[:, 1::2] = (3 * plane + wide[:, :-2] + (half if rows else 1)) // scale, (3 * plane + wide[:, 2:] + (half - 1 if rows else 2)) // scale
    return out


def blocks_of(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def from_coefficients(coefficients: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Plane of quantised coefficients (rows of blocks x blocks x 8 x 8)."""
    values = COSINES.T @ (coefficients * table) @ COSINES
    h, w = coefficients.shape[:2]
    return np.clip(np.rint(values.swapaxes(1, 2).reshape(8 * h, 8 * w) + 128), 0, 255)


def through(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What is left of a plane of bytes whose sides are multiples of 8. Blocks do not touch each other: of equal ones the first is
    worked out."""
    h, w = plane.shape
    rows = np.ascontiguousarray(blocks_of(plane)).reshape(-1, 64)
    first, of = _distinct(rows)
    blocks = rows[first].reshape(1, -1, 8, 8).astype(float)
    left = from_coefficients(np.rint(COSINES @ (blocks - 128) @ COSINES.T / table), table).astype(np.uint8)
    return blocks_of(left)[0][of].reshape(h // 8, w // 8, 8, 8).swapaxes(1, 2).reshape(h, w)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row (64 bytes) is met first, and for every row which of these it equals."""
    eights = rows.view(np.uint64)
    flat = (eights == rows[:, :1] * np.uint64(0x0101010101010101)).all(axis=1)
    first, of = np.empty(0, np.int64), np.empty(len(rows), np.int64)
    for one, key in ((flat, rows[:, 0]), (~flat, rows.view("V64")[:, 0])):
        at = np.flatnonzero(one)
        if len(at):
            _, where, which = np.unique(key[at], return_index=True, return_inverse=True)
            of[at], first = which + len(first), np.concatenate((first, at[where]))
    return first, of


def _coloured(rgb: np.ndarray) -> tuple[slice, slice] | None:
    """Rows and columns around all pixels that are not grey, whole blocks of 16 with one more on each side; None without any."""
    other = (rgb[:, :, 0] != rgb[:, :, 1]) | (rgb[:, :, 1] != rgb[:, :, 2])
    y, x = np.flatnonzero(other.any(axis=1)), np.flatnonzero(other.any(axis=0))
    if not len(y):
        return None
    return tuple(slice(max(0, at[0] // 16 * 16 - 16), at[-1] // 16 * 16 + 32) for at in (y, x))


def in_colour(grey: np.ndarray) -> np.ndarray:
    out = np.empty((*grey.shape, 3), np.uint8)
    out[:] = grey[:, :, None]
    return out


def saved(rgb: np.ndarray, quality: int) -> tuple[np.ndarray, tuple[slice, slice] | None, np.ndarray | None]:
    """Of an RGB or grey image saved and read again: its brightness, and where there are colours their place and all that is there.
    Grey stays grey, and colours reach no further than the next block: they are worked out around those that there are."""
    h, w = rgb.shape[:2]
    grey = np.pad(rgb if rgb.ndim == 2 else rgb[:, :, 0], ((0, -h % 16), (0, -w % 16)), mode="edge")
    place = _coloured(rgb) if rgb.ndim == 3 else None
    if place is None:
        return through(grey, quantisation(BRIGHTNESS, quality))[:h, :w], None, None
    part, colour = rgb[place], quantisation(COLOUR, quality)
    (top, left), (high, wide) = (s.start for s in place), part.shape[:2]
    ycc = to_ycc(np.pad(part, ((0, -high % 16), (0, -wide % 16), (0, 0)), mode="edge"))
    grey[top : top + ycc.shape[0], left : left + ycc.shape[1]] = ycc[:, :, 0]
    plane = through(grey, quantisation(BRIGHTNESS, quality))[:h, :w]
    planes = [plane[place]]
    for c in (1, 2):
        # Colours outside the picture are not read back: the edge of the picture repeats.
        small = through(halved(ycc[:, :, c]).astype(np.uint8), colour)[: -(-high // 2), : -(-wide // 2)].astype(float)
        planes.append(doubled(small)[:high, :wide])
    return plane, place, to_rgb(np.stack(planes, axis=2))


def recompressed(rgb: np.ndarray, quality: int = 90) -> np.ndarray:
    """An RGB image saved with this quality and colours of half the size, and read again."""
    plane, place, colours = saved(rgb, quality)
    out = in_colour(plane)
    if place is not None:
        out[place] = colours
    return out


# -- reading files -----------------------------------------------------------------------------------------------------


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits the length of the code that they begin with, times 256, and its symbol; 0 where there is none."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at += n
        code <<= 1
    return table.tolist()


class _Component:
    def __init__(self, id: int, across: int, down: int, table: int):
        self.id, self.across, self.down, self.table = id, across, down, table


def _segments(scan: bytes) -> list[bytes]:
    """Entropy-coded parts of a scan between restart markers, without stuffed zeros."""
    parts, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            parts.append(scan[start:at])
            start = at + 2
        at += 2
    parts.append(scan[start:])
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def _scan_end(data: bytes, at: int) -> int:
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2
    raise ValueError("a scan without an end")


def _decode_segment(stream: bytes, blocks: list[tuple]) -> None:
    """Blocks in order, each with the coefficients to write to, its place there, its predictor and its two tables."""
    size, stream = len(stream), stream + bytes(64)
    acc = bits = pos = 0
    predicted: dict[int, int] = {}
    for out, base, key, dc, ac in blocks:
        k = 0
        while k < 64:
            if bits < 32:
                acc = (acc & ((1 << bits) - 1)) << 32 | int.from_bytes(stream[pos : pos + 4], "big")
                pos += 4
                bits += 32
                if pos > size + 16:
                    raise ValueError("a scan that ends too early")
            entry = (ac if k else dc)[acc >> (bits - 16) & 0xFFFF]
            if not entry:
                raise ValueError("no such code")
            bits -= entry >> 8
            length = entry & 15
            value = 0
            if length:
                bits -= length
                value = acc >> bits & ((1 << length) - 1)
                if value < 1 << (length - 1):
                    value -= (1 << length) - 1
            if k == 0:
                predicted[key] = out[base] = predicted.get(key, 0) + value
            elif length:
                k += (entry & 255) >> 4
                if k > 63:
                    raise ValueError("a block that is too long")
                out[base + ZIGZAG[k]] = value
            elif entry & 255 == 0xF0:
                k += 15
            else:
                break
            k += 1


def decoded(data: bytes) -> np.ndarray:
    """RGB pixels of a baseline file; ValueError where it is broken or Unsupported."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, tables, codes, parts, restart, adobe, done = 2, {}, {}, [], 0, None, set()
    width = height = 0
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if data[at : at + 2] == b"\xff\xd9":
            break
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                values = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(int)
                tables[name] = np.zeros(64, int)
                tables[name][ZIGZAG] = values
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or body[5] not in (1, 3):
                raise Unsupported("other than 8 bits, or other than one or three components")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [_Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            if not width or not height or any(not 1 <= x <= 4 for p in parts for x in (p.across, p.down)):
                raise ValueError("no size")
            most_across, most_down = max(p.across for p in parts), max(p.down for p in parts)
            columns, rows = -(-width // (8 * most_across)), -(-height // (8 * most_down))
            for p in parts:
                p.wide, p.high = -(-width * p.across // most_across), -(-height * p.down // most_down)
                p.line = columns * p.across
                p.values = [0] * (64 * p.line * rows * p.down)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Unsupported("progressive, lossless or arithmetic")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            chosen = [(next(p for p in parts if p.id == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            end = _scan_end(data, at)
            if len(chosen) == 1:
                p, use = chosen[0]
                line = -(-p.wide // 8)
                units = [(p.values, 64 * (y * p.line + x), p.id, codes[use >> 4], codes[16 | use & 15]) for y in range(-(-p.high // 8)) for x in range(line)]
                per_unit = 1
            else:
                units = [(p.values, 64 * ((my * p.down + y) * p.line + mx * p.across + x), p.id, codes[use >> 4], codes[16 | use & 15]) for my in range(rows) for mx in range(columns) for p, use in chosen for y in range(p.down) for x in range(p.across)]
                per_unit = sum(p.across * p.down for p, _ in chosen)
            step = per_unit * restart or len(units)
            segments = _segments(data[at:end])
            if len(segments) < -(-len(units) // step):
                raise ValueError("restart markers are missing")
            for i in range(-(-len(units) // step)):
                _decode_segment(segments[i], units[i * step : (i + 1) * step])
            done |= {p.id for p, _ in chosen}
            at = end
    if not parts or len(done) < len(parts):
        raise ValueError("no picture")
    planes = []
    for p in parts:
        plane = from_coefficients(np.array(p.values).reshape(-1, p.line, 8, 8), tables[p.table].reshape(8, 8))[: p.high, : p.wide]
        across, down = most_across // p.across, most_down // p.down
        if across == 2 and down <= 2:
            plane = doubled(plane, down == 2)
        elif (across, down) != (1, 1):
            plane = np.repeat(np.repeat(plane, down, axis=0), across, axis=1)
        planes.append(plane[:height, :width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    image = np.stack(planes, axis=2)
    return image.astype(np.uint8) if adobe == 0 else to_rgb(image)
