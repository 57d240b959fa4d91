"""Pixel operators in numpy: thresholds, skew, rotation, smoothing, strokes, recompression error."""

from __future__ import annotations

import numpy as np

from paperloom.functions import constants as K
from paperloom.operators.jpeg import saved


def otsu(image: np.ndarray) -> int:
    """Threshold that parts grey values best."""
    counts = np.bincount(image.astype(np.uint8).ravel(), minlength=256).astype(float)
    total, weighted = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    low = np.divide(weighted, total, out=np.zeros(256), where=total > 0)
    rest = total[-1] - total
    high = np.divide(weighted[-1] - weighted, rest, out=np.zeros(256), where=rest > 0)
    return int(np.argmax(total * rest * (low - high) ** 2))


def dilated(ink: np.ndarray, width: int, height: int) -> np.ndarray:
    """Ink spread over a rectangle, half to the left and above."""
    for size, axis in ((height, 0), (width, 1)):
        n, before = ink.shape[axis], size // 2
        sums = np.concatenate((np.zeros_like(ink[:1], int) if axis == 0 else np.zeros_like(ink[:, :1], int), np.cumsum(ink, axis=axis)), axis=axis)
        at = np.arange(n)
        ink = np.take(sums, np.minimum(at - before + size, n), axis) > np.take(sums, np.maximum(at - before, 0), axis)
    return ink


def outline(ink: np.ndarray) -> np.ndarray:
    """Ink beside none, the border of the picture apart."""
    p = np.pad(ink, 1, mode="edge")
    return ink & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])


def line_angles(edge: np.ndarray, limit: float = 45.0, step: float = 0.25, least_votes: int = 80, share: float = 0.4) -> np.ndarray:
    """Angles of the straight lines of an outline, in degrees, falling to the right above 0: peaks of the votes of its pixels
    for lines by angle and distance that have at least `least_votes` and `share` of the most votes."""
    y, x = np.nonzero(edge)
    if len(y) < least_votes:
        return np.empty(0)
    angles = np.arange(-limit + step, limit, step)
    reach = sum(edge.shape)
    votes = np.zeros((len(angles), 2 * reach + 1), np.int32)
    for i, a in enumerate(np.radians(angles)):
        distance = np.rint(y * np.cos(a) - x * np.sin(a)).astype(int) + reach
        votes[i] = np.bincount(distance, minlength=votes.shape[1])
    # Few places have votes enough: only around these the largest is looked for.
    at, to = np.nonzero(votes >= max(least_votes, share * votes.max()))
    near = np.clip(at[:, None] + np.arange(-8, 9), 0, len(angles) - 1)[:, :, None], np.clip(to[:, None] + np.arange(-6, 7), 0, 2 * reach)[:, None, :]
    return angles[at[votes[at, to] == votes[near].max(axis=(1, 2))]]


def parts(ink: np.ndarray) -> list[np.ndarray]:
    """Pixels (y, x) at the row ends of each connected part (by side or corner), with its number of pixels last."""
    runs, above, parent = [], [], []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y, row in enumerate(ink):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        here = []
        for x0, x1 in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            i = len(parent)
            parent.append(i)
            runs.append((y, x0, x1))
            for j, a0, a1 in above:
                if a0 <= x1 and x0 <= a1:
                    parent[top(j)] = top(i)
            here.append((i, x0, x1))
        above = here
    found: dict[int, list] = {}
    for i, run in enumerate(runs):
        found.setdefault(top(i), []).append(run)
    return [np.array([(y, x) for y, x0, x1 in part for x in (x0, x1 - 1)] + [(sum(x1 - x0 for _, x0, x1 in part), 0)]) for part in found.values()]


def rectangle_angle(points: np.ndarray) -> float | None:
    """Angle of the longer side of the smallest rectangle around points (y, x); it lies along a side of their hull."""
    ordered, hull = sorted({(int(x), int(y)) for y, x in points}), []
    for side in (ordered, ordered[::-1]):
        chain = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        hull += chain[:-1]
    if len(hull) < 3:
        return None
    h, best = np.array(hull, float), None
    for dx, dy in np.roll(h, -1, axis=0) - h:
        a = np.arctan2(dy, dx)
        along, across = h @ (np.cos(a), np.sin(a)), h @ (-np.sin(a), np.cos(a))
        w, t = np.ptp(along), np.ptp(across)
        if best is None or w * t < best[0]:
            best = w * t, a if w >= t else a + np.pi / 2
    return float((np.degrees(best[1]) + 90) % 180 - 90)


def skew_angle(image: np.ndarray, limit: float = 45.0) -> float:
    """Degrees by which text falls to the right: the median of the angles of its lines, of letters joined to lines; else that
    of the rectangles around them; else 0."""
    ink = image <= otsu(image)
    if not ink.any() or ink.all():
        return 0.0
    lines = dilated(ink, *K.LINE_JOIN)
    angles = line_angles(outline(lines), limit)
    if not len(angles):
        found = [rectangle_angle(p[:-1]) for p in parts(lines) if p[-1][0] > K.LEAST_PART]
        angles = [a for a in found if a is not None and 0.1 < abs(a) < limit]
    return float(np.median(angles)) if len(angles) else 0.0


def rotated(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned about the centre against the clock, by cubic interpolation, with white outside; below 0.1 degrees as it is."""
    if abs(angle) < 0.1:
        return image
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    y, x = np.arange(h, dtype=np.float32)[:, None] - h // 2, np.arange(w, dtype=np.float32)[None, :] - w // 2
    sy, sx = s * x + c * y + h // 2, c * x - s * y + w // 2
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    padded = np.pad(image.reshape(h, w, -1), ((3, 3), (3, 3), (0, 0)), constant_values=255)
    # Where the 4 x 4 values around a place are one, this one comes out: weights sum up to 1.
    low, high = padded, padded
    for axis, n in ((0, h + 3), (1, w + 3)):
        four = lambda values, least, axis=axis, n=n: least(least(_from(values, 0, n, axis), _from(values, 1, n, axis)), least(_from(values, 2, n, axis), _from(values, 3, n, axis)))
        low, high = four(low, np.minimum), four(high, np.maximum)
    mixed = (low != high).any(axis=2)
    row, column = np.clip(y0 + 2, 0, h + 2), np.clip(x0 + 2, 0, w + 2)
    out = low[row, column]
    inside = (y0 + 2 >= 0) & (y0 + 2 <= h + 2) & (x0 + 2 >= 0) & (x0 + 2 <= w + 2)
    out[~inside] = 255
    at = np.flatnonzero(inside & mixed[row, column])
    y0, x0, ty, tx = y0.ravel()[at], x0.ravel()[at], (sy - y0).ravel()[at], (sx - x0).ravel()[at]
    values, total = padded.astype(np.float32), np.zeros((len(at), padded.shape[2]), np.float32)

    def weights(t):
        """Of the values at -1, 0, 1 and 2, for a place t behind that at 0."""
        near, far = lambda d: (1.25 * d - 2.25) * d * d + 1, lambda d: -0.75 * (((d - 5) * d + 8) * d - 4)
        return far(t + 1), near(t), near(1 - t), far(2 - t)

    across = weights(tx)
    for i, wy in enumerate(weights(ty)):
        for j, wx in enumerate(across):
            total += (wy * wx)[:, None] * values[y0 + i + 2, x0 + j + 2]
    out.reshape(h * w, -1)[at] = np.clip(np.rint(total), 0, 255).astype(np.uint8)
    return out.reshape(image.shape)


def _from(values: np.ndarray, start: int, n: int, axis: int) -> np.ndarray:
    """n rows or columns from start on."""
    return values[start : start + n] if axis == 0 else values[:, start : start + n]


def bilateral(image: np.ndarray, diameter: int = 9, colour: float = 75.0, space: float = 75.0) -> np.ndarray:
    """Smoothing that keeps edges: weights fall with distance and with the sum of absolute colour differences."""
    p = image.reshape(*image.shape[:2], -1).astype(np.int16)
    h, w, n = p.shape
    r = diameter // 2
    padded = np.pad(p, ((r, r), (r, r), (0, 0)), mode="reflect" if min(h, w) > r else "edge")
    by_colour = np.exp(-np.arange(255 * n + 1) ** 2 / (2 * colour * colour)).astype(np.float32)
    total, weight = np.zeros(p.shape, np.float32), np.zeros((h, w), np.float32)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx > r * r:
                continue
            q = padded[r + dy : r + dy + h, r + dx : r + dx + w]
            own = by_colour[np.abs(q - p).sum(axis=2, dtype=np.int16)] * np.float32(np.exp(-(dy * dy + dx * dx) / (2 * space * space)))
            total += own[..., None] * q
            weight += own
    return np.rint(total / weight[..., None]).astype(np.uint8).reshape(image.shape)


def distance_to_background(ink: np.ndarray) -> np.ndarray:
    """Distance of every ink pixel to the nearest that is none, in steps of 1 to a side, STEP_CORNER to a corner and STEP_KNIGHT to
    one side and two on: within 2 hundredths of the straight one. What is outside counts as ink. Rows go down, then up; ink may be a
    stack of pictures (… x height x width), which go together."""
    h, w = ink.shape[-2:]
    far, along = float(2 * (h + w)), np.arange(w, dtype=float)
    out = np.where(ink, far, 0.0)
    for lines in (out, out[..., ::-1, ::-1]):
        for y in range(h):
            row = lines[..., y, :]
            for back, dx, step in ((1, 0, 1.0), (1, -1, K.STEP_CORNER), (1, 1, K.STEP_CORNER), (1, -2, K.STEP_KNIGHT), (1, 2, K.STEP_KNIGHT), (2, -1, K.STEP_KNIGHT), (2, 1, K.STEP_KNIGHT)):
                if y >= back and abs(dx) < w:
                    here, there = slice(max(0, -dx), w - max(0, dx)), slice(max(0, dx), w - max(0, -dx))
                    np.minimum(row[..., here], lines[..., y - back, there] + step, out=row[..., here])
            row[...] = np.minimum.accumulate(row - along, axis=-1) + along
    return out


KNOWN = 2000  #: pictures of words whose stroke is remembered


def stroke_widths(images: list[np.ndarray], known: dict | None = None) -> list[float]:
    """Of each picture twice the mean distance of its ink to the background; 0 without ink or without background. Pictures of about
    one size go together, filled up with ink, which changes no distance; of equal ones the first is measured. known holds, between
    calls, the widths of up to KNOWN pictures."""
    known = {} if known is None else known
    keys = [(image.shape, image.dtype.str, image.tobytes()) for image in images]
    fresh = {key: image for key, image in zip(keys, images, strict=True) if key not in known}
    found = {key: known[key] for key in keys if key in known} | dict(zip(fresh, _stroke_widths(list(fresh.values())), strict=True))
    if len(known) + len(fresh) > KNOWN:
        known.clear()
    known.update(list(zip(fresh, map(found.get, fresh), strict=True))[:KNOWN])
    return [found[key] for key in keys]


def _stroke_widths(images: list[np.ndarray]) -> list[float]:
    out, alike = [0.0] * len(images), {}
    for i, image in enumerate(images):
        ink = image <= otsu(image) if image.size else np.zeros((0, 0), bool)
        if ink.any() and not ink.all():
            alike.setdefault(tuple(n.bit_length() for n in ink.shape), []).append((i, ink))
    for group in alike.values():
        h, w = (max(ink.shape[axis] for _, ink in group) for axis in (0, 1))
        stack = np.ones((len(group), h, w), bool)
        for own, (_, ink) in zip(stack, group, strict=True):
            own[: ink.shape[0], : ink.shape[1]] = ink
        for far, (i, ink) in zip(distance_to_background(stack), group, strict=True):
            out[i] = float(2 * far[: ink.shape[0], : ink.shape[1]][ink].mean())
    return out


def stroke_width(image: np.ndarray) -> float:
    return stroke_widths([image])[0]


def recompression_error(rgb: np.ndarray, quality: int = K.RESAVE_QUALITY) -> tuple[float, float]:
    """Mean difference of an RGB or grey picture to a copy saved as JPEG, over pixels and colours, and the percentage of pixels whose mean difference over
    colours is above RESAVE_LEVEL; no picture gives 0."""
    if rgb.size == 0:
        return 0.0, 0.0
    plane, place, colours = saved(rgb, quality)
    grey = rgb if rgb.ndim == 2 else rgb[:, :, 0]
    diff = (np.maximum(grey, plane) - np.minimum(grey, plane)).astype(float)
    if place is not None:
        diff[place] = np.abs(rgb[place].astype(np.int16) - colours).sum(axis=2) / 3
    return float(diff.mean()), float((diff > K.RESAVE_LEVEL).mean() * 100)


def cropped(image: np.ndarray, rectangle: tuple[int, int, int, int] | None) -> np.ndarray | None:
    """Part of an image; rectangle is left, top, right, bottom."""
    if rectangle is None:
        return None
    left, top, right, bottom = rectangle
    return image[top:bottom, left:right]


COLOURS = {"green": (0, 160, 0), "amber": (255, 165, 0), "red": (220, 0, 0)}


def with_boxes(image: np.ndarray, boxes: list[tuple[int, int, int, int, str]], thickness: int = 2) -> np.ndarray:
    """A copy with frames around boxes (x, y, width, height, colour)."""
    out = image.copy()
    for x, y, w, h, colour in boxes:
        outer, inner = (slice(max(0, y), y + h), slice(max(0, x), x + w)), (slice(max(0, y + thickness), max(0, y + h - thickness)), slice(max(0, x + thickness), max(0, x + w - thickness)))
        keep = out[inner].copy()
        out[outer] = COLOURS[colour]
        out[inner] = keep
    return out
