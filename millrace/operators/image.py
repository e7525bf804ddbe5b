"""Raster images before recognition, in numpy: rows are never exploded to pixels."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np


def _round(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of (h, w, 3 or more), truncated."""
    x = rgb.astype(np.int64)
    return ((299 * x[..., 0] + 587 * x[..., 1] + 114 * x[..., 2]) // 1000).astype(np.uint8)


def stretch(img: np.ndarray) -> np.ndarray:
    lo, hi = int(img.min()), int(img.max())
    return img if hi - lo < 40 else _round((img.astype(float) - lo) * (255 / (hi - lo))).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """Threshold of the largest variance between classes, of equal ones the last; 128 for a flat image."""
    counts = np.bincount(img.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * np.arange(256))
    with np.errstate(all="ignore"):
        between = below * (total - below) * (sums / below - (sums[-1] - sums) / (total - below)) ** 2
    between[(below == 0) | (below == total)] = -1
    return 128 if between.max() < 0 else int(255 - np.argmax(between[::-1]))


def binarize(img: np.ndarray, threshold: int) -> np.ndarray:
    return (img < threshold).astype(np.uint8)


def ink_box(ink: np.ndarray) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1 around all ink with a margin of 2 % of the short side, 4 at least; None without ink."""
    ys, xs = np.nonzero(ink)
    if not len(xs):
        return None
    h, w = ink.shape
    m = max(4, int(math.floor(0.02 * min(w, h) + 0.5)))
    return max(0, int(xs.min()) - m), max(0, int(ys.min()) - m), min(w, int(xs.max()) + 1 + m), min(h, int(ys.max()) + 1 + m)


def median3(img: np.ndarray) -> np.ndarray:
    """3 x 3 median; at edges of what is there, the upper of two."""
    h, w = img.shape
    padded = np.full((h + 2, w + 2), 1000, np.int64)
    padded[1:-1, 1:-1] = img
    stack = np.sort(np.stack([padded[y : y + h, x : x + w] for y in range(3) for x in range(3)]), axis=0)
    middle = (stack < 1000).sum(axis=0) // 2
    return np.take_along_axis(stack, middle[None], 0)[0].astype(np.uint8)


def rotate(img: np.ndarray, radians: float, fill: int) -> np.ndarray:
    h, w = img.shape
    cos, sin, cx, cy = math.cos(radians), math.sin(radians), (w - 1) / 2, (h - 1) / 2
    dy, dx = np.mgrid[0:h, 0:w].astype(float) - np.array([cy, cx])[:, None, None]
    sx, sy = _round(cx + dx * cos - dy * sin).astype(int), _round(cy + dx * sin + dy * cos).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(img, fill)
    out[inside] = img[sy[inside], sx[inside]]
    return out


def skew(ink: np.ndarray, most: float = 10, step: float = 0.5) -> float:
    """Angle in degrees whose rotation makes row sums vary most, of equal ones the lowest."""
    angles = np.arange(-most, most + step / 2, step)
    scores = []
    for a in angles:
        rows = rotate(ink, math.radians(a), 0).sum(axis=1, dtype=float)
        scores.append(((rows - rows.mean()) ** 2).sum())
    return float(angles[int(np.argmax(scores))])


def preprocess(rgb: np.ndarray) -> np.ndarray:
    """An image made ready for recognition; those under 8 pixels either way stay as they are."""
    if min(rgb.shape[:2]) < 8:
        return rgb[..., :3]
    img = stretch(gray(rgb))
    ink = binarize(img, otsu(img))
    if ink.any():
        angle = skew(ink)
        if angle:
            img = rotate(img, math.radians(angle), 255)
    return np.repeat(median3(img)[..., None], 3, axis=2)


def resize(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear to (h, w, 3) of 0..1, samples at pixel centres."""
    src = rgb[..., :3].astype(float) / 255
    sh, sw = src.shape[:2]
    x = np.clip((np.arange(w) + 0.5) * sw / w - 0.5, 0, sw - 1)
    y = np.clip((np.arange(h) + 0.5) * sh / h - 0.5, 0, sh - 1)
    x0, y0 = x.astype(int), y.astype(int)
    x1, y1 = np.minimum(x0 + 1, sw - 1), np.minimum(y0 + 1, sh - 1)
    fx, fy = (x - x0)[None, :, None], (y - y0)[:, None, None]
    top = src[y0][:, x0] * (1 - fx) + src[y0][:, x1] * fx
    low = src[y1][:, x0] * (1 - fx) + src[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def to_tensor(hwc: np.ndarray, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Normalized, channels first."""
    return ((hwc - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def components(prob: np.ndarray, threshold: float = 0.3) -> list[tuple[int, int, int, int]]:
    """Boxes of 8-connected regions above the threshold, in scan order, single pixels dropped. Runs of each row are
    joined to the runs of the row above that they touch."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[int] = []
    for y, row in enumerate(prob > threshold):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            parent.append(k)
            now.append(k)
            for other in above:
                if runs[other][1] <= b and runs[other][2] >= a:
                    r, s = root(other), root(k)
                    parent[max(r, s)] = min(r, s)
        above = now
    boxes: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(runs):
        box = boxes.setdefault(root(k), [a, y, b, y + 1])
        box[:] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1)]
    return [tuple(b) for b in boxes.values() if b[2] - b[0] > 1 or b[3] - b[1] > 1]


def split_wide(img: np.ndarray, most: int = 480) -> list[tuple[int, int]]:
    """Column spans of a line's image cut at word gaps, so that words of a span are ``most`` wide in all."""
    w = img.shape[1]
    dark = img[..., :3].min(axis=(0, 2)) <= 200
    edges = np.flatnonzero(np.diff(np.concatenate([[0], dark.astype(np.int8), [0]])))
    blobs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    if w <= most or not blobs:
        return [(0, w)]
    gaps = [b[0] - a[1] for a, b in zip(blobs, blobs[1:], strict=False)]
    limit = max(8, 2.5 * sorted(gaps)[len(gaps) // 2]) if gaps else 8
    found = [list(blobs[0])]
    for gap, blob in zip(gaps, blobs[1:], strict=True):
        if gap > limit:
            found.append(list(blob))
        else:
            found[-1][1] = blob[1]
    spans: list[tuple[int, int]] = []
    held, width = [], 0
    for word in found:
        if held and width + word[1] - word[0] > most:
            spans.append((held[0][0], held[-1][1]))
            held, width = [], 0
        held.append(word)
        width += word[1] - word[0]
    spans.append((held[0][0], held[-1][1]))
    return spans


def ctc(logits: np.ndarray, letters: list[str]) -> tuple[str, float]:
    """Text and mean probability of (time, class) logits; class 0 is the blank, repeats collapse."""
    if not logits.size:
        return "", 0.0
    best = logits.argmax(axis=1)
    p = 1 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
    new = (best != 0) & (best != np.concatenate([[-1], best[:-1]]))
    out = [(letters[k - 1], x) for k, x in zip(best[new].tolist(), p[new].tolist(), strict=True) if k - 1 < len(letters) and letters[k - 1]]
    return "".join(c for c, _ in out), float(np.mean([x for _, x in out])) if out else 0.0


def decode_image(data: bytes) -> np.ndarray:
    """(h, w, 3) of a BMP (24 or 32 bits) or PNG (8 bits, not interlaced); ValueError of anything else."""
    if data[:2] == b"BM":
        at, = struct.unpack_from("<I", data, 10)
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        if bits not in (24, 32) or packing not in (0, 3):
            raise ValueError("BMP of an unsupported kind")
        stride = (w * bits // 8 + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
        return (rows[::-1] if h > 0 else rows)[..., 2::-1]
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no decoder for this image")
    at, packed, palette = 8, b"", None
    while at + 8 <= len(data):
        size, = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if depth != 8 or interlace or color not in (0, 2, 3, 4, 6):
        raise ValueError("PNG of an unsupported kind")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.int64)
    before = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 0:
            now = line
        elif kind == 2:
            now = (line + before) & 255
        else:
            now = line.copy()
            for x in range(w * channels):
                a = now[x - channels] if x >= channels else 0
                b, c = before[x], before[x - channels] if x >= channels else 0
                guess = a + b - c
                best = min(((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c)))[2]
                now[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else best)) & 255
        out[y] = before = now
    img = out.astype(np.uint8).reshape(h, w, channels)
    if color == 3:
        return palette[img[..., 0]]
    return np.repeat(img[..., :1], 3, axis=2) if color in (0, 4) else img[..., :3]
