"""Pixels of PNG images without an imaging library: crop, sharpen, upscale, rotate, and the degradations they undo.

Images are bytes of 8-bit PNGs that aren't interlaced; anything else gives null pixels and an error. All work is numpy
on one image at a time, in Arrow batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS = 64_000_000


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels of a PNG; palettes are resolved to three channels."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ValueError("no header")
    w, h, depth, color, _, _, interlace = head
    if depth != 8 or interlace or color not in _CHANNELS or w * h > MOST_PIXELS:
        raise ValueError("unsupported PNG")
    c = _CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
    if len(raw) != h * (1 + w * c):
        raise ValueError("cut PNG")
    rows = raw.reshape(h, 1 + w * c)
    out = np.zeros((h, w, c), dtype=np.uint8)
    before = np.zeros((w, c), dtype=np.uint8)
    for y in range(h):
        line, kind = rows[y, 1:].reshape(w, c), rows[y, 0]
        if kind == 1:
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            line = _sequential(line.astype(np.int64), before.astype(np.int64), kind == 4)
        out[y] = before = line
    return palette[out[:, :, 0]] if color == 3 and palette is not None else out


def _sequential(line: np.ndarray, up: np.ndarray, paeth: bool) -> np.ndarray:
    """A row whose bytes depend on the ones before them: the average and the Paeth filters."""
    left = corner = np.zeros(line.shape[1], dtype=np.int64)
    out = np.empty(line.shape, dtype=np.uint8)
    for x in range(len(line)):
        if paeth:
            guess = left + up[x] - corner
            a, b, c = abs(guess - left), abs(guess - up[x]), abs(guess - corner)
            base = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
        else:
            base = (left + up[x]) // 2
        left, corner = (line[x] + base) & 255, up[x]
        out[x] = left
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x 1 to 4 channels."""
    h, w, c = pixels.shape
    color = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    raw = np.zeros((h, 1 + w * c), dtype=np.uint8)
    raw[:, 1:] = pixels.reshape(h, w * c)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _weights(n: int, m: int) -> np.ndarray:
    """Rows of weights that resample n points to m by a Lanczos window of three lobes, widened when the size shrinks."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    d = (np.arange(n)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(p: np.ndarray, width: int, height: int) -> np.ndarray:
    x = np.tensordot(_weights(p.shape[0], height), p.astype(np.float64), axes=(1, 0))
    return _bytes(np.tensordot(_weights(p.shape[1], width), x, axes=(1, 1)).transpose(1, 0, 2))


def upscale(p: np.ndarray, scale: float) -> np.ndarray:
    s = min(4.0, max(1.1, scale))
    return resize(p, max(1, round(p.shape[1] * s)), max(1, round(p.shape[0] * s)))


def blur(p: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur; edges are repeated."""
    n = max(1, int(np.ceil(3 * radius)))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / max(radius, 1e-9)) ** 2)
    k /= k.sum()
    x = p.astype(np.float64)
    for axis in (0, 1):
        pad = [(n, n) if a == axis else (0, 0) for a in range(3)]
        e = np.pad(x, pad, mode="edge")
        x = sum(w * np.take(e, range(j, j + x.shape[axis]), axis=axis) for j, w in enumerate(k))
    return x


def sharpen(p: np.ndarray, strength: float) -> np.ndarray:
    """The image plus its difference from a blurred one; strength within 0 and 5."""
    return _bytes(p + min(5.0, max(0.0, strength)) * (p - blur(p, 2.0)))


def rotate(p: np.ndarray, angle: float) -> np.ndarray:
    """Turned counter-clockwise by at most 20 degrees on a canvas that holds all of it; what is outside is black."""
    a = np.deg2rad(min(20.0, max(-20.0, angle)))
    if a == 0:
        return p
    h, w, _ = p.shape
    cos, sin = np.cos(a), np.sin(a)
    nw, nh = int(np.ceil(w * abs(cos) + h * abs(sin) - 1e-9)), int(np.ceil(h * abs(cos) + w * abs(sin) - 1e-9))
    y, x = np.mgrid[0:nh, 0:nw]
    dx, dy = x - (nw - 1) / 2, y - (nh - 1) / 2
    sx, sy = cos * dx - sin * dy + (w - 1) / 2, sin * dx + cos * dy + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((nh, nw, p.shape[2]))
    for oy in (0, 1):
        for ox in (0, 1):
            xx, yy = x0 + ox, y0 + oy
            ok = (xx >= 0) & (xx < w) & (yy >= 0) & (yy < h)
            f = np.where(ox, sx - x0, 1 - (sx - x0)) * np.where(oy, sy - y0, 1 - (sy - y0)) * ok
            out += f[:, :, None] * p[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
    return _bytes(out)


def crop(p: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    left, top = max(0, x), max(0, y)
    out = p[top : min(p.shape[0], top + h), left : min(p.shape[1], left + w)]
    if not out.size:
        raise ValueError("empty crop")
    return out


def degrade(p: np.ndarray, how: str) -> np.ndarray:
    """blur, downsample or rotate: what sharpening, upscaling and turning back restore."""
    if how == "blur":
        return _bytes(blur(p, 2.5))
    if how == "downsample":
        return resize(p, max(1, p.shape[1] // 3), max(1, p.shape[0] // 3))
    if how == "rotate":
        return rotate(p, 8.0)
    raise ValueError(f"unknown degradation {how}")


RESULT = "content binary, width int, height int, error string"


def apply(content: Column, f: Callable[..., np.ndarray], *arguments: Column) -> Column:
    """(content, width, height, error) of f(pixels, *arguments) for each image; a null image or argument is an error."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for data, *args in zip(*columns):
                try:
                    if data is None or any(a is None or a != a for a in args):
                        raise ValueError("nothing to work on")
                    p = f(decode(bytes(data)), *args)
                    rows.append((encode(p), p.shape[1], p.shape[0], None))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["content", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    return run(content, *arguments)
