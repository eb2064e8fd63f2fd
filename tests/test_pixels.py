import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrail.operators import pixels as X


def image(h=20, w=30, c=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def filtered(p, kind):
    """A PNG whose rows all use one filter."""
    h, w, c = p.shape
    x = p.astype(int)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 1:] = x[:-1, :-1]
    g = left + up - corner
    a, b, d = abs(g - left), abs(g - up), abs(g - corner)
    paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
    base = [0 * x, left, up, (left + up) // 2, paeth][kind]
    raw = np.concatenate([np.full((h, 1), kind), ((x - base) & 255).reshape(h, w * c)], axis=1).astype(np.uint8)
    chunk = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    return X._MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
@pytest.mark.parametrize("kind", range(5))
def test_all_filters(channels, kind):
    p = image(c=channels)
    assert (X.decode(filtered(p, kind)) == p).all()


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_round_trip(channels):
    p = image(c=channels)
    assert (X.decode(X.encode(p)) == p).all()


def test_operations():
    p = image()
    flat = np.full((20, 30, 3), 77, dtype=np.uint8)
    assert X.upscale(p, 2).shape == (40, 60, 3) and X.upscale(p, 9).shape == (80, 120, 3)
    assert (X.upscale(flat, 2) == 77).all() and (X.sharpen(flat, 3) == 77).all() and (X.sharpen(p, 0) == p).all()
    assert (X.rotate(p, 0) == p).all() and X.rotate(p, 90).shape == X.rotate(p, 20).shape and X.rotate(p, 10).shape[0] > 20
    assert (X.crop(p, -5, 2, 10, 100) == p[2:, :10]).all()
    with pytest.raises(ValueError, match="empty crop"):
        X.crop(p, 99, 0, 5, 5)
    assert X.degrade(p, "downsample").shape == (6, 10, 3) and X._bytes(X.blur(p, 2)).std() < p.std()


def test_columns(spark):
    df = spark.createDataFrame([(1, X.encode(image()), 2.0), (2, b"no image", 2.0), (3, None, 2.0), (4, X.encode(image()), None), (5, X.encode(image())[:60], 2.0)], "k int, c binary, s double")
    got = {r["k"]: r["r"] for r in df.select("k", X.apply(F.col("c"), X.upscale, F.col("s")).alias("r")).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["error"]) == (60, 40, None) and X.decode(bytes(got[1]["content"])).shape == (40, 60, 3)
    assert got[2]["error"] == "not a PNG" and got[3]["error"] == got[4]["error"] == "nothing to work on" and got[5]["error"]
