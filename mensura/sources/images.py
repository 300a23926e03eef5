"""Image files without a codec library: PNG (8 bit, not interlaced) and PPM/PGM, and their hashes."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(raw: bytes) -> np.ndarray:
    """RGB or RGBA bytes, height x width x channels; grey becomes RGB."""
    if raw.startswith(PNG):
        image = _png(raw)
    elif raw[:2] in (b"P5", b"P6"):
        image = _ppm(raw)
    else:
        raise ValueError("neither PNG nor PPM")
    if image.shape[2] in (1, 2):
        grey = np.repeat(image[..., :1], 3, axis=2)
        image = np.concatenate([grey, image[..., 1:]], axis=2)
    return image


def _png(raw: bytes) -> np.ndarray:
    at, data, head = 8, [], None
    while at < len(raw):
        (size,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("PNG chunk with a wrong checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("PNG kind not supported")
    w, h, n = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.uint8)
    for y in range(h):
        line, above, own, how = lines[y, 1:].reshape(w, n), out[y], out[y + 1], lines[y, 0]
        if how == 0:
            own[1:] = line
        elif how == 1:
            own[1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif how == 2:
            own[1:] = line + above[1:]
        else:
            for x in range(1, w + 1):
                a, b, c = own[x - 1].astype(int), above[x].astype(int), above[x - 1].astype(int)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
                own[x] = (line[x - 1] + guess) & 255
    return out[1:, 1:]


def _ppm(raw: bytes) -> np.ndarray:
    at, numbers = 2, []
    while len(numbers) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        numbers.append(int(raw[at:end]))
        at = end
    w, h, most = numbers
    if most > 255:
        raise ValueError("PPM of more than 8 bits")
    n = 3 if raw[:2] == b"P6" else 1
    return np.frombuffer(raw, np.uint8, w * h * n, at + 1).reshape(h, w, n)


def encode(image: np.ndarray) -> bytes:
    """PNG of grey, RGB or RGBA bytes."""
    image = image[..., None] if image.ndim == 2 else image
    h, w, n = image.shape
    kind = {v: k for k, v in CHANNELS.items()}[n]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1).astype(np.uint8)], axis=1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def on_white(image: np.ndarray) -> np.ndarray:
    """RGB with any alpha laid over white."""
    if image.shape[2] == 3:
        return image
    a = image[..., 3:].astype(float) / 255
    return np.rint(image[..., :3] * a + 255 * (1 - a)).astype(np.uint8)


def shrink(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over the boxes of a smaller grid."""
    ys = np.linspace(0, grey.shape[0], height + 1).astype(int)
    xs = np.linspace(0, grey.shape[1], width + 1).astype(int)
    return np.array([[grey[ys[j] : max(ys[j] + 1, ys[j + 1]), xs[i] : max(xs[i] + 1, xs[i + 1])].mean() for i in range(width)] for j in range(height)])


def grey(image: np.ndarray) -> np.ndarray:
    return on_white(image)[..., :3] @ np.array([0.299, 0.587, 0.114])


def _hex(bits: np.ndarray) -> str:
    return format(int("".join("1" if b else "0" for b in bits.reshape(-1)), 2), "016x")


def difference_hash(image: np.ndarray) -> str:
    """64 bits: each of 9 x 8 cells against the next in its row."""
    g = shrink(grey(image), 9, 8)
    return _hex(g[:, 1:] > g[:, :-1])


def frequency_hash(image: np.ndarray) -> str:
    """64 bits: the low 8 x 8 cosine coefficients of a 32 x 32 image against their median."""
    g = shrink(grey(image), 32, 32)
    k = np.arange(32)
    basis = np.cos(math.pi / 32 * (k[None, :] + 0.5) * k[:, None])
    low = (basis @ g @ basis.T)[:8, :8]
    return _hex(low > np.median(low.reshape(-1)[1:]))


AUDIT = "path string, width int, height int, alpha_fraction double, white_fraction double, black_fraction double, luminance double, dhash64 string, phash64 string, error string"


def audit(files: DataFrame) -> DataFrame:
    """One row a file of (path, content): size, fractions, hashes, or the reason it could not be read."""

    def one(path: str, raw: bytes) -> dict:
        try:
            image = decode(raw)
        except Exception as e:  # the reason goes to its column
            return {"path": path, "error": f"{type(e).__name__}: {e}"}
        g = grey(image)
        alpha = float((image[..., 3] < 255).mean()) if image.shape[2] == 4 else 0.0
        return {"path": path, "width": image.shape[1], "height": image.shape[0], "alpha_fraction": alpha, "white_fraction": float((g >= 245).mean()), "black_fraction": float((g <= 10).mean()), "luminance": float(g.mean()), "dhash64": difference_hash(image), "phash64": frequency_hash(image)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in AUDIT.split(", ")]
        for pdf in batches:
            rows = [one(p, r) for p, r in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    return files.select("path", "content").mapInPandas(run, AUDIT)


def pixels(files: DataFrame) -> DataFrame:
    """Long form: path, x, y, r, g, b of every readable image on white, one image at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                image = on_white(decode(raw))
                y, x = np.mgrid[: image.shape[0], : image.shape[1]]
                flat = image.reshape(-1, 3).astype(int)
                yield pd.DataFrame({"path": path, "x": x.reshape(-1), "y": y.reshape(-1), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return files.select("path", "content").mapInPandas(run, "path string, x int, y int, r int, g int, b int")


def encoded(masks: DataFrame, item: str = "item") -> DataFrame:
    """(item, content): PNG of each item's mask pixels, for a binary column or a file sink."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.uint8)
        m[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = 255
        return pd.DataFrame({item: [key[0]], "content": [encode(m)]})

    return masks.groupBy(item).applyInPandas(run, f"{item} {masks.schema[item].dataType.simpleString()}, content binary")


def read(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content"))
