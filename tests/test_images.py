"""Image files and evaluation rows."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from mensura.functions.scalar import hamming64
from mensura.operators import evaluate, raster
from mensura.sources import images


def filtered_png(image, kind):
    """A PNG whose lines all use one filter."""
    h, w, n = image.shape
    lines, before = b"", np.zeros((w, n), int)
    for y in range(h):
        own, left, corner = image[y].astype(int), np.zeros((w, n), int), np.zeros((w, n), int)
        left[1:], corner[1:] = own[:-1], before[:-1]
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        lines += bytes([kind]) + ((own - [0 * own, left, before, (left + before) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        before = own
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_codecs_round_trip():
    r = np.random.default_rng(0)
    for shape in ((5, 7, 3), (4, 3, 4)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        assert (images.decode(images.encode(image)) == image).all()
        for kind in range(5):
            assert (images.decode(filtered_png(image, kind)) == image).all()
    image = r.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (images.decode(b"P6\n# note\n7 5\n255\n" + image.tobytes()) == image).all()
    clear = np.zeros((2, 2, 4), np.uint8)
    assert (images.on_white(clear) == 255).all()


def test_audit_hashes_and_pixels(spark, tmp_path):
    y, x = np.mgrid[:40, :60]
    base = np.stack([x * 4, y * 6, x + y], axis=2).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode(base))
    (tmp_path / "b.png").write_bytes(images.encode(np.clip(base.astype(int) + 3, 0, 255).astype(np.uint8)))
    (tmp_path / "c.png").write_bytes(b"broken")
    found = images.read(spark, str(tmp_path))
    rows = {r["path"][-5:]: r for r in images.audit(found).collect()}
    assert rows["c.png"]["error"].startswith("ValueError") and rows["a.png"]["width"] == 60
    h = spark.createDataFrame([(rows["a.png"]["dhash64"], rows["b.png"]["dhash64"])], "a string, b string")
    assert h.select(hamming64("a", "b").alias("d")).first()["d"] <= 5
    pix = images.pixels(found.filter(F.col("path").endswith("a.png"))).withColumn("item", F.lit(1))
    assert pix.count() == 2400 and raster.border(pix).first()["pixels"] == 2 * 60 + 2 * 38
    again = images.encoded(pix.filter("x < 10 AND y < 8").select("item", "x", "y")).first()["content"]
    assert images.decode(bytes(again)).shape == (8, 10, 3)


def test_evaluation_rows(spark):
    v = spark.createDataFrame([(1, "identity", "identity", 5, 1.0, 0.0), (1, "dark", "photometric", 3, 0.8, float("nan")), (1, "flip", "geometric", 4, 0.6, 0.02)], "item int, view string, family string, count int, f1 double, error double")
    r = evaluate.per_item(v, "item", 5).first()
    assert (r["count"], round(r["mean_f1"], 6), r["median_error"], r["photometric_difference"], r["collapse"], r["cap_hit"]) == (5, 0.7, 0.02, 2.0, 0, 1)
    p = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 0), (1, 0, 0, 0)], "item int, in_plant int, in_root int, in_shoot int")
    assert evaluate.region_hits(p, "item").first()["root_only_count"] == 1
    d = spark.createDataFrame([(i, "rare" if i < 2 else "often") for i in range(40)], "id int, s string")
    chosen = evaluate.pilot(d, "s", "id", 10, "3")
    assert chosen.count() == 10 and chosen.filter("s = 'rare'").count() >= 1
