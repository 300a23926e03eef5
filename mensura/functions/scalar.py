"""Scalar building blocks as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def number(x) -> Column:
    """NaN as null; infinities stay."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x), x)


def safe_ratio(n, d) -> Column:
    """n over d, with a denominator of one at least."""
    return c(n) / F.greatest(c(d), F.lit(1))


def clip(x, low, high) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def half_even(x, digits: int = 0) -> Column:
    return F.bround(c(x), digits)


def truthy(x) -> Column:
    """Text flags: 1, true and yes in any case."""
    return F.lower(c(x).cast("string")).isin("1", "true", "yes")


def slashes(path) -> Column:
    return F.translate(c(path), "\\", "/")


def parent(path) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -2)


def basename(path) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def identity(name) -> Column:
    """The specimen that an augmented file stems from."""
    return F.regexp_replace(F.lower(c(name)), r"_aug\d+$", "")


def series(name) -> Column:
    """The scanner series of names such as ``plate(3)``; other names stand alone."""
    got = F.regexp_extract(c(name), r"^(.+?)\(\d+\)$", 1)
    return F.when(got != "", got).otherwise(c(name))


def items(text, mark: str = ";") -> Column:
    """A delimited list; the empty string holds none."""
    return F.filter(F.split(F.coalesce(c(text), F.lit("")), mark), lambda x: x != "")


def flagged(flags: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))


def seeded(seed, *keys) -> Column:
    """SHA-256 of seed and keys joined by bars: a repeatable random order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c(k).cast("string") for k in keys]), 256)


def hash_bucket(hexed, buckets: int = 10_000) -> Column:
    """The first 32 bits of a hash in hex, modulo buckets."""
    return F.conv(F.substring(c(hexed), 1, 8), 16, 10).cast("bigint") % buckets


def half64(hexed, which: int) -> Column:
    """A half of a 64-bit hash in hex as a long (a whole one would not fit)."""
    return F.conv(F.substring(c(hexed), 1 + 8 * which, 8), 16, 10).cast("bigint")


def hamming64(a, b) -> Column:
    return sum((F.bit_count(half64(a, k).bitwiseXOR(half64(b, k))) for k in (0, 1)), F.lit(0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(c(x1) - c(x2), 2) + F.pow(c(y1) - c(y2), 2))


def angle_between(ax, ay, bx, by) -> Column:
    """Degrees between two vectors; null where one has no length."""
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(size > 1e-12, F.degrees(F.acos(clip((ax * bx + ay * by) / size, -1.0, 1.0))))


def affine(m: list, x, y) -> tuple[Column, Column]:
    """A 2x3 affine map [a, b, tx, c, d, ty] of a point."""
    a, b, tx, d, e, ty = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in m)
    return a * c(x) + b * c(y) + tx, d * c(x) + e * c(y) + ty


def affine_inverse(m: list) -> list[Column]:
    """The inverse of a 2x3 affine map as expressions; null where it has none."""
    a, b, tx, d, e, ty = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in m)
    det = a * e - b * d
    det = F.when(F.abs(det) > 1e-12, det)
    return [e / det, -b / det, (b * ty - e * tx) / det, -d / det, a / det, (d * tx - a * ty) / det]


def to_source(x, y, scale, pad_x, pad_y, width, height) -> tuple[Column, Column]:
    """Letterboxed model coordinates back to source pixels, clipped to the frame."""
    put = lambda v, pad, size: F.least(F.greatest((c(v) - c(pad)) / c(scale), F.lit(0.0)), c(size) - 1.0)
    return put(x, pad_x, width), put(y, pad_y, height)


def to_model(x, y, scale, pad_x, pad_y) -> tuple[Column, Column]:
    return c(x) * c(scale) + c(pad_x), c(y) * c(scale) + c(pad_y)


def letterbox(width, height, side: int) -> Column:
    """struct(scale, pad_x, pad_y) that fits a frame into a square."""
    scale = F.lit(float(side)) / F.greatest(c(width), c(height))
    pad = lambda v: F.floor((side - half_even(c(v) * scale)) / 2).cast("double")
    return F.struct(scale.alias("scale"), pad(width).alias("pad_x"), pad(height).alias("pad_y"))


REGISTERED = {
    "hamming64": "(a STRING, b STRING) RETURNS INT RETURN bit_count(cast(conv(substring(a,1,8),16,10) AS BIGINT) ^ cast(conv(substring(b,1,8),16,10) AS BIGINT)) + bit_count(cast(conv(substring(a,9,8),16,10) AS BIGINT) ^ cast(conv(substring(b,9,8),16,10) AS BIGINT))",
    "sinuosity": "(length DOUBLE, chord DOUBLE) RETURNS DOUBLE RETURN length / greatest(chord, 1e-9)",
    "safe_ratio": "(n DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN n / greatest(d, 1.0D)",
}


def prefixed(df, prefix: str, keep: list[str]):
    """All columns but the kept ones under a prefix."""
    return df.select(*[F.col(f"`{x}`").alias(x if x in keep else prefix + x) for x in df.columns])


def relabelled(x, names: dict[str, str]) -> Column:
    """Values by another name; those without one stay."""
    out = c(x)
    for old, new in names.items():
        out = F.when(c(x) == old, F.lit(new)).otherwise(out)
    return out


def register(spark) -> None:
    """The SQL functions of the engine, for spark.sql users."""
    for name, body in REGISTERED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
