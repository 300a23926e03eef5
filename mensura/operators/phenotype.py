"""Plant images, one at a time: colours, white backgrounds, corners and crops. What plants are made of is
found on pixel tables, in ``plant``."""

from __future__ import annotations

import math

import numpy as np

from mensura.operators import raster

class Colours:
    """The channels of an eight-bit image as numbers: r, g, b, hue (0 to 179), saturation, value, and
    the excess of green."""

    def __init__(self, image: np.ndarray):
        self.r, self.g, self.b = (image[..., k].astype(float) for k in range(3))
        self.value = image.max(axis=2).astype(float)
        spread = self.value - image.min(axis=2)
        safe = np.maximum(spread, 1)
        angle = np.select(
            [spread == 0, self.value == self.r, self.value == self.g],
            [0.0, 60 * (self.g - self.b) / safe, 120 + 60 * (self.b - self.r) / safe], 240 + 60 * (self.r - self.g) / safe,
        )
        self.hue = np.rint(angle % 360 / 2) % 180
        self.saturation = np.rint(255 * spread / np.maximum(self.value, 1))
        self.excess = 2 * self.g - self.r - self.b


def frame(shape: tuple[int, ...], thickness: int) -> np.ndarray:
    """The pixels within a thickness of the border."""
    out = np.ones(shape[:2], bool)
    if min(shape[:2]) > 2 * thickness:
        out[thickness:-thickness, thickness:-thickness] = False
    return out


def audit_mask(image: np.ndarray) -> np.ndarray:
    """The inclusive vegetation rule for audits and crops, opened and closed, without specks."""
    c = Colours(image)
    green = (c.hue >= 18) & (c.hue <= 100) & (c.saturation >= 24) & (c.value >= 22)
    more = (c.excess >= 10) & (c.g >= 35) & (c.g >= c.r - 3) & (c.g >= c.b - 3)
    r = 1 if min(image.shape[:2]) < 700 else 2
    m = raster.closed(raster.opened(green | more, r), 2 * r)
    return raster.at_least(m, max(20, round(m.size * 0.00004)))


def on_white(image: np.ndarray, level: int = 248) -> np.ndarray:
    """Foreground of an image on white."""
    return (image < level).any(axis=2)


def green_core(image: np.ndarray) -> np.ndarray:
    """Clearly green pixels."""
    c = Colours(image)
    return (c.hue >= 24) & (c.hue <= 92) & (c.saturation >= 30) & (c.excess >= 7)


def focused(image: np.ndarray, roi: np.ndarray, sigma: float = 0.8) -> np.ndarray:
    """The region on white, with soft edges outwards of the given spread; none with 0."""
    alpha = roi.astype(float)
    if sigma > 0:
        r = math.ceil(3 * sigma)
        kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
        kernel /= kernel.sum()
        for axis in (0, 1):
            alpha = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, "edge"), kernel, "valid"), axis, alpha)
        alpha = np.maximum(alpha, roi)
    return np.rint(image * alpha[..., None] + 255 * (1 - alpha[..., None])).astype(np.uint8)


def corners(support: np.ndarray, most: int, quality: float = 0.045, apart: float = 8.0) -> np.ndarray:
    """(x, y) of corners of a mask: the smaller eigenvalue of its gradients' moments over 7 x 7 pixels,
    local maxima of at least a share of the largest, the strongest first and none nearer than apart."""
    def smooth(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        r = len(kernel) // 2
        for _ in range(2):  # columns, then rows: all lines in a row, each with its own margin
            lines = np.pad(v.T, ((0, 0), (r, r)), "reflect" if len(v) > r else "edge")
            v = np.pad(np.convolve(lines.reshape(-1), kernel, "valid"), (0, 2 * r)).reshape(lines.shape)[:, : len(v)]
        return v

    k = np.exp(-(np.arange(-4, 5) ** 2) / (2 * 1.2**2))
    gy, gx = np.gradient(smooth(support.astype(float), k / k.sum()))
    box = np.full(7, 1 / 7)
    xx, yy, xy = smooth(gx * gx, box), smooth(gy * gy, box), smooth(gx * gy, box)
    low = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    around = np.pad(low, 1, constant_values=-np.inf)
    top = np.max([around[1 + dy : around.shape[0] - 1 + dy, 1 + dx : around.shape[1] - 1 + dx] for dx, dy in raster.EIGHT], axis=0)
    places = np.argwhere((low >= top) & (low >= quality * low.max(initial=0)) & (low > 1e-12))
    kept: list[np.ndarray] = []
    for y, x in sorted(places.tolist(), key=lambda p: (-low[p[0], p[1]], p)):
        if len(kept) < most and all((x - q[0]) ** 2 + (y - q[1]) ** 2 >= apart**2 for q in kept):
            kept.append(np.array([x, y], float))
    return np.array(kept).reshape(-1, 2)


# --- white backgrounds and crops ----------------------------------------------------------------------


def scanner_lines(m: np.ndarray, share: float = 0.6, width: int = 4) -> np.ndarray:
    """Components of a mask that are lines of a scanner: no thicker than width and as long as a share of
    the frame."""
    lab, n = raster.label(m)
    out = np.zeros_like(m, bool)
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        h, w = np.ptp(y) + 1, np.ptp(x) + 1
        if (h <= width and w >= share * m.shape[1]) or (w <= width and h >= share * m.shape[0]):
            out |= lab == k
    return out


def full_plant(image: np.ndarray) -> np.ndarray:
    """Green and what is brown and linked to it, without the scanner's lines."""
    c, green = Colours(image), raster.at_least(green_core(image), 8)
    brown = (c.r >= 1.04 * c.g) & (c.g >= 1.02 * c.b) & (c.saturation >= 35)
    m = (green | brown) & ~scanner_lines(green | brown)
    return raster.filled(raster.closed(raster.linked(m, green), 1)) if green.any() else green


def normalised(image: np.ndarray, pad: float = 0.05, sigma: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(the full plant on white, cut to its box with a padded margin; its mask, cut alike)."""
    m = full_plant(image)
    out = focused(image, m, sigma)
    x0, y0, x1, y1 = foreground_box(m, pad)
    return out[y0:y1, x0:x1], m[y0:y1, x0:x1]


def foreground_box(m: np.ndarray, pad: float = 0.05) -> tuple[int, int, int, int]:
    """(left, top, right, bottom), ends exclusive: the mask's box with a margin of a share of each side
    (two pixels at least) within the frame; the frame, if the mask is empty."""
    y, x = np.nonzero(m)
    if not len(x):
        return 0, 0, m.shape[1], m.shape[0]
    box = []
    for v, size in ((x, m.shape[1]), (y, m.shape[0])):
        low, high = int(v.min()), int(v.max()) + 1
        margin = max(2, round((high - low) * pad))
        box.append((max(0, low - margin), min(size, high + margin)))
    return box[0][0], box[1][0], box[0][1], box[1][1]


def oriented_box(box: tuple[int, int, int, int], vertical: bool, shape: tuple[int, int]) -> tuple[int, int, int, int]:
    """A box wider by 16 % of the side along its orientation and 22 % of the other, within the frame."""
    x0, y0, x1, y1 = box
    along, beside = 0.16, 0.22
    mx, my = round((x1 - x0) * (beside if vertical else along)), round((y1 - y0) * (along if vertical else beside))
    return max(0, x0 - mx), max(0, y0 - my), min(shape[1], x1 + mx), min(shape[0], y1 + my)


def one_shoot(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """An image on white with its largest component only, and what went."""
    lab, n = raster.label(on_white(image))
    if not n:
        return image, {"components": 0, "second_share": 0.0}
    size = np.sort(np.bincount(lab[lab > 0], minlength=n + 1)[1:])[::-1]
    out = image.copy()
    out[~raster.dilate(raster.largest(lab > 0), 1)] = 255
    return out, {"components": n, "second_share": float(size[1] / size[0]) if n > 1 else 0.0}
