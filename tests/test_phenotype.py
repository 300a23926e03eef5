"""Colours, audit masks, corners and crops on drawn plants."""

import colorsys

import numpy as np

from mensura.operators import phenotype as P
from mensura.operators import raster


def plant(turn=0, root=True):
    """(image, shoot, root, full): a green bar with a leaf, a brown seed and a pale root, on grey."""
    image = np.full((120, 200, 3), 225, np.uint8)
    shoot, under = np.zeros((120, 200), bool), np.zeros((120, 200), bool)
    shoot[56:64, 80:180] = True
    shoot[40:56, 130:136] = True
    under[57:63, 20:80] = root
    image[shoot] = (60, 150, 50)
    image[under] = (200, 180, 140)
    image[54:66, 66:78][under[54:66, 66:78]] = (140, 80, 30)
    out = image, shoot, under, shoot | under
    return tuple(np.rot90(m, turn).copy() for m in out)


def test_colours_agree_with_the_standard_library():
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    c = P.Colours(image)
    for y, x in np.ndindex(20, 20):
        h, s, v = colorsys.rgb_to_hsv(*(image[y, x] / 255.0))
        assert min(abs(c.hue[y, x] - h * 180), 180 - abs(c.hue[y, x] - h * 180)) <= 0.51 and abs(c.saturation[y, x] - s * 255) <= 0.51 and c.value[y, x] == round(v * 255)


def test_focused_is_white_outside():
    image, shoot, root, full = plant()
    hard, soft = P.focused(image, shoot, 0.0), P.focused(image, shoot, 0.8)
    assert (hard[~shoot] == 255).all() and (hard[shoot] == image[shoot]).all() and (soft[shoot] == image[shoot]).all()
    canvas, mapping = raster.letterbox_pixels(hard, 224)
    assert canvas.shape == (224, 224, 3)


def test_audit_mask():
    image, shoot, _, _ = plant()
    audit = P.audit_mask(image)
    assert (audit & shoot).sum() > 0.9 * shoot.sum() and not P.audit_mask(np.full((50, 50, 3), 200, np.uint8)).any()


def test_corners_of_a_square():
    square = np.zeros((60, 60), bool)
    square[15:45, 20:50] = True
    found = P.corners(square, 30)
    assert len(found) == 4 and all(min(np.hypot(*(found - c).T)) <= 3 for c in ((20, 15), (49, 15), (20, 44), (49, 44)))


def test_crops_and_white():
    m = np.zeros((100, 200), bool)
    m[40:60, 50:150] = True
    assert P.foreground_box(m) == (45, 38, 155, 62) and P.foreground_box(~m & m) == (0, 0, 200, 100)
    assert P.oriented_box((50, 40, 150, 60), False, (100, 200)) == (34, 36, 166, 64) and P.oriented_box((50, 40, 150, 60), True, (100, 200)) == (28, 37, 172, 63)
    image, shoot, root, full = plant()
    image[2:4, :] = (120, 70, 30)  # a line of the scanner
    out, mask = P.normalised(image)
    assert out.shape[:2] == mask.shape and mask.sum() >= shoot.sum() and out.shape[0] < 100
    white = np.full((60, 60, 3), 255, np.uint8)
    white[10:30, 10:30], white[50:53, 50:53] = 90, 90
    one, told = P.one_shoot(white)
    assert (one[50:53, 50:53] == 255).all() and (one[10:30, 10:30] == 90).all() and told["components"] == 2 and 0 < told["second_share"] < 0.1
