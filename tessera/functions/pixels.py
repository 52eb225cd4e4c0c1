"""Exact pixel permutations as column expressions.

Images are flat row-major arrays of ``height * width * channels`` values
(``(row * width + col) * channels + channel``).  Each function returns the
array with pixels moved; values are never changed, so the result equals a
numpy ``[::-1]`` / ``rot90`` bit for bit.  Turning a picture by 90 or 270
degrees swaps height and width.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def permute_pixels(pixels, height: int, width: int, channels: int,
                   source: Callable[[Column, Column, Column], Column],
                   out_width: int | None = None) -> Column:
    """Generic permutation: ``source(r, c, ch)`` gives the input flat index
    of output pixel (r, c, ch), output being ``? x out_width x channels``."""
    ow = out_width or width
    n = height * width * channels
    arr = _c(pixels)

    def pick(i):
        r = F.floor(i / F.lit(ow * channels)).cast("int")
        c = (F.floor(i / F.lit(channels)) % F.lit(ow)).cast("int")
        ch = (i % F.lit(channels)).cast("int")
        return F.get(arr, source(r, c, ch))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pick)


def flip_left_right(pixels, height: int, width: int, channels: int = 1) -> Column:
    return permute_pixels(pixels, height, width, channels,
                          lambda r, c, ch: (r * width + (width - 1 - c)) * channels + ch)


def flip_top_bottom(pixels, height: int, width: int, channels: int = 1) -> Column:
    return permute_pixels(pixels, height, width, channels,
                          lambda r, c, ch: ((height - 1 - r) * width + c) * channels + ch)


def rotate180(pixels, height: int, width: int, channels: int = 1) -> Column:
    return permute_pixels(pixels, height, width, channels,
                          lambda r, c, ch: ((height - 1 - r) * width + (width - 1 - c)) * channels + ch)


def rotate90(pixels, height: int, width: int, channels: int = 1) -> Column:
    """Counter-clockwise quarter turn (numpy ``rot90(k=1)``); out is width x height."""
    return permute_pixels(pixels, height, width, channels,
                          lambda r, c, ch: (c * width + (width - 1 - r)) * channels + ch,
                          out_width=height)


def rotate270(pixels, height: int, width: int, channels: int = 1) -> Column:
    """Three counter-clockwise quarter turns (numpy ``rot90(k=3)``, one clockwise
    turn); out is width x height."""
    return permute_pixels(pixels, height, width, channels,
                          lambda r, c, ch: ((height - 1 - c) * width + r) * channels + ch,
                          out_width=height)


def move_by_symmetry(pixels, height: int, width: int, channels: int, turns: Column, flipped: Column) -> Column:
    """Each row's own symmetry of the square in one gather: flipped left-right
    first where ``flipped`` is 1, then turned by ``turns`` counter-clockwise
    quarters.  An odd number of turns needs a square picture.

    The source of output pixel (r, c) is ``start + down * r + right * c``; the
    three numbers follow from turns and flip and are looked up once a row.
    """
    h, w = height - 1, width - 1
    plain = [(0, width, 1), (w, -1, width), (h * width + w, -width, -1), (h * width, 1, -width)]
    mirrored = [(w, width, -1), (0, 1, width), (h * width, -width, 1), (h * width + w, -1, -width)]
    which = (turns + 4 * flipped + 1).cast("int")
    start, down, right = (F.element_at(F.array(*[F.lit(x * channels) for x in xs]), which) for xs in zip(*plain, *mirrored))
    row = F.struct(_c(pixels).alias("px"), start.alias("start"), down.alias("down"), right.alias("right"))

    def moved(p):
        def pick(i):
            r, c = F.floor(i / F.lit(width * channels)), F.floor(i / F.lit(channels)) % F.lit(width)
            return F.get(p["px"], (p["start"] + p["down"] * r + p["right"] * c + i % F.lit(channels)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(height * width * channels - 1)), pick)

    # bound as the only element of an array, so that the lookups run once a row
    return F.get(F.transform(F.array(row), moved), F.lit(0))
