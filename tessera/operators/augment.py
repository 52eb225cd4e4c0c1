"""Augmentation pipeline (G1-G11): make new pictures from drawn sources.

The random draws are JVM-side columns, ``md5(seed:row:step:k)`` fractions, so a
re-run or a retried task gives the same picture.  Every step has a probability
of being applied.

Steps that only move pixels (G2, G3, G4, G6, G7, G8) are the symmetries of the
square, a group of eight.  Where a pipeline has no other steps, each row's drawn
steps are composed in that group and applied by one gather in the JVM.

Crop, rotate, shear and zoom (G5, G9, G10, G11) read each output pixel from four
neighbours.  Positions and weights are whole numbers, 2**16 to a pixel, from
parameters rounded to that grid once; so the result is one defined number, which
SQL computes as well.  They run as batched numpy in ``mapInPandas``.  Edge
pixels repeat outside, and a crop is resized back to the input size.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import DEFAULT_SEED, hash_unit
from tessera.functions.pixels import move_by_symmetry

# The eleven steps, in order, with their probabilities and ranges.
DEFAULT_STEPS = [
    {"op": "flip_random", "p": 1.0},
    {"op": "flip_left_right", "p": 1.0},
    {"op": "flip_top_bottom", "p": 1.0},
    {"op": "crop_random", "p": 1.0, "area": 0.90},
    {"op": "rotate_random_90", "p": 0.9},
    {"op": "rotate180", "p": 0.8},
    {"op": "rotate270", "p": 0.6},
    {"op": "flip_random", "p": 1.0},
    {"op": "rotate", "p": 0.5, "left": 4, "right": 4},
    {"op": "shear", "p": 0.6, "left": 8, "right": 8},
    {"op": "zoom", "p": 0.8, "lo": 1.0, "hi": 1.3},
]

N_DRAWS = 3  # uniform numbers per step: apply?, and two parameters
AUGMENT_BATCH = 1024  # pictures per numpy batch inside a task
BITS = 16
ONE = 1 << BITS  # positions and weights: so many to a pixel

FLIPS = frozenset(["flip_random", "flip_left_right", "flip_top_bottom"])
QUARTERS = frozenset(["rotate_random_90", "rotate270"])
SYMMETRIES = FLIPS | QUARTERS | {"rotate180"}


def symmetry(steps, draw) -> tuple[Column, Column]:
    """``(turns, flipped)`` of the composed steps: flip left-right first if flipped, then that many quarter turns.

    ``draw(step, k)`` is the k-th uniform number of a step.  A flip after r
    turns is a flip before -r turns; top-bottom is two turns after left-right.
    """
    turns, flipped = F.lit(0), F.lit(0)
    for s, st in enumerate(steps):
        op, hit = st["op"], draw(s, 0) < st["p"]
        if op == "rotate_random_90":
            more = 1 + F.floor(draw(s, 1) * 3).cast("int")
        else:
            more = {"rotate180": F.lit(2), "rotate270": F.lit(3), "flip_left_right": F.lit(0), "flip_top_bottom": F.lit(2),
                    "flip_random": F.when(draw(s, 1) < 0.5, 0).otherwise(2)}[op]
        if op in FLIPS:
            turns = turns * F.when(hit, -1).otherwise(1)
            flipped = flipped + hit.cast("int")
        turns = turns + F.when(hit, more).otherwise(0)
    return F.pmod(turns, F.lit(4)), flipped % 2


# --- resampling kernels on (B, H, W, C) arrays -----------------------------------

def _gather(imgs, ys, xs, last_y, last_x):
    """Pixels at positions ``ys``, ``xs`` (B, H, W) in 2**-16, mixed from four neighbours up to ``last_y``, ``last_x``."""
    y0, x0 = ys >> BITS, xs >> BITS
    fy, fx = (ys & (ONE - 1))[..., None], (xs & (ONE - 1))[..., None]
    y1, x1 = np.minimum(y0 + 1, last_y), np.minimum(x0 + 1, last_x)
    b = np.arange(len(imgs))[:, None, None]
    out = imgs[b, y0, x0] * ((ONE - fy) * (ONE - fx))
    out = out + imgs[b, y0, x1] * ((ONE - fy) * fx)
    out = out + imgs[b, y1, x0] * (fy * (ONE - fx))
    out = out + imgs[b, y1, x1] * (fy * fx)
    return out / float(1 << 2 * BITS)


def _fixed(x):
    return np.floor(x * ONE + 0.5).astype(np.int64)


def _affine(imgs, a, b, c, d):
    """Output pixel (y, x) reads the input at centre + [[a, b], [c, d]] (y - centre, x - centre), in 2**-16."""
    _, h, w = imgs.shape[:3]
    dy = (2 * np.arange(h) - (h - 1))[None, :, None]
    dx = (2 * np.arange(w) - (w - 1))[None, None, :]
    a, b, c, d = (v[:, None, None] for v in (a, b, c, d))
    ys = np.clip(((h - 1) * ONE + a * dy + b * dx) // 2, 0, (h - 1) * ONE)
    xs = np.clip(((w - 1) * ONE + c * dy + d * dx) // 2, 0, (w - 1) * ONE)
    return _gather(imgs, ys, xs, h - 1, w - 1)


def _cropped(imgs, u, area):
    n, height, width = imgs.shape[:3]
    side = math.sqrt(area)
    h, w = max(1, int(height * side)), max(1, int(width * side))
    top = (u[:, 1] * (height - h + 1)).astype(np.int64)[:, None, None]
    left = (u[:, 2] * (width - w + 1)).astype(np.int64)[:, None, None]
    ys = np.clip(((2 * np.arange(height) + 1) * h * ONE - height * ONE) // (2 * height), 0, (h - 1) * ONE)[None, :, None]
    xs = np.clip(((2 * np.arange(width) + 1) * w * ONE - width * ONE) // (2 * width), 0, (w - 1) * ONE)[None, None, :]
    shape = (n, height, width)
    return _gather(imgs, np.broadcast_to(ys + top * ONE, shape), np.broadcast_to(xs + left * ONE, shape), top + h - 1, left + w - 1)


def _turned(imgs, k):
    if k % 2 and imgs.shape[1] != imgs.shape[2]:
        # a quarter turn changes the shape, and all rows share one shape
        raise ValueError("a quarter turn needs square pictures")
    return np.rot90(imgs, k, axes=(1, 2))


def batch_step(imgs, st, u):
    """Apply one step to every picture of ``imgs`` (B, H, W, C) with its own
    draws ``u`` (B, N_DRAWS); the caller selects the pictures it applies to."""
    op = st["op"]
    if op == "flip_left_right":
        return imgs[:, :, ::-1]
    if op == "flip_top_bottom":
        return imgs[:, ::-1]
    if op == "flip_random":
        return np.where((u[:, 1] < 0.5)[:, None, None, None], imgs[:, :, ::-1], imgs[:, ::-1])
    if op == "rotate180":
        return _turned(imgs, 2)
    if op == "rotate270":
        return _turned(imgs, 3)
    if op == "rotate_random_90":
        ks = 1 + (u[:, 1] * 3).astype(int)
        out = np.empty_like(imgs)
        for k in (1, 2, 3):
            if (ks == k).any():
                out[ks == k] = _turned(imgs[ks == k], k)
        return out
    if op == "crop_random":
        return _cropped(imgs, u, st.get("area", 0.9))
    one, zero = np.full(len(imgs), ONE), np.zeros(len(imgs), np.int64)
    if op == "rotate":
        angle = np.radians(-st["left"] + u[:, 1] * (st["left"] + st["right"]))
        cos, sin = _fixed(np.cos(angle)), _fixed(np.sin(angle))
        return _affine(imgs, cos, -sin, sin, cos)
    if op == "shear":
        slope = _fixed(np.tan(np.radians(-st["left"] + u[:, 1] * (st["left"] + st["right"]))))
        across = u[:, 2] < 0.5
        return _affine(imgs, one, np.where(across, 0, slope), np.where(across, slope, 0), one)
    if op == "zoom":
        step = _fixed(1.0 / (st["lo"] + u[:, 1] * (st["hi"] - st["lo"])))
        return _affine(imgs, step, zero, zero, step)
    raise ValueError(f"unknown step {op}")


def apply_steps_batch(imgs: np.ndarray, steps, draws: np.ndarray) -> np.ndarray:
    """The pipeline on a whole batch: ``draws`` is (B, steps, N_DRAWS)."""
    out = imgs.astype(np.float64, copy=True)
    for s, st in enumerate(steps):
        sel = draws[:, s, 0] < st["p"]
        if sel.any():
            out[sel] = batch_step(out[sel], st, draws[sel, s])
    return out


def augment(df: DataFrame, height: int, width: int, channels: int, steps=None,
            seed: int = DEFAULT_SEED, key: str = "id", pixels: str = "pixels",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """G1: one augmented picture per input row (pixels as float array).

    Steps that may turn by a quarter need square pictures.
    """
    steps = steps or DEFAULT_STEPS
    if height != width and any(st["op"] in QUARTERS for st in steps):
        raise ValueError("a quarter turn needs square pictures")

    def draw(s: int, k: int) -> Column:
        return hash_unit(seed, key, F.lit(s), F.lit(k))

    if all(st["op"] in SYMMETRIES for st in steps):
        turns, flipped = symmetry(steps, draw)
        moved = move_by_symmetry(F.col(pixels).cast("array<float>"), height, width, channels, turns, flipped)
        return df.select(key, *keep, moved.alias(pixels))

    draws = F.array(*[draw(s, k) for s in range(len(steps)) for k in range(N_DRAWS)])
    src = df.select(key, *keep, F.col(pixels).alias("__px"), draws.alias("__u"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tessera.operators.nn import slices
        for pdf in slices(it, AUGMENT_BATCH):
            imgs = np.stack([np.asarray(px, dtype=np.float64) for px in pdf["__px"]]) \
                .reshape(-1, height, width, channels)
            u = np.stack([np.asarray(x, dtype=np.float64) for x in pdf["__u"]]).reshape(-1, len(steps), N_DRAWS)
            res = apply_steps_batch(imgs, steps, u).astype(np.float32).reshape(len(pdf), -1)
            out = pdf[[key, *keep]].copy()
            out[pixels] = list(res)
            yield out

    schema = T.StructType([src.schema[key], *[src.schema[k] for k in keep],
                           T.StructField(pixels, T.ArrayType(T.FloatType()))])
    return src.mapInPandas(run, schema)
