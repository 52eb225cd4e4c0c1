"""Image folders: list (S2), decode and resize (S3), and a PNG writer for
fixtures.  The label of a picture is its parent folder name."""

from __future__ import annotations

import struct
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import ALLOWED_IMAGE_EXTENSIONS, label_from_path
from tessera.sources.files import write_files


def _glob(extensions) -> str:
    return "*.{" + ",".join(extensions) + "}"


def scan_images(spark: SparkSession, path: str, extensions=ALLOWED_IMAGE_EXTENSIONS) -> DataFrame:
    """``(path, length, label)`` of the picture files below ``path``.

    The extension filter is a glob pushed into the file listing; the file
    content column is not selected, so no picture is read.
    """
    files = (spark.read.format("binaryFile")
             .option("pathGlobFilter", _glob(extensions))
             .option("recursiveFileLookup", "true")
             .load(path)
             .select("path", "length"))
    return files.withColumn("label", label_from_path("path"))


def _resize(imgs: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resize of a batch (B, H, W, C) to (B, h, w, C), pixel centres aligned."""
    H, W = imgs.shape[1:3]
    a = imgs.astype(np.float64)
    if (H, W) == (h, w):
        return a
    ys = np.clip((np.arange(h) + 0.5) * H / h - 0.5, 0, H - 1)
    xs = np.clip((np.arange(w) + 0.5) * W / w - 0.5, 0, W - 1)
    y0 = np.floor(ys).astype(int); x0 = np.floor(xs).astype(int)
    y1 = np.minimum(y0 + 1, H - 1); x1 = np.minimum(x0 + 1, W - 1)
    fy = (ys - y0)[None, :, None, None]; fx = (xs - x0)[None, None, :, None]
    top = a[:, y0][:, :, x0] * (1 - fx) + a[:, y0][:, :, x1] * fx
    bot = a[:, y1][:, :, x0] * (1 - fx) + a[:, y1][:, :, x1] * fx
    return top * (1 - fy) + bot * fy


def load_images(spark: SparkSession, path: str, height: int = 32, width: int = 32, channels: int = 3,
                extensions=ALLOWED_IMAGE_EXTENSIONS, invalid: str = "raise") -> DataFrame:
    """S3: decode pictures (Spark's JVM image source, BGR order) and resize
    to ``height x width x channels`` on the executors.

    Rows ``(path, label, height, width, channels, pixels array<int>)`` with
    values 0..255; grey pictures are repeated over the channels, coloured ones
    asked for in one channel become their luminance, and an alpha channel is
    left out.  A listed file that does not decode raises, naming its path;
    with ``invalid="null"`` it is a row without pixels.
    """
    if invalid not in ("raise", "null"):
        raise ValueError(f"invalid: {invalid}")
    raw = (spark.read.format("image")
           .option("pathGlobFilter", _glob(extensions))
           .option("recursiveFileLookup", "true")
           .load(path)
           .select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"),
                   F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"),
                   F.col("image.data").alias("data")))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tessera.operators.nn import slices
        for pdf in slices(it, 1024):
            outs = [None] * len(pdf)
            # pictures of one shape are resized together
            for (h, w, c), idx in pdf.groupby(["h", "w", "c"]).indices.items():
                if h < 0:
                    if invalid == "raise":
                        raise ValueError(f"not a picture that can be decoded: {pdf['path'].iat[idx[0]]}")
                    continue
                imgs = np.stack([np.frombuffer(bytes(pdf["data"].iat[i]), dtype=np.uint8) for i in idx]) \
                    .reshape(len(idx), int(h), int(w), int(c))
                if c > 1 and channels == 1:  # BT.601 luminance of blue, green, red
                    imgs = np.rint(imgs[..., :3] @ np.array([0.114, 0.587, 0.299]))[..., None]
                elif c > channels:
                    imgs = imgs[..., :channels]
                elif c < channels:
                    imgs = np.repeat(imgs[..., :1], channels, axis=3)
                res = np.clip(np.rint(_resize(imgs, height, width)), 0, 255).astype(np.int32)
                for j, i in enumerate(idx):
                    outs[i] = res[j].ravel()
            yield pd.DataFrame({"path": pdf["path"].to_numpy(), "pixels": outs})

    out = raw.mapInPandas(run, "path string, pixels array<int>")
    return out.select("path", label_from_path("path").alias("label"),
                      F.lit(height).alias("height"), F.lit(width).alias("width"),
                      F.lit(channels).alias("channels"), "pixels")


def png_bytes(gray: np.ndarray) -> bytes:
    """Encode a (H, W) uint8 grey picture as PNG (stdlib only)."""
    h, w = gray.shape
    raw = b"".join(b"\x00" + gray[r].astype(np.uint8).tobytes() for r in range(h))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_png_folders(df: DataFrame, path: str, height: int, width: int, pixels: str = "pixels",
                      label: str = "label", id_col: str = "id") -> str:
    """Write every row as ``<path>/<label>/<id>.png`` from the executors, all
    files or none (fixtures for S2/S3)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pics = [png_bytes(np.clip(np.asarray(px, dtype=np.int64).reshape(height, width), 0, 255).astype(np.uint8)) for px in pdf[pixels]]
            yield pd.DataFrame({"folder": pdf[label].astype(str), "name": pdf[id_col].astype(str) + ".png", "data": pics})

    made = df.select(id_col, label, pixels).mapInPandas(run, "folder string, name string, data binary")
    return write_files(made, path)


__all__ = ["scan_images", "load_images", "png_bytes", "write_png_folders"]
