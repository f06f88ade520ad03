"""Cropping, box downscaling and mirroring of pixel tables (image, y, x, r, g, b) and block tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.ship import ship

CHANNELS = ("r", "g", "b")


def crop_blocks(blocks: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """An 8-aligned rectangle: a filter on block coordinates, which Spark pushes below the transform."""
    if any(v % 8 for v in (x0, y0, width, height)):
        raise ValueError("crops of blocks must be 8-aligned")
    inside = F.col("brow").between(y0 // 8, (y0 + height) // 8 - 1) & F.col("bcol").between(x0 // 8, (x0 + width) // 8 - 1)
    return blocks.filter(inside).withColumn("brow", F.col("brow") - y0 // 8).withColumn("bcol", F.col("bcol") - x0 // 8)


def crop(pixels: DataFrame, x0: int | Column, y0: int | Column, width: int | Column, height: int | Column) -> DataFrame:
    x0, y0, width, height = (v if isinstance(v, Column) else F.lit(v) for v in (x0, y0, width, height))
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + width) & (F.col("y") >= y0) & (F.col("y") < y0 + height)
    return pixels.filter(inside).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def downscale(pixels: DataFrame, factor: int, key: str = "image") -> DataFrame:
    """Means of factor x factor boxes, rounded down; boxes that the image doesn't fill go. One aggregation with map-side sums."""
    if factor not in (2, 4, 8):
        raise ValueError("factors are 2, 4 and 8")
    shift = factor.bit_length() - 1
    boxes = pixels.groupBy(key, F.shiftright("y", shift).alias("y"), F.shiftright("x", shift).alias("x"))
    sums = boxes.agg(*(F.shiftright(F.sum(c), 2 * shift).cast("int").alias(c) for c in CHANNELS), F.count("*").alias("_n"))
    return sums.filter(F.col("_n") == factor * factor).drop("_n")


def mirror(pixels: DataFrame, width: int | Column) -> DataFrame:
    return pixels.withColumn("x", (width if isinstance(width, Column) else F.lit(width)) - 1 - F.col("x"))


def packed(images: DataFrame, flip: bool = False, factor: int = 1) -> DataFrame:
    """Decoded images mirrored and scaled down where their bytes lie, without a row a pixel; the same pixels as ``mirror`` and ``downscale`` give."""
    if factor not in (1, 2, 4, 8):
        raise ValueError("factors are 1, 2, 4 and 8")
    ship(images.sparkSession)

    def change(x: np.ndarray) -> np.ndarray:
        x = x[:, ::-1] if flip else x
        h, w = (n // factor for n in x.shape[:2])
        return x[: h * factor, : w * factor].reshape(h, factor, w, factor, 3).sum((1, 3), dtype=np.int64) // (factor * factor)

    @F.arrow_udf("binary")
    def changed(rgb: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows = zip(rgb.to_pylist(), width.to_pylist(), height.to_pylist())
        return pa.array([None if r is None else change(np.frombuffer(r, np.uint8).reshape(h, w, 3)).astype(np.uint8).tobytes() for r, w, h in rows], pa.binary())

    sides = {c: F.floor(F.col(c) / factor).cast("int") for c in ("width", "height")}
    return images.withColumn("rgb", changed("rgb", "width", "height")).withColumns(sides)


def round_down(n: Column, multiple: Column) -> Column:
    """The largest multiple * 2^k that is at most n; the multiple itself if n is less."""
    out = multiple
    for k in range(1, 31):
        out = F.when(multiple.cast("long") * (1 << k) <= n, multiple.cast("long") * (1 << k)).otherwise(out)
    return out.cast("int")


def square(width: Column, height: Column, scale: Column) -> dict[str, Column]:
    """Side and start of the centred square crop; starts are rounded up to 8. ok: the square fits."""
    side = round_down(F.least(width, height), scale)
    start = {"x0": F.floor((F.floor((width - side) / 2) + 7) / 8) * 8, "y0": F.floor((F.floor((height - side) / 2) + 7) / 8) * 8}
    start = {k: v.cast("int") for k, v in start.items()}
    fits = (start["x0"] + side <= width) & (start["y0"] + side <= height)
    return {"side": side, **start, "factor": F.floor(side / scale).cast("int"), "ok": fits}


def crop_and_scale(pixels: DataFrame, width: int, height: int, scale: int, key: str = "image") -> DataFrame:
    """The centred square of an image, scaled down to ``scale`` pixels a side by the largest power of two up to 8."""
    side = scale
    while side * 2 <= min(width, height):
        side *= 2
    if side > min(width, height):
        raise ValueError("the square is larger than the image")
    x0, y0 = (-(-((n - side) // 2) // 8) * 8 for n in (width, height))
    if x0 + side > width or y0 + side > height:
        raise ValueError("the square leaves the image")
    cut = crop(pixels, x0, y0, side, side)
    factor = side // scale
    while factor > 1:
        step = min(8, factor)
        cut, factor = downscale(cut, step, key), factor // step
    return cut


def mcu_geometry(width: Column, height: Column, h: Column, v: Column) -> dict[str, Column]:
    """Sizes in blocks, those rounded up to whole units of luma sampling h x v, and the padding of a bitmap row."""
    blocks = lambda n: F.floor((n + 7) / 8).cast("int")
    whole = lambda n, s: n + F.when(s == 2, n % 2).otherwise(0)
    w, d = blocks(width), blocks(height)
    return {"mcu_w": w, "mcu_h": d, "mcu_w_real": whole(w, h), "mcu_h_real": whole(d, v), "bmp_padding": width % 4}
