"""Scoring of decoded images against references: matching, PSNR, SSIM, corruption."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.ship import ship

SUFFIXES = ("-cpu.bmp", "-dpu.bmp")
REFERENCE = r"(?i)\.(jpg|jpeg|png)$"
PSNR_FLOOR, SSIM_FLOOR = 30.0, 0.95


def stem(path: Column) -> Column:
    """The output's name without its suffix."""
    return F.regexp_replace(path, r"-(cpu|dpu)\.bmp$", "")


def outputs(df: DataFrame) -> DataFrame:
    return df.filter(F.col("path").endswith(SUFFIXES[0]) | F.col("path").endswith(SUFFIXES[1]))


def match_references(out: DataFrame, refs: DataFrame, numbered: bool = False) -> DataFrame:
    """out_path, ref_path: for each output the reference whose name starts with its stem.

    The exact stem comes first, then the shortest, then the first name. Names
    and, where no name fits, their prefixes are keys, so joins are on equal
    values; the directory is part of the name. Where files are numbered, a stem
    doesn't end within a number: img3 fits img3x.png, but not img30.png.
    """
    left = out.select(F.col("path").alias("out_path"), stem(F.col("path")).alias("stem"))
    folder = F.length(F.regexp_extract("ref_path", r"^(.*/)?", 1))
    names = refs.select(F.col("path").alias("ref_path")).filter(F.col("ref_path").rlike(REFERENCE))
    first = F.min(F.struct(F.length("ref_path").alias("n"), "ref_path"))
    whole = names.groupBy(F.regexp_replace("ref_path", REFERENCE, "").alias("stem")).agg(first.alias("r"))
    exact = left.join(whole, "stem", "left")
    # Prefixes are made only for outputs that no whole name fits.
    rest = exact.filter("r is null").select("out_path", "stem")
    prefixes = names.withColumn("n", F.explode(F.sequence(folder + 1, F.length("ref_path"))))
    if numbered:
        prefixes = prefixes.filter("not substring(ref_path, n, 2) rlike '^[0-9]{2}$'")
    prefixes = prefixes.select("ref_path", F.expr("substring(ref_path, 1, n)").alias("stem"))
    near = prefixes.join(rest.select("stem").distinct(), "stem").groupBy("stem").agg(first.alias("r"))
    found = exact.filter("r is not null").select("out_path", "r").unionByName(rest.join(near, "stem", "left").select("out_path", "r"))
    return found.select("out_path", F.col("r.ref_path").alias("ref_path"))


def missing_references(out: DataFrame, refs: DataFrame) -> DataFrame:
    return match_references(out, refs).filter("ref_path is null").select("out_path")


def psnr(mse: Column) -> Column:
    """10 log10(255^2 / mse); infinite for equal images."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def psnr_channels(a: DataFrame, b: DataFrame, key: str = "image") -> DataFrame:
    """PSNR per channel of two tables of blocks (brow, bcol and r, g, b arrays of 64), and their mean; squares are summed as integers, within a block first."""
    channels = ("r", "g", "b")
    other = b.select(key, "brow", "bcol", *(F.col(c).alias(f"{c}2") for c in channels))
    square = lambda c: F.aggregate(F.zip_with(c, f"{c}2", lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    diffs = a.join(other, [key, "brow", "bcol"]).select(key, F.size("r").alias("n"), *(square(c).alias(f"s_{c}") for c in channels))
    sums = diffs.groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(f"s_{c}").alias(f"s_{c}") for c in channels))
    out = sums.select(key, *(psnr(F.col(f"s_{c}").cast("double") / F.col("n")).alias(f"psnr_{c}") for c in channels))
    return out.withColumn("psnr", (F.col("psnr_r") + F.col("psnr_g") + F.col("psnr_b")) / 3)


def corrupted(mean_psnr: Column, mean_ssim: Column | None = None, least_psnr: float = PSNR_FLOOR, least_ssim: float = SSIM_FLOOR) -> Column:
    low = mean_psnr < least_psnr
    return low if mean_ssim is None else low | (mean_ssim < least_ssim)


#: Rec. 601 weights in 16-bit fixed point.
LUMA = (19595, 38470, 7471)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 grey of RGB, in 16-bit fixed point."""
    return F.shiftright(sum((x * w for x, w in zip((g, b), LUMA[1:])), r * LUMA[0]) + 0x8000, 16)


def np_luma(rgb: np.ndarray) -> np.ndarray:
    """The same of an array whose last axis is R, G, B."""
    return rgb.astype(np.int64) @ np.array(LUMA) + 0x8000 >> 16


# -- numpy -------------------------------------------------------------------

C1, C2, SIDE = (0.01 * 255) ** 2, (0.03 * 255) ** 2, 7


def _boxes(x: np.ndarray) -> np.ndarray:
    """Sums of all whole 7 x 7 windows, from a table of running sums."""
    t = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    t[1:, 1:] = x.cumsum(0).cumsum(1)
    return t[SIDE:, SIDE:] - t[:-SIDE, SIDE:] - t[SIDE:, :-SIDE] + t[:-SIDE, :-SIDE]


def np_ssim(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean structural similarity with a uniform window and sample covariances; None below 7 pixels."""
    if min(a.shape) < SIDE:
        return None
    a, b, n = a.astype(float), b.astype(float), SIDE * SIDE
    ma, mb = _boxes(a) / n, _boxes(b) / n
    va, vb, cov = ((_boxes(x * y) / n - mx * my) * n / (n - 1) for x, y, mx, my in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    return float((((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma**2 + mb**2 + C1) * (va + vb + C2))).mean())


def np_psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = float(((a.astype(float) - b.astype(float)) ** 2).mean())
    return float("inf") if mse == 0 else 10 * float(np.log10(65025 / mse))


def ssim_block(a: Column, b: Column) -> Column:
    """Mean similarity of two 8 x 8 blocks over the four places of the 7 x 7 window; sums are integers up to the last division."""
    z = F.arrays_zip(a.alias("a"), b.alias("b"), F.sequence(F.lit(0), F.lit(63)).alias("k"))

    def at(oy: int, ox: int) -> Column:
        row, col = (lambda p: F.shiftright(p.k, 3)), (lambda p: p.k % 8)
        inside = F.filter(z, lambda p: row(p).between(oy, oy + 6) & col(p).between(ox, ox + 6))
        total = lambda f: F.aggregate(inside, F.lit(0).cast("long"), lambda s, p: s + f(p)).cast("double")
        n = 49.0
        sa, sb = total(lambda p: p.a), total(lambda p: p.b)
        va = (total(lambda p: p.a * p.a) - sa * sa / n) / (n - 1)
        vb = (total(lambda p: p.b * p.b) - sb * sb / n) / (n - 1)
        cov = (total(lambda p: p.a * p.b) - sa * sb / n) / (n - 1)
        ma, mb = sa / n, sb / n
        return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))

    return (at(0, 0) + at(0, 1) + at(1, 0) + at(1, 1)) / 4


SCORES = "key string, ssim_r double, ssim_g double, ssim_b double, ssim double, psnr_r double, psnr_g double, psnr_b double, psnr double, reason string"


def score(pairs: DataFrame, least_psnr: float = PSNR_FLOOR, least_ssim: float = SSIM_FLOOR, with_ssim: bool = True) -> DataFrame:
    """Scores of pairs (key, width, height, rgb, ref_width, ref_height, ref_rgb, and ref_mode: RGB or L).

    A grey reference has one score for all channels, against the luma of the
    output. Pairs that can't be compared have a reason and no scores.
    """
    ship(pairs.sparkSession)

    def one(p: dict) -> tuple:
        if p["rgb"] is None or p["ref_rgb"] is None:
            return (*[None] * 8, "undecodable")
        if p["ref_mode"] not in ("RGB", "L"):
            return (*[None] * 8, "unsupported mode")
        if (p["width"], p["height"]) != (p["ref_width"], p["ref_height"]):
            return (*[None] * 8, "size mismatch")
        a, b = (np.frombuffer(x, np.uint8).reshape(p["height"], p["width"], -1) for x in (p["rgb"], p["ref_rgb"]))
        if p["ref_mode"] == "L":
            grey = np_luma(a) if a.shape[2] == 3 else a[..., 0]
            planes = [(grey, b[..., 0])] * 3
        elif a.shape != b.shape:
            return (*[None] * 8, "shape mismatch")
        else:
            planes = [(a[..., k], b[..., k]) for k in range(3)]
        s = [np_ssim(*x) for x in planes] if with_ssim else [None] * 3
        q = [np_psnr(*x) for x in planes]
        small = with_ssim and s[0] is None
        return (*s, None if s[0] is None else sum(s) / 3, *q, sum(q) / 3, "side below 7 pixels" if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p = batch.slice(k, 1).to_pylist()[0]
                row = (p["key"], *one({"ref_mode": "RGB"} | p))
                types = [pa.string(), *[pa.float64()] * 8, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [f.split()[0] for f in SCORES.split(", ")])

    scored = pairs.mapInArrow(run, SCORES)
    bad = corrupted(F.col("psnr"), F.col("ssim") if with_ssim else None, least_psnr, least_ssim)
    return scored.withColumn("corrupted", bad)


def quality_table(pairs: DataFrame, with_ssim: bool = True, **floors: float) -> DataFrame:
    """The result table of scored pairs, in the layout of the CSV; the SSIM columns are left out where it isn't asked for."""
    # Outputs may share a reference, so their own paths tell the pairs apart.
    names = pairs.select(F.col("key").alias("image"), "out_path", "ref_path")
    s = score(pairs.withColumn("key", F.col("out_path")), with_ssim=with_ssim, **floors).withColumnRenamed("key", "out_path").join(names, "out_path")
    ssim = [F.col(c).alias(n) for c, n in (("ssim_r", "SSIM-R"), ("ssim_g", "SSIM-G"), ("ssim_b", "SSIM-B"), ("ssim", "SSIM"))] if with_ssim else []
    cols = ["image", "corrupted", *ssim, *(F.col(c).alias(n) for c, n in (("psnr_r", "PSNR-R"), ("psnr_g", "PSNR-G"), ("psnr_b", "PSNR-B"), ("psnr", "PSNR")))]
    return s.filter("reason is null").select(*cols, F.col("ref_path").alias("reference path"), F.col("out_path").alias("output path"))


def skips(pairs: DataFrame) -> DataFrame:
    """out_path and why it has no scores, null where it has some; one row an output."""
    scored = score(pairs.filter("ref_path is not null").withColumn("key", F.col("out_path")), with_ssim=False).select(F.col("key").alias("out_path"), "reason")
    lacking = pairs.filter("ref_path is null").select("out_path", F.lit("no reference").alias("reason"))
    return scored.unionByName(lacking)
