"""Decoding as table operators: header catalogue, coefficient blocks, images.

Files are independent and so are restart segments; one file is one task's work
for the fused path. Malformed files give a row with the reason, never an error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions import jpeg, pixels
from tessera.schema import COEFFS, HEADER, IMAGES, MARKERS
from tessera.ship import ship


def _mapped(df: DataFrame, rows_of, schema: str, *more: str) -> DataFrame:
    """rows_of(file_index, path, content, and the columns more) yields tuples of the schema."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A file at a time: one image is bounded, a batch of them isn't.
            for k in range(batch.num_rows):
                f = batch.slice(k, 1).to_pylist()[0]
                rows = list(rows_of(f["file_index"], f["path"], f["content"] or b"", *(f[m] for m in more)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return df.select("file_index", "path", "content", *more).mapInArrow(run, schema)


def soi(content: str = "content"):
    """Whether the file begins as an image; a plain Column, so it prunes before any Python."""
    return F.substring(content, 1, 2) == F.lit(b"\xff\xd8")


def _header(index: int, path: str, data: bytes) -> Iterator[tuple]:
    try:
        h = jpeg.gated_header(data)
    except jpeg.Invalid as e:
        yield (index, path, False, str(e), *[None] * 23)
        return
    g = h.geometry()
    tables = lambda t: [(k, {"counts": c, "symbols": s}) for k, (c, s) in sorted(t.items())]
    yield (
        index, path, True, None, h.width, h.height, len(h.comps), h.restart_interval, *h.spectral, h.comps, sorted(h.qt.items()), tables(h.dc), tables(h.ac),
        g["mcu_w"], g["mcu_h"], g["mcu_w_real"], g["mcu_h_real"], g["max_h"], g["max_v"], g["bmp_padding"], h.data_start, h.warnings, len(h.comps) == 2, h.decoded_bytes,
    )


def headers(df: DataFrame) -> DataFrame:
    """The header catalogue: one row a file, ``valid`` or with the first rule it breaks."""
    return _mapped(df, _header, HEADER)


def valid(df: DataFrame) -> DataFrame:
    return df.filter("valid")


def marker_table(df: DataFrame) -> DataFrame:
    """file_index, seq, code, offset, length of the segments before the scan; none of files that aren't valid up to there."""

    def rows(index: int, path: str, data: bytes) -> Iterator[tuple]:
        try:
            for k, (code, offset, length, _) in enumerate(jpeg.markers(data)):
                yield index, k, code, offset, length
        except jpeg.Invalid:
            return

    return _mapped(df, rows, MARKERS)


def coefficients(df: DataFrame) -> DataFrame:
    """One row a block in stream order, DC still a difference, with what later steps need of the header; a broken scan gives one row with the reason."""

    def rows(index: int, path: str, data: bytes) -> Iterator[tuple]:
        try:
            h = jpeg.gated_header(data)
            zz, keys = jpeg.decode_scan(data, h)
        except jpeg.Invalid as e:
            yield (index, *[None] * 11, str(e))
            return
        yield from _blocks(index, h, zz.tolist(), keys.tolist())

    return _mapped(df, rows, COEFFS)


def segment_coefficients(df: DataFrame, parts: int) -> DataFrame:
    """The same with restart segments as rows, so one file is the work of several tasks; ``parts`` partitions share them."""
    cut = df.filter(soi()).select("file_index", "path", "content")
    counted = _mapped(cut, lambda i, p, data: _segments(i, data), "file_index int, segments int").join(cut, "file_index")
    each = counted.select("file_index", "path", "content", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("seg")).repartition(parts, "file_index", "seg")

    def rows(index: int, path: str, data: bytes, seg: int) -> Iterator[tuple]:
        try:
            h = jpeg.gated_header(data)
            zz, keys = jpeg.decode_scan(data, h, seg)
        except jpeg.Invalid as e:
            yield (index, *[None] * 11, str(e))
            return
        yield from _blocks(index, h, zz.tolist(), keys.tolist())

    return _mapped(each, rows, COEFFS, "seg")


def _segments(index: int, data: bytes) -> Iterator[tuple]:
    try:
        h = jpeg.gated_header(data)
        per = h.restart_interval * len(jpeg.scan_shape(h)) or jpeg.block_count(h)
        yield index, -(-jpeg.block_count(h) // per)
    except jpeg.Invalid:
        yield index, 1


def _blocks(index: int, h: jpeg.Header, zz: list, keys: list) -> Iterator[tuple]:
    tables = [h.qt[c["tq"]] for c in h.comps]
    for block, key in zip(zz, keys):
        yield (index, *key, block, tables[key[2]], h.max_h, h.max_v, h.width, h.height, None)


PIECES = "file_index int, piece int, bit long, zz array<int>, until long"


def piece_coefficients(df: DataFrame, pieces: int) -> DataFrame:
    """The same for scans without restarts: pieces of equal bytes are decoded from their first bit, and joined where they agree.

    Each piece tells from which bit the next one's blocks count. What counts, in the order of bits, is the scan, so a block's number
    is its rank, and the rank gives its place. A file is at most 16 MiB, so ranks by file are bounded.
    """
    each = df.filter(soi()).select("file_index", "path", "content", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")).repartition(F.col("file_index"), F.col("piece"))

    def rows(index: int, path: str, data: bytes, piece: int) -> Iterator[tuple]:
        try:
            h = jpeg.gated_header(data)
            if not h.restart_interval:
                blocks, until = jpeg.decode_piece(data, h, piece, pieces)
                # A piece without blocks still tells where the next begins to count.
                yield index, piece, None, None, until
                for bit, block in blocks:
                    yield index, piece, bit, block, until
        except jpeg.Invalid:
            return

    found = _mapped(each, rows, PIECES, "piece")
    before = Window.partitionBy("file_index").orderBy("piece").rangeBetween(Window.unboundedPreceding, -1)
    counted = found.withColumn("_from", F.coalesce(F.max("until").over(before), F.lit(0))).filter("bit is not null and bit >= _from")
    ranked = counted.withColumn("block", F.row_number().over(Window.partitionBy("file_index").orderBy("bit")) - 1)
    heads = headers(df).filter("valid").select("file_index", F.size("comps").alias("_n"), "comps", "qt", "mcu_w_real", "mcu_h_real", "max_h", "max_v", "width", "height")
    unit = F.flatten(F.transform("comps", lambda c, k: F.flatten(F.transform(F.sequence(F.lit(0), c["v"] - 1), lambda y: F.transform(F.sequence(F.lit(0), c["h"] - 1), lambda x: F.struct(k.alias("comp"), y.alias("y"), x.alias("x"), (y * c["h"] + x).alias("nth"), (c["v"] * c["h"]).alias("size"), c["tq"].alias("tq")))))))
    placed = ranked.join(heads.withColumn("unit", unit), "file_index")
    across = F.expr("mcu_w_real div max_h")
    placed = placed.withColumn("mcu", F.expr("block div size(unit)")).withColumn("u", F.col("unit")[(F.col("block") % F.size("unit")).cast("int")]).filter(F.col("mcu") < across * F.expr("mcu_h_real div max_v"))
    at = lambda up, by, c: (up * F.col(by) + F.col(c)).cast("int")
    return placed.select(
        "file_index", at(F.floor(F.col("mcu") / across), "max_v", "u.y").alias("brow"), at(F.col("mcu") % across, "max_h", "u.x").alias("bcol"), F.col("u.comp").alias("comp"),
        at(F.col("mcu"), "u.size", "u.nth").alias("scan_idx"), F.lit(0).alias("restart_seg"), "zz", F.element_at("qt", F.col("u.tq")).alias("q"), "max_h", "max_v", "width", "height", F.lit(None).cast("string").alias("error"),
    )


def predict_dc(coeffs: DataFrame) -> DataFrame:
    """DC from differences: a running sum per component and restart segment."""
    order = Window.partitionBy("file_index", "comp", "restart_seg").orderBy("scan_idx")
    dc = pixels.wrap16(F.sum(F.col("zz")[0]).over(order).cast("int"))
    return coeffs.filter("error is null").drop("error").withColumn("zz", F.concat(F.array(dc), F.slice("zz", 2, 63)))


def transformed(df: DataFrame, block: str, into: str, table: str | None = None, accuracy: str = "high") -> DataFrame:
    """Adds the samples of a column of natural-order blocks, times a column of quantizers if there is one; an Arrow batch is one array."""
    ship(df.sparkSession)

    @F.arrow_udf("array<int>")
    def samples_of(blocks: pa.Array, quants: pa.Array) -> pa.Array:
        c, q = (a.flatten().to_numpy(zero_copy_only=False).reshape(-1, 64) for a in (blocks, quants))
        px = pixels.np_idct(pixels.np_wrap16(c.astype(np.int64) * q), accuracy)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, px.size + 1, 64, dtype=np.int32)), pa.array(px.ravel().astype(np.int32)))

    return df.withColumn(into, samples_of(block, table or F.array_repeat(F.lit(1), 64)))


def transformed_exactly(df: DataFrame, block: str, into: str) -> DataFrame:
    """Adds the samples by the transform with real cosines."""
    ship(df.sparkSession)

    @F.arrow_udf("array<double>")
    def samples_of(blocks: pa.Array) -> pa.Array:
        px = pixels.np_idct_float(blocks.flatten().to_numpy(zero_copy_only=False).reshape(-1, 64))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, px.size + 1, 64, dtype=np.int32)), pa.array(px.ravel()))

    return df.withColumn(into, samples_of(block))


def samples(coeffs: DataFrame) -> DataFrame:
    """Blocks with px: dequantized and transformed."""
    natural = predict_dc(coeffs).withColumn("c", pixels.dezigzag(F.col("zz")))
    return transformed(natural, "c", "px", "q").drop("zz", "c", "q")


def rgb_blocks(blocks: DataFrame) -> DataFrame:
    """file_index, brow, bcol and r, g, b arrays of 64: chroma is taken from the block of the same unit, nearest sample.

    Missing chroma is 0, so a grey image has equal channels.
    """
    unit = [F.floor(F.col("brow") / F.col("max_v")).cast("int").alias("urow"), F.floor(F.col("bcol") / F.col("max_h")).cast("int").alias("ucol")]
    extra = [c for c in ("width", "height") if c in blocks.columns]
    # At most four luma blocks a unit.
    lumas = F.collect_list(F.when(F.col("comp") == 0, F.struct("brow", "bcol", "max_h", "max_v", *extra, F.col("px").alias("y"))))
    chroma = [F.max(F.when(F.col("comp") == n, F.col("px"))).alias(c) for n, c in ((1, "cb"), (2, "cr"))]
    luma = blocks.select("*", *unit).groupBy("file_index", "urow", "ucol").agg(lumas.alias("l"), *chroma).select("file_index", F.explode("l").alias("l"), "cb", "cr").select("file_index", "l.*", "cb", "cr")
    none = F.array_repeat(F.lit(0), 64)
    luma = luma.withColumns({"cb": F.coalesce("cb", none), "cr": F.coalesce("cr", none)})

    def near(name: str):
        def at(k):
            row = F.floor((F.shiftright(k, 3) + 8 * (F.col("brow") % F.col("max_v"))) / F.col("max_v"))
            col = F.floor((k % 8 + 8 * (F.col("bcol") % F.col("max_h"))) / F.col("max_h"))
            return F.element_at(name, (row * 8 + col + 1).cast("int"))

        return F.transform(F.sequence(F.lit(0), F.lit(63)), at)

    luma = luma.select("file_index", "brow", "bcol", *extra, "y", near("cb").alias("cb"), near("cr").alias("cr"))
    return colour(luma)


def colour(df: DataFrame) -> DataFrame:
    """Columns y, cb, cr of 64 samples to r, g, b."""
    keys = [c for c in df.columns if c not in ("y", "cb", "cr")]
    z = F.arrays_zip("y", "cb", "cr")
    return df.select(
        *keys, F.transform(z, lambda p: pixels.red(p.y, p.cr)).alias("r"), F.transform(z, lambda p: pixels.green(p.y, p.cb, p.cr)).alias("g"),
        F.transform(z, lambda p: pixels.blue(p.y, p.cb)).alias("b"),
    )


def block_pixels(df: DataFrame, width: str | None = "width", height: str | None = "height") -> DataFrame:
    """Blocks with r, g, b arrays to one row a pixel: y, x, r, g, b; pixels outside the image go."""
    keys = [c for c in df.columns if c not in ("brow", "bcol", "r", "g", "b", width, height)]
    out = df.select(*keys, "brow", "bcol", *([width, height] if width else []), F.posexplode(F.arrays_zip("r", "g", "b")).alias("k", "p"))
    out = out.withColumn("y", F.col("brow") * 8 + F.shiftright("k", 3)).withColumn("x", F.col("bcol") * 8 + F.col("k") % 8)
    if width:
        out = out.filter((F.col("x") < F.col(width)) & (F.col("y") < F.col(height)))
    return out.select(*keys, "y", "x", "p.r", "p.g", "p.b")


def decode_relational(df: DataFrame) -> DataFrame:
    """file_index, y, x, r, g, b of all valid files, by table operators after the entropy decoder; files are read and parsed once."""
    return block_pixels(rgb_blocks(samples(coefficients(df))))


def decode(df: DataFrame) -> DataFrame:
    """The fused path: packed rows of R, G, B bytes a file, or the reason; narrow, so it streams as well."""

    def rows(index: int, path: str, data: bytes) -> Iterator[tuple]:
        began = time.perf_counter()
        try:
            h, rgb, blocks = jpeg.decode_image(data)
        except jpeg.Invalid as e:
            yield index, path, None, None, None, str(e), time.perf_counter() - began, 0
            return
        yield index, path, h.width, h.height, rgb.tobytes(), None, time.perf_counter() - began, blocks

    return _mapped(df, rows, IMAGES)
