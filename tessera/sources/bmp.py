"""Bitmaps: 24-bit, bottom-up, rows padded to four bytes; names, encoder, reader and a Spark sink."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.ship import ship
from tessera.sources.sink import FileSink, FileWriter

HEAD = 54
SUFFIX = "-cpu.bmp"


def bmp_name(path: Column, suffix: str = SUFFIX) -> Column:
    """The name with the suffix for its extension; dots in folders don't count."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def sizes(width: Column, height: Column) -> dict[str, Column]:
    """Padding of a row, bytes of the image, bytes of the file."""
    padding = width % 4
    image = (width * 3 + padding) * height
    return {"padding": padding, "image_bytes": image, "file_bytes": image + HEAD, "legacy_bytes": width * height * 3 + HEAD}


def offset(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Where a pixel's blue byte lies in the file; rows are stored from the bottom."""
    return (height - 1 - y) * (width * 3 + width % 4) + x * 3 + HEAD


def encode(rgb: np.ndarray, legacy_size: bool = False) -> bytes:
    """legacy_size: sizes without padding and a body cut to them, as old files have."""
    h, w = rgb.shape[:2]
    pad = w % 4
    body = np.zeros((h, w * 3 + pad), np.uint8)
    body[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    raw = body.tobytes()
    if legacy_size:
        raw = raw[: w * h * 3]
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", HEAD + len(raw), 0, 0, HEAD, 40, w, h, 1, 24, 0, len(raw), 1, 1, 0, 0) + raw


def read(data: bytes) -> np.ndarray:
    """height x width x 3 bytes; a body cut short leaves the top rows black."""
    if data[:2] != b"BM" or len(data) < HEAD:
        raise ValueError("no bitmap")
    start, _, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if bits != 24 or packing:
        raise ValueError("unsupported bitmap")
    step = w * 3 + w % 4
    raw = np.frombuffer(data, np.uint8)[start : start + step * abs(h)]
    body = np.zeros(step * abs(h), np.uint8)
    body[: len(raw)] = raw
    rows = body.reshape(abs(h), step)[:, : w * 3].reshape(abs(h), w, 3)[..., ::-1]
    return np.ascontiguousarray(rows[::-1] if h > 0 else rows)


def with_bmp(images: DataFrame, into: str = "bmp", legacy_size: bool = False) -> DataFrame:
    """Adds the bitmap of decoded images; null where decoding failed."""
    ship(images.sparkSession)

    @F.arrow_udf("binary")
    def make(rgb: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        out = [None if x is None else encode(np.frombuffer(x, np.uint8).reshape(b, a, 3), legacy_size) for x, a, b in zip(rgb.to_pylist(), w.to_pylist(), h.to_pylist())]
        return pa.array(out, pa.binary())

    return images.withColumn(into, make("rgb", "width", "height"))


def read_bmps(files: DataFrame) -> DataFrame:
    """path, width, height, rgb, error of bitmap files."""
    ship(files.sparkSession)
    schema = "path string, width int, height int, rgb binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                try:
                    rgb = read(f["content"])
                    row = (f["path"], rgb.shape[1], rgb.shape[0], rgb.tobytes(), None)
                except (ValueError, struct.error) as e:
                    row = (f["path"], None, None, None, str(e))
                types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["path", "width", "height", "rgb", "error"])

    return files.select("path", "content").mapInArrow(run, schema)


class BmpSource(FileSink):
    """``df.write.format("bmp").save(folder)``: a bitmap for each row of path, width, height, rgb, named after its path below the folder."""

    @classmethod
    def name(cls) -> str:
        return "bmp"

    def schema(self) -> str:
        return "path string, width int, height int, rgb binary"

    def writer(self, schema, overwrite: bool) -> BmpWriter:
        super().writer(schema, overwrite)
        return BmpWriter(self.options)


class BmpWriter(FileWriter):
    def files(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        suffix = self.options.get("suffix", SUFFIX)
        for k in range(batch.num_rows):
            f = batch.slice(k, 1).to_pylist()[0]
            if f["rgb"] is not None:
                yield re.sub(r"\.[^./]*$", "", f["path"]) + suffix, encode(np.frombuffer(f["rgb"], np.uint8).reshape(f["height"], f["width"], 3))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BmpSource)


def write_csv(table: DataFrame, path: str) -> None:
    """Result tables with a header line."""
    table.write.option("header", True).mode("overwrite").csv(path)
