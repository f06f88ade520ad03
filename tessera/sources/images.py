"""Images of any known format as one table: what the bytes begin with decides."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions import jpeg
from tessera.ship import ship
from tessera.sources import bmp, png

PICTURES = "path string, mode string, width int, height int, rgb binary, error string"


def read_any(data: bytes) -> tuple[str, np.ndarray]:
    """(mode, pixels) of a JPEG, PNG or bitmap: mode L has one sample a pixel, RGB three."""
    if data[:8] == png.MAGIC:
        return png.read(data)
    if data[:2] == b"BM":
        return "RGB", bmp.read(data)
    h, rgb, _ = jpeg.decode_image(data)
    return ("L", rgb[..., 0]) if len(h.comps) == 1 else ("RGB", rgb)


def pictures(files: DataFrame) -> DataFrame:
    """path, mode, width, height, rgb (one byte a pixel in mode L), error of files with path and content."""
    ship(files.sparkSession)
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A file at a time: one image is bounded, a batch of them isn't.
            for k in range(batch.num_rows):
                f = batch.slice(k, 1).to_pylist()[0]
                try:
                    mode, px = read_any(f["content"] or b"")
                    row = (f["path"], mode, px.shape[1], px.shape[0], np.ascontiguousarray(px).tobytes(), None)
                except (ValueError, struct.error) as e:
                    row = (f["path"], None, None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in PICTURES.split(", ")])

    return files.select("path", "content").mapInArrow(run, PICTURES)
