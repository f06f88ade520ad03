"""Classification of images: preprocessing, model runs, softmax, top class, labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.pixels import let
from tessera.ship import ship

SIDE = 224
#: Fixed values of the model's input: means in B, G, R order, and the scale.
MEANS, SCALE = (104.0, 117.0, 123.0), 0.01


def softmax(logits: Column) -> Column:
    """Percentages of an array of logits; the largest is taken off first, so nothing overflows."""
    exps = lambda best: F.transform(logits, lambda x: F.exp(x - best))
    share = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda v: v / total * 100))
    return let(F.array_max(logits), lambda best: let(exps(best), share))


def top_class(logits: Column) -> Column:
    """class_id and prob of the largest logit, the first among equals."""
    best = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return F.struct((F.array_position(logits, best) - 1).cast("int").alias("class_id"), (F.lit(100.0) / total).alias("prob"))


def label(top: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``name`` and the text "name, prob". Names are one row a class, so Spark's size check lets them be broadcast."""
    return top.join(names, "class_id", "left").withColumn("label", F.format_string("%s, %.3f", "name", "prob"))


def blob(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """1 x 3 x side x side floats in B, G, R order: bilinear to the size, means off, scaled."""
    h, w = rgb.shape[:2]

    def axis(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(h)
    x0, x1, fx = axis(w)
    x = rgb.astype(float)
    rows = x[y0] * (1 - fy)[:, None, None] + x[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return ((out[..., ::-1] - np.array(MEANS)) * SCALE).transpose(2, 0, 1)[None].astype(np.float32)


def blobs(images: DataFrame, side: int = SIDE) -> DataFrame:
    """file_index and the model input of decoded images as one array of 3 x side x side numbers."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                f = batch.slice(k, 1).to_pylist()[0]
                x = blob(np.frombuffer(f["rgb"], np.uint8).reshape(f["height"], f["width"], 3), side)
                yield pa.RecordBatch.from_arrays([pa.array([f["file_index"]], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float32()))], ["file_index", "blob"])

    return images.filter("rgb is not null").select("file_index", "width", "height", "rgb").mapInArrow(run, "file_index int, blob array<float>")


def load_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, read with Spark's readers."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def forward(images: DataFrame, model: bytes, side: int = SIDE) -> DataFrame:
    """file_index and logits of decoded images; one session a task. The model is broadcast: its size is the file's."""
    spark = images.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        session = onnxruntime.InferenceSession(held.value, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for batch in batches:
            keys, logits = [], []
            for f in batch.to_pylist():
                rgb = np.frombuffer(f["rgb"], np.uint8).reshape(f["height"], f["width"], 3)
                keys.append(f["file_index"])
                logits.append(session.run(None, {name: blob(rgb, side)})[0].ravel().astype(float).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(logits, pa.list_(pa.float64()))], ["file_index", "logits"])

    return images.filter("rgb is not null").select("file_index", "width", "height", "rgb").mapInArrow(run, "file_index int, logits array<double>")
