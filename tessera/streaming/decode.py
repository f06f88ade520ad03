"""The stateless decode plan over a folder that files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.decode import decode
from tessera.sources.files import gate, stream


def decode_stream(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Decoded images as files come; file_index is a hash of the path, as a stream has no list order."""
    return decode(gate(stream(spark, folder, pattern)).withColumn("file_index", F.hash("path")))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.jpg") -> StreamingQuery:
    """Writes decoded images as Parquet, exactly once, until what is there is done."""
    images = decode_stream(spark, folder, pattern)
    return images.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
