"""Sums over images, job totals, and the arithmetic of timing reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import CYCLES_PER_SECOND
from tessera.ship import ship


def sum_rgb(pixels: DataFrame, key: str = "image") -> DataFrame:
    return pixels.groupBy(key).agg(*(F.sum(c).alias(f"sum_{c}") for c in ("r", "g", "b")))


def sum_rgb_blocks(blocks: DataFrame, key: str = "image") -> DataFrame:
    """The same from arrays: one row a block enters the aggregation."""
    of = lambda c: F.sum(F.aggregate(c, F.lit(0), lambda a, v: a + v)).alias(f"sum_{c}")
    return blocks.groupBy(key).agg(of("r"), of("g"), of("b"))


def image_sums(images: DataFrame, key: str = "file_index") -> DataFrame:
    """The same from packed images, each summed where its bytes lie; images without bytes go."""
    ship(images.sparkSession)

    @F.arrow_udf("struct<sum_r:long,sum_g:long,sum_b:long>")
    def sums(rgb: pa.Array) -> pa.Array:
        rows = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 3).sum(0, dtype=np.int64) for x in rgb]
        cols = np.array(rows, np.int64).reshape(-1, 3).T
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["sum_r", "sum_g", "sum_b"])

    return images.filter("rgb is not null").select(key, sums("rgb").alias("s")).select(key, "s.*")


def job_totals(decoded: DataFrame) -> DataFrame:
    """Files, failures, blocks, pixels and seconds of decoded images."""
    ok = F.col("error").isNull()
    pixels = F.col("width").cast("long") * F.col("height")
    return decoded.agg(
        F.count("*").alias("files"), F.count_if(~ok).alias("failed"), F.sum("blocks").alias("blocks"), F.sum(F.when(ok, pixels)).alias("pixels"),
        F.sum("elapsed_s").alias("seconds"), F.max("elapsed_s").alias("slowest_s"),
    )


def batch_stats(files: DataFrame, slot: str | None = None) -> DataFrame:
    """Count, total and largest size of files, by slot or for all."""
    totals = [F.count("*").alias("n_files"), F.sum("length").alias("total_bytes"), F.max("length").alias("max_bytes")]
    return files.groupBy(slot).agg(*totals) if slot else files.agg(*totals)


def stats_lines(decoded: DataFrame, slot: str, cycles: str = "cycles") -> DataFrame:
    """slot and the text lines of its report: blocks decoded, and the seconds and cycles taken."""
    total = decoded.groupBy(slot).agg(F.sum("blocks").alias("blocks"), F.sum(cycles).alias("cycles"))
    name = F.concat(F.lit("["), F.col(slot).cast("string"), F.lit("] "))
    lines = F.array(
        F.concat(name, F.format_string("called decode_mcu %d times", "blocks")),
        F.concat(name, F.format_string("total %.5f (%d cycles)", cycles_to_seconds(F.col("cycles")), "cycles")),
    )
    return total.select(slot, F.posexplode(lines).alias("seq", "line"))


def observed(decoded: DataFrame, name: str = "decode") -> DataFrame:
    """The same rows, with counters that Spark reports when an action is done."""
    return decoded.observe(name, F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("blocks").alias("blocks"))


def rate(files: Column, seconds: Column) -> Column:
    """Files a second; null for no time."""
    return F.when(seconds != 0, files / seconds)


def cycles_to_seconds(cycles: Column) -> Column:
    return cycles / F.lit(CYCLES_PER_SECOND)


def timing_share(times: DataFrame, run: str = "run", value: str = "time") -> DataFrame:
    """Long form: each value as a share of its run."""
    total = F.sum(value).over(Window.partitionBy(run))
    return times.withColumn("share", F.when(total != 0, F.col(value) / total))


def timing_share_wide(times: DataFrame, stages: list[str]) -> DataFrame:
    """Wide form: one column a stage."""
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    return times.withColumns({s: F.when(total != 0, F.col(s) / total) for s in stages})
