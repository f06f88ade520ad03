"""Dealing files to slots: the report of how a round robin with caps packs a file list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import MAX_FILE
from tessera.ship import ship


def slot_assign(files: DataFrame, slots: int, limit: int = MAX_FILE) -> DataFrame:
    """file_index, length, slot, round, filled: round robin in list order over files that pass the gate.

    ``filled`` is the running total of the slot within its batch; a slot takes a
    file only while count and bytes are below their caps, so with one file a
    slot a round is a batch.
    """
    kept = files.filter((F.col("length") > 0) & (F.col("length") <= limit))
    ranked = _ranked(kept)
    out = ranked.withColumn("slot", (F.col("rank") % slots).cast("int")).withColumn("round", F.floor(F.col("rank") / slots).cast("int"))
    filled = F.sum("length").over(Window.partitionBy("slot").orderBy("rank"))
    return out.withColumn("filled", filled).select("file_index", "length", "slot", "round", "filled")


def _ranked(files: DataFrame, parts: int = 1024) -> DataFrame:
    """Adds the rank by file_index. Ranks are counted within ranges of the index and shifted by the ranges before, so no task sees all rows."""
    width = F.col("_width")
    bounds = files.agg(F.min("file_index").alias("_low"), F.greatest(F.lit(1), F.ceil((F.max("file_index") - F.min("file_index") + 1) / parts)).alias("_width"))
    # One row.
    cut = files.join(F.broadcast(bounds)).withColumn("_part", F.floor((F.col("file_index") - F.col("_low")) / width)).drop("_low", "_width")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``parts`` rows.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("file_index")))
    return within.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")


PACKED = "file_index long, length long, rank long, batch long, slot int, place int, start long"


def bin_packing(files: DataFrame, slots: int, per_slot: int = 1, limit: int = MAX_FILE) -> DataFrame:
    """batch, slot, place in the slot and start byte of each file, as a serial packer deals them.

    Files over the limit are left out. The others go to the slots in turn; where the slot whose turn it is holds ``per_slot`` files,
    or would not stay under ``limit`` bytes, the batch is closed and the next begins with its first slot. A file that fills a slot
    alone to the limit can't be dealt and gets no batch, but closes one. What comes before decides each step, so the numbers of the
    files, two for each, pass one task in order; its memory is that of the slots.
    """
    ship(files.sparkSession)
    names = [f.split()[0] for f in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = [0] * slots, [0] * slots
        batch_no = turn = rank = 0
        for rows in batches:
            out = []
            for index, length in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if (held[turn] == per_slot or filled[turn] + length >= limit) and any(held):
                    held, filled, turn, batch_no = [0] * slots, [0] * slots, 0, batch_no + 1
                if length >= limit:
                    out.append((index, length, rank, None, None, None, None))
                else:
                    out.append((index, length, rank, batch_no, turn, held[turn], filled[turn]))
                    held[turn], filled[turn] = held[turn] + 1, filled[turn] + length
                    turn = (turn + 1) % slots
                rank += 1
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)

    kept = files.filter(F.col("length") <= limit).select(F.col("file_index").cast("long").alias("file_index"), F.col("length").cast("long").alias("length"))
    return kept.repartition(1).sortWithinPartitions("file_index").mapInArrow(run, PACKED)
