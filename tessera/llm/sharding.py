"""Sharding by longest processing time: groups of equal texts, largest first, go to the least loaded shard through a heap.

Groups of one size are a class, and the classes are dealt in falling order, each
as a block: a class gives every shard as many groups as dealing them one by one
would, so loads are those of the exact rule. Which group of a class goes where
makes no difference to any load; they go by the order of their keys' hashes.

Scale: the driver sees one row a size, a size and a count, whatever the number of
groups; there are fewer sizes than the square root of twice all bytes. A block of
any number of equal groups is dealt in a few steps. Ranks within a class and
slots within a shard are counted in hashed parts, so neither a size nor a shard
is one task.

Nulls: a null text has size 8 and is a group of its own; a null id is kept.
Ties: groups of equal size go by the hash of their key, equal loads by shard
number; rows that repeat fill neighbouring slots. Texts only give their size and
their hashes, however long. An empty table gives an empty result. Columns with
names of the result's are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

PARTS = 256


def least_first(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets if every item goes to the least loaded shard, the first among equals.

    Shard k takes items while its load is below a level: below the highest level that doesn't take more than there are, all do as the
    heap would; fewer items than shards are left for the heap.
    """
    below = lambda level: [max(0, -((load - level) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * (count // len(loads) + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(below(mid)) <= count else (low, mid - 1)
    out = below(low)
    heap = [(load + size * n, k) for k, (load, n) in enumerate(zip(loads, out))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):
        load, k = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (load + size, k))
    return out


def longest_first(sizes: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """The rule itself, an item at a time: the shard of each item."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out[item] = k
        heapq.heappush(heap, (load + size, k))
    return out


def by_class(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, how many groups of it each shard gets) of classes (size, count), largest first."""
    loads = [0] * shards
    for size, count in sorted(classes, reverse=True):
        given = least_first(loads, size, count)
        loads = [load + size * n for load, n in zip(loads, given)]
        yield size, given


def _numbered(df: DataFrame, by: str, order: list[Column], part: Column, into: str, parts: int) -> DataFrame:
    """Adds the number of each row among those of equal ``by``, gapless from 0, counted in hashed parts."""
    cut = df.withColumn("_part", F.pmod(part, F.lit(parts)).cast("int"))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(by, "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
    return cut.withColumn("_at", at).join(starts, [by, "_part"]).withColumn(into, F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")


def shard(df: DataFrame, key: str, size: str, shards: int, parts: int = PARTS, order: str = "doc_id") -> DataFrame:
    """Adds shard and slot to a table of rows with a group key and a size above 0; rows of a key stay together."""
    spark = df.sparkSession
    groups = materialize(df.groupBy(key).agg(F.sum(size).alias("_size")), "shard-groups")
    classes = groups.groupBy("_size").agg(F.count("*").alias("n")).collect()
    bounds = []
    for of, given in by_class([(r[0], r[1]) for r in classes], shards):
        upto = 0
        for k, n in enumerate(given):
            if n:
                bounds.append((of, k, upto))
                upto += n
    # One row a size and shard that takes any of it; ranks from ``_first`` on are the shard's, up to the next one's.
    table = spark.createDataFrame(bounds, "_size long, _shard int, _first long").groupBy("_size").agg(F.array_sort(F.collect_list(F.struct("_first", "_shard"))).alias("_takes"))
    ranked = _numbered(groups, "_size", [F.xxhash64(key), F.col(key)], F.shiftright(F.xxhash64(key), 32), "_rank", parts)
    takes = F.filter("_takes", lambda t: t["_first"] <= F.col("_rank"))
    where = ranked.join(table, "_size").select(F.col(key).alias("_group"), F.element_at(takes, -1)["_shard"].alias("shard"))
    placed = df.drop("shard", "slot").join(where, F.col(key) == F.col("_group")).drop("_group")
    return _numbered(placed, "shard", [F.col(order), F.col(key), F.col(size)], F.xxhash64(order, key), "slot", parts).withColumn("slot", F.col("slot").cast("long"))


def shard_documents(df: DataFrame, shards: int = 24, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_group"),
    )
    out = shard(materialize(rows.withColumnRenamed("_group", "_key"), "shard-rows"), "_key", "size", shards, parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
