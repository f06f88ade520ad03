"""Canonical codes as table operators: codes from lengths, symbols from windows of bits, places from runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n)


def canonical_codes(table: DataFrame) -> DataFrame:
    """table (tbl, j, len, symbol) with code, and lo and hi: the 16-bit windows that begin with the code."""
    before = Window.partitionBy("tbl").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    room = power(16 - F.col("len"))
    lo = F.coalesce(F.sum(room).over(before), F.lit(0)).cast("int")
    out = table.withColumn("lo", lo).withColumn("hi", F.col("lo") + room - 1)
    return out.withColumn("code", F.expr("shiftright(lo, 16 - len)"))


def lookup(windows: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds symbol and len to windows (tbl, peek); windows that no code begins go.

    Codes are told by the first eight bits of the windows they begin: a code of up to eight bits has each of its bytes alone, so only
    longer codes that share a byte are compared. Spark broadcasts the codes where their size allows.
    """
    byte = F.explode(F.sequence(F.shiftright("lo", 8), F.shiftright("hi", 8)))
    near = codes.select("tbl", "lo", "hi", "symbol", "len", byte.alias("_byte"))
    keyed = windows.withColumn("_byte", F.shiftright(F.col("peek").cast("int"), 8))
    return keyed.join(near, ["tbl", "_byte"]).filter(F.col("peek").between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "_byte")


def run_positions(runs: DataFrame, key: str, order: str) -> DataFrame:
    """Adds pos, the place of the coefficient that each run of zeros ends at; rows past 63 go."""
    until = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("pos", F.sum(F.col("run") + 1).over(until)).filter("pos <= 63")
