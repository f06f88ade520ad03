"""Stacked bars of shares, as a table of what to draw and as a PNG."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import png
from tessera.sources.sink import located

BAR, GAP, WIDTH = 24, 8, 400


def percent(share: Column) -> Column:
    """The text of a share above 0.1 in percent, with one decimal as C's printf rounds: by the exact value, ties to even.

    Java's formatter rounds up from the shortest decimal form, so 16.25 and 11.95 (which is 11.949999...) come out otherwise.
    """
    value = share * 100
    whole = F.floor(value)
    # Above 8 a double has no bits below 2^-49, so all steps are exact.
    tenfold = ((value - whole) * 2**49).try_cast("long") * 10
    digit, rest = F.shiftright(tenfold, 49), tenfold.bitwiseAND(F.lit(2**49 - 1))
    up = (rest > 2**48) | ((rest == 2**48) & (digit % 2 == 1))
    digit = digit + up.cast("long")
    return F.format_string("%d.%d%%", whole + F.floor(digit / 10), digit % 10)


def bars(shares: DataFrame, run: str, stages: list[str], width: int = WIDTH) -> DataFrame:
    """run, stage, x0, x1, text: each stage's part of a bar of ``width`` pixels, with its percentage where that is over 10."""

    def edge(k: int) -> Column:
        total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages[:k]), F.lit(0.0))
        return F.floor(total * width + 0.5)

    share = F.coalesce(F.col("share"), F.lit(0.0))
    parts = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(s).alias("stage"), edge(k).alias("x0"), edge(k + 1).alias("x1"), F.col(s).alias("share")) for k, s in enumerate(stages)))
    out = shares.select(run, F.explode(parts).alias("p")).select(run, "p.*")
    return out.withColumn("text", F.when(share > 0.1, percent(share))).drop("share")


def draw(table: DataFrame, run: str, path: str, width: int = WIDTH) -> int:
    """Writes the bars of a report as a PNG and returns their number. A plot is a page: its runs, one bar each, are read to the driver."""
    rows = table.orderBy(run, "seq").collect()
    runs = sorted({r[run] for r in rows})
    canvas = np.full((max(1, len(runs)) * (BAR + GAP) + GAP, width, 3), 255, np.uint8)
    for r in rows:
        top = GAP + runs.index(r[run]) * (BAR + GAP)
        # Colours are steps around the wheel, so any number of stages differ.
        turn = r["seq"] * 0.618 % 1 * 6 + np.array([0, 4, 2])
        canvas[top : top + BAR, r["x0"] : r["x1"]] = (np.clip(np.abs(turn % 6 - 3) - 1, 0, 1) * 200 + 30).astype(np.uint8)
    system, target = located(path)
    with system.open_output_stream(target) as out:
        out.write(png.encode(canvas))
    return len(runs)
