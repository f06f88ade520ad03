"""Command line: decodes files to bitmaps and reports what was done.

    python -m tessera.cli [-m FILES] [-r TASKS] [-s FACTOR] [-w SIDE] [-f] [-S] [-d] [-l LIST] [-o FOLDER] [FILE ...]

Names come from the command line, from a list (-l), or from standard input.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregate, decode, geometry
from tessera.schema import MAX_FILE
from tessera.sources import bmp, files


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera", description="Decode baseline JPEG files to bitmaps.")
    p.add_argument("files", nargs="*", help="files to decode; without any, their names are read from standard input")
    p.add_argument("-l", dest="listed", help="a text file of names, split on line ends and tabs")
    p.add_argument("-m", dest="most", type=int, help="decode at most so many files")
    p.add_argument("-r", dest="tasks", type=int, help="use at most so many tasks at a time")
    p.add_argument("-s", dest="factor", type=int, default=1, choices=(1, 2, 4, 8), help="scale down by this factor")
    p.add_argument("-w", dest="side", type=int, help="scale down, by the least factor that makes images no wider than this")
    p.add_argument("-f", dest="flip", action="store_true", help="mirror images")
    p.add_argument("-S", dest="repeat", action="store_true", help="repeat the last file until there are as many as -m says")
    p.add_argument("-d", dest="relational", action="store_true", help="decode by table operators and report sums, without bitmaps")
    p.add_argument("-o", dest="out", help="folder for the bitmaps")
    found = p.parse_args(argv)
    if found.repeat and found.most is None:
        p.error("-S needs -m")
    return found


def chosen(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """The files in the order in which they are named, gated, limited or repeated."""
    if o.listed:
        names = [r.path for r in files.listed(spark, o.listed).orderBy("file_index").collect()]
    else:
        names = o.files or [n for n in sys.stdin.read().replace("\t", "\n").splitlines() if n]
    # The names are the command's own, so they are on the driver anyway.
    order = spark.createDataFrame([(k, n) for k, n in enumerate(dict.fromkeys(names))], "file_index int, name string")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    found = files.files(spark, names).join(order, plain(F.col("path")) == plain(F.col("name"))).drop("name")
    kept = files.gate(found, MAX_FILE)
    if o.repeat:
        kept = files.replicate(kept, o.most)
    elif o.most is not None:
        kept = files.take(kept, o.most)
    return kept.coalesce(o.tasks) if o.tasks else kept


def run(spark: SparkSession, o: argparse.Namespace) -> list[str]:
    """Decodes, writes, and returns the lines of the report."""
    todo = chosen(spark, o)
    if o.relational:
        sums = aggregate.sum_rgb(decode.decode_relational(todo), "file_index").orderBy("file_index")
        return [f"{r.file_index}: {r.sum_r} {r.sum_g} {r.sum_b}" for r in sums.collect()]
    done = decode.decode(todo)
    if o.side:
        # The factor follows from each image's width.
        wide = [(f, F.ceil(F.col("width") / f) <= o.side) for f in (1, 2, 4)]
        factor = F.lit(8)
        for f, fits in reversed(wide):
            factor = F.when(fits, f).otherwise(factor)
        parts = [geometry.packed(done.filter(factor == f), o.flip, f) for f in (1, 2, 4, 8)]
        images = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(done.filter("width is null"))
    else:
        images = geometry.packed(done, o.flip, o.factor)
    if o.out:
        bmp.register(spark)
        images.select("path", "width", "height", "rgb").write.format("bmp").mode("append").save(o.out)
    t = aggregate.job_totals(done).first()
    lines = [f"{r.path}: {r.error}" for r in done.filter("error is not null").select("path", "error").collect()]
    return [*lines, f"Number of files: {t.files}", f"Failed: {t.failed}", f"Blocks: {t.blocks}", f"Pixels: {t.pixels}", f"Decode time: {t.seconds or 0:.2f}s"]


def main(argv: list[str] | None = None) -> int:
    o = options(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print("\n".join(run(spark, o)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
