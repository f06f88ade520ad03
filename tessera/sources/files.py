"""File sources: lists of paths, whole files as binary rows, and the gates on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schema import MAX_FILE


def files(spark: SparkSession, paths: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """path, length, content of regular files, empty ones as well; missing paths are left out, see ``missing``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    wanted = [paths] if isinstance(paths, str) else existing(spark, paths)
    if not wanted:
        return spark.createDataFrame([], "path string, length long, content binary")
    found = reader.load(wanted)
    return found.select("path", "length", "content").unionByName(empty(found))


def empty(found: DataFrame) -> DataFrame:
    """The empty files, which Spark lists but doesn't read: what it listed without what it reads. Spark's own list is on the driver, too."""
    spark = found.sparkSession
    plain = lambda p: F.regexp_replace(p, "^file:/+", "file:/")
    listed_ = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string").select(plain(F.col("path")).alias("path"))
    seen = found.select(plain(F.col("path")).alias("path"))
    return listed_.join(seen, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there and no folders, in order; each folder that holds some is listed once."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    held: dict[str, set[str]] = {}
    out = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        folder = where.getParent()
        if folder is None:
            continue
        key = folder.toString()
        if key not in held:
            fs = folder.getFileSystem(hadoop)
            held[key] = {s.getPath().getName() for s in fs.listStatus(folder) if s.isFile()} if fs.exists(folder) else set()
        if where.getName() in held[key]:
            out.append(p)
    return out


def missing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The named paths that are no regular files."""
    found = set(existing(spark, paths))
    return spark.createDataFrame([(p,) for p in paths if p not in found], "path string")


def listed(spark: SparkSession, list_file: str) -> DataFrame:
    """file_index, path of the names in a text file, split on carriage returns, line feeds and tabs."""
    whole = spark.read.text(list_file, wholetext=True)
    names = whole.select(F.posexplode(F.filter(F.split("value", "[\r\n\t]"), lambda x: x != "")).alias("file_index", "path"))
    return names.select(F.col("file_index").cast("int").alias("file_index"), "path")


def from_list(spark: SparkSession, list_file: str) -> DataFrame:
    """The files that a list names; the list itself must fit on the driver, as reading needs the paths."""
    return indexed(files(spark, [r.path for r in listed(spark, list_file).orderBy("file_index").collect()]))


def indexed(df: DataFrame, parts: int = 256) -> DataFrame:
    """Adds file_index in path order.

    Ranks are counted within ranges of paths and shifted by the ranges before, so no task sees all rows. The bounds, one path for
    each of ``parts`` hash classes, are read once: a task that is run again gives the same numbers.
    """
    bounds = sorted(r[0] for r in df.groupBy(F.pmod(F.xxhash64("path"), F.lit(parts))).agg(F.min(F.struct(F.xxhash64("path"), "path"))["path"].alias("p")).select("p").collect())
    # The first bound that the path doesn't reach tells its range.
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("path"))) if bounds else F.lit(0)
    placed = df.select("path").withColumn("_part", part)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("path")))
    # One row a range.
    numbers = within.join(F.broadcast(starts.drop("_n")), "_part").select("path", (F.col("_start") + F.col("_at") - 1).cast("int").alias("file_index"))
    return df.join(numbers, "path")


def gate(df: DataFrame, limit: int = MAX_FILE) -> DataFrame:
    """Files that are neither empty nor too large; the length filter reaches the source."""
    return df.filter((F.col("length") > 0) & (F.col("length") <= limit))


def rejects(df: DataFrame, limit: int = MAX_FILE) -> DataFrame:
    """What the gate leaves out, with the reason."""
    reason = F.when(F.col("length") == 0, "empty file").when(F.col("length") > limit, "file over the limit")
    return df.drop("content").withColumn("error", reason).filter("error is not null")


def take(df: DataFrame, m: int, order: str = "file_index") -> DataFrame:
    """The first m files in list order."""
    return df.orderBy(order).limit(m)


def replicate(df: DataFrame, m: int, order: str = "file_index") -> DataFrame:
    """The first m files; if there are fewer, the last is repeated up to m. Copies get the numbers that follow."""
    kept = take(df, m, order)
    last = kept.orderBy(F.col(order).desc()).limit(1)
    short = kept.agg(F.count("*").alias("_n"))
    copies = last.join(F.broadcast(short)).filter(F.col("_n") < m).withColumn("_k", F.explode(F.sequence(F.lit(1), m - F.col("_n"))))
    return kept.unionByName(copies.withColumn(order, (F.col(order) + F.col("_k")).cast(df.schema[order].dataType)).drop("_n", "_k"))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """class_id, name: one line a class, the name before the first comma."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("class_id", "line"))
    return lines.select("class_id", F.trim(F.split("line", ",")[0]).alias("name"))


def results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result tables with a header line."""
    return spark.read.csv(path, header=True, schema=schema)


def stream(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """New files of a folder as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")
