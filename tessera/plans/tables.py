"""Derived tables of the queries, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.pixels import FRACTION, sql_idct_1d
from tessera.schema import ZIGZAG


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """All integers as long."""
    return df.select(*(F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, c: vectors of 64 as integer coefficients."""
    c = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("int"))
    return read(spark, sf_dir, "embeddings").select("vec_id", c.alias("c"))


def exploded(df: DataFrame, column: str = "c", *keys: str) -> DataFrame:
    return df.select(*(keys or ["vec_id"]), F.posexplode(column).alias("k", column))


def image_blocks(spark: SparkSession, sf_dir: str, column: str = "c", df: DataFrame | None = None) -> DataFrame:
    """image, brow, bcol and arrays y, cb, cr: three vectors a unit, eight units an image of 32 x 16; what the last image lacks is zero."""
    df = blocks(spark, sf_dir) if df is None else df
    own = F.struct((F.col("vec_id") % 24).cast("int").alias("at"), F.col(column).alias("px"))
    # At most 24 vectors a group.
    images = df.groupBy(F.floor(F.col("vec_id") / 24).alias("image")).agg(F.map_from_entries(F.collect_list(own)).alias("held"))
    units = images.select("image", "held", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("at"))
    comp = lambda n: F.coalesce(F.try_element_at("held", F.col("at") * 3 + n), F.array_repeat(F.lit(0), 64))
    return units.select("image", F.floor(F.col("at") / 4).cast("int").alias("brow"), (F.col("at") % 4).alias("bcol"), comp(0).alias("y"), comp(1).alias("cb"), comp(2).alias("cr"))


# -- SQL ---------------------------------------------------------------------

CB = "cb AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1024) AS BIGINT) AS c FROM embeddings)"
ZZ = "zz(i, nat) AS (VALUES " + ", ".join(f"({i}, {n})" for i, n in enumerate(ZIGZAG)) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def wrap(x: str) -> str:
    return f"(((({x}) + 32768) & 65535) - 32768)"


def clamp(x: str) -> str:
    return f"greatest(0, least(255, {x}))"


def units(src: str = "cb") -> str:
    """Long form of image_blocks: u(image, brow, bcol, k, y, cb, cr)."""
    comps = " ".join(f"LEFT JOIN {src} c{n} ON c{n}.vec_id = image * 24 + a.range * 3 + {n} AND c{n}.k = p.range" for n in range(3))
    return f"""u AS (SELECT image, a.range // 4 AS brow, a.range % 4 AS bcol, p.range AS k, coalesce(c0.c, 0) AS y, coalesce(c1.c, 0) AS cb, coalesce(c2.c, 0) AS cr
  FROM (SELECT DISTINCT vec_id // 24 AS image FROM {src}) i CROSS JOIN range(8) a CROSS JOIN range(64) p {comps})"""


def idct_pass(name: str, src: str, stride: int, accuracy: str = "high") -> str:
    """name(vec_id, k, c): one pass of the integer transform over the lines j of a block, a table a step."""
    at, line = ("k // 8", "k % 8") if stride == 8 else ("k % 8", "k // 8")
    place = "n * 8 + j" if stride == 8 else "j * 8 + n"
    inputs = ", ".join(f"max(CASE WHEN {at} = {n} THEN c END) AS x{n}" for n in range(8))
    scaled, turned, outputs = sql_idct_1d(accuracy)
    return f"""{name}_x AS (SELECT vec_id, {line} AS j, {inputs} FROM {src} GROUP BY ALL),
{name}_s AS (SELECT vec_id, j, {scaled} FROM {name}_x),
{name}_t AS (SELECT *, {turned} FROM {name}_s),
{name}_o AS (SELECT vec_id, j, unnest([{", ".join(outputs)}]) AS o, unnest(range(8)) AS n FROM {name}_t),
{name} AS (SELECT vec_id, {place} AS k, {wrap(f"o >> {FRACTION}")} AS c FROM {name}_o)"""


def rgb(src: str = "u", name: str = "rgb") -> str:
    return f"""{name} AS (SELECT image, brow, bcol, k, {clamp("y + ((cr * 45) >> 5) + 128")} AS r, {clamp("y - ((cb * 11 + cr * 23) >> 5) + 128")} AS g,
  {clamp("y + ((cb * 113) >> 6) + 128")} AS b FROM {src})"""


PIXELS = "px AS (SELECT image, brow * 8 + k // 8 AS y, bcol * 8 + k % 8 AS x, r, g, b FROM rgb)"


def as_long(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
