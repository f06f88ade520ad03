"""Queries over coefficient blocks, pixels and bitstreams, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.operators import aggregate, decode, geometry, huffman, quality
from tessera.plans import tables as T
from tessera.ship import ship
from tessera.sources import bmp

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: T.longs(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


IDCT = ",\n".join([T.CB, T.idct_pass("half", "cb", 8), T.idct_pass("whole", "half", 1)])
RAW_PIXELS = [T.CB, T.units(), T.rgb(), T.PIXELS]
CHANNELS = ("r", "g", "b")


# -- coefficients ------------------------------------------------------------


@query(T.with_(T.CB) + f"SELECT {T.as_long('vec_id', 'k', 'c')} FROM cb")
def block_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exploded(T.blocks(spark, sf_dir))


@query(T.with_(T.CB, T.ZZ) + "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(nat AS BIGINT) AS k, c FROM cb JOIN zz ON i = k")
def dezigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exploded(T.blocks(spark, sf_dir).withColumn("c", P.dezigzag(F.col("c"))))


@query(
    T.with_(T.CB, "q AS (SELECT t.range AS qid, s.range AS k, CASE WHEN t.range = 0 THEN 1 + (s.range * 5) % 54 ELSE 900 + s.range * 13 END AS q FROM range(2) t, range(64) s)")
    + f"SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(cb.k AS BIGINT) AS k, CAST({T.wrap('c * q')} AS BIGINT) AS c FROM cb JOIN q ON q.k = cb.k AND qid = CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END"
)
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.sequence(F.lit(0), F.lit(63))
    q = F.when(F.col("qid") == 0, F.transform(place, lambda k: 1 + (k * 5) % 54)).otherwise(F.transform(place, lambda k: 900 + k * 13))
    # Two rows; an image has at most four tables.
    quants = F.broadcast(spark.range(2).withColumnRenamed("id", "qid").withColumn("q", q))
    keyed = T.blocks(spark, sf_dir).withColumn("qid", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).cast("long"))
    return T.exploded(keyed.join(quants, "qid").withColumn("c", P.dequantize(F.col("c"), F.col("q"))))


@query(
    T.with_(T.CB, "d AS (SELECT vec_id // 24 AS image, vec_id % 3 AS comp, (vec_id // 12) % 2 AS restart_seg, vec_id // 3 AS scan_idx, c FROM cb WHERE k = 0)")
    + f"SELECT {T.as_long('image', 'comp', 'restart_seg', 'scan_idx')}, CAST({T.wrap('sum(c) OVER (PARTITION BY image, comp, restart_seg ORDER BY scan_idx)')} AS BIGINT) AS dc FROM d"
)
def dc_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    stream = T.blocks(spark, sf_dir).select(
        F.floor(v / 24).alias("file_index"), (v % 3).alias("comp"), (F.floor(v / 12) % 2).alias("restart_seg"), F.floor(v / 3).alias("scan_idx"),
        F.col("c").alias("zz"), F.lit(None).cast("string").alias("error"),
    )
    return decode.predict_dc(stream).select(F.col("file_index").alias("image"), "comp", "restart_seg", "scan_idx", F.col("zz")[0].alias("dc"))


@query(
    T.with_(T.CB, "m AS (SELECT vec_id, k, k % 12 AS size, CAST(abs(c) % (1 << CAST(k % 12 AS INT)) AS BIGINT) AS v FROM cb)")
    + "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(k AS BIGINT) AS k, CAST(CASE WHEN size = 0 THEN 0 WHEN v < (1 << CAST(size - 1 AS INT)) THEN v - ((1 << CAST(size AS INT)) - 1) ELSE v END AS BIGINT) AS value FROM m WHERE size > 0"
    + " UNION ALL SELECT CAST(vec_id AS BIGINT), CAST(k AS BIGINT), CAST(0 AS BIGINT) FROM m WHERE size = 0"
)
def sign_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = T.exploded(T.blocks(spark, sf_dir)).withColumn("size", F.col("k") % 12)
    magnitude = F.abs("c") % huffman.power(F.col("size"))
    return sized.select("vec_id", "k", P.sign_extend(magnitude, F.col("size")).alias("value"))


#: Code lengths in symbol order of T.81 table K.3 (luminance DC), and of a small table.
CODE_LENGTHS = {0: (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9), 1: (2, 3, 3, 4)}
CODE_ROWS = [(t, j, n) for t, lengths in CODE_LENGTHS.items() for j, n in enumerate(lengths)]
CT = "ct(tbl, j, len) AS (VALUES " + ", ".join(map(str, CODE_ROWS)) + ")"
CODED = (
    "lohi AS (SELECT *, coalesce(CAST(sum(1 << (16 - len)) OVER (PARTITION BY tbl ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS lo FROM ct),\n"
    "coded AS (SELECT tbl, j, len, j AS symbol, lo, lo + (1 << (16 - len)) - 1 AS hi, lo >> (16 - len) AS code FROM lohi)"
)


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, j, n, j) for t, j, n in CODE_ROWS], "tbl int, j int, len int, symbol int")


@query(T.with_(CT, CODED) + f"SELECT {T.as_long('tbl', 'j', 'len', 'symbol', 'lo', 'hi', 'code')} FROM coded")
def huff_canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.canonical_codes(code_table(spark))


@query(
    T.with_(T.CB, CT, CODED, "w AS (SELECT vec_id, k, vec_id % 2 AS tbl, (abs(c) * 131 + k * 977) % 65536 AS peek FROM cb)")
    + f"SELECT {T.as_long('w.vec_id', 'w.k', 'symbol', 'len').replace('AS w.', 'AS ')} FROM w JOIN coded ON w.tbl = coded.tbl AND peek BETWEEN lo AND hi"
)
def huff_symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = T.exploded(T.blocks(spark, sf_dir)).select("vec_id", "k", (F.col("vec_id") % 2).cast("int").alias("tbl"), ((F.abs("c") * 131 + F.col("k") * 977) % 65536).alias("peek"))
    return huffman.lookup(windows, huffman.canonical_codes(code_table(spark))).select("vec_id", "k", "symbol", "len")


@query(
    T.with_(T.CB, "p AS (SELECT vec_id, k, abs(c) % 4 AS run, c AS value, sum(abs(c) % 4 + 1) OVER (PARTITION BY vec_id ORDER BY k) AS pos FROM cb WHERE k > 0)")
    + f"SELECT {T.as_long('vec_id', 'k', 'run', 'pos', 'value')} FROM p WHERE pos <= 63"
)
def rle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.exploded(T.blocks(spark, sf_dir)).filter("k > 0").select("vec_id", "k", (F.abs("c") % 4).alias("run"), F.col("c").alias("value"))
    return huffman.run_positions(runs, "vec_id", "k")


# -- transform and colour ----------------------------------------------------


@query(T.with_(T.CB, T.idct_pass("half", "cb", 1)) + f"SELECT {T.as_long('vec_id', 'k', 'c')} FROM half")
def idct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exploded(T.blocks(spark, sf_dir).withColumn("c", P.idct_pass(F.col("c"), 1)))


@query(T.with_(IDCT) + f"SELECT {T.as_long('vec_id', 'k', 'c')} FROM whole")
def idct_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exploded(decode.transformed(T.blocks(spark, sf_dir), "c", "c"))


@query(T.with_(T.CB, T.idct_pass("half", "cb", 8, "low"), T.idct_pass("whole", "half", 1, "low")) + f"SELECT {T.as_long('vec_id', 'k', 'c')} FROM whole")
def idct_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The less accurate factors, with Column expressions only."""
    return T.exploded(T.blocks(spark, sf_dir).withColumn("c", P.idct_2d(F.col("c"), "low")))


# Each pass of the exact transform is a sum over cosines.
COSINES = "w AS (SELECT n.range AS n, f.range AS f, cos((2 * n.range + 1) * f.range * pi() / 16) * CASE WHEN f.range = 0 THEN sqrt(1.0 / 8) ELSE 0.5 END AS w FROM range(8) n, range(8) f)"


@query(
    T.with_(
        T.CB, COSINES, "fh AS (SELECT vec_id, w.n AS n, k % 8 AS j, sum(c * w) AS h FROM cb JOIN w ON w.f = k // 8 GROUP BY ALL)",
        "fw AS (SELECT vec_id, fh.n * 8 + w.n AS k, sum(h * w) AS c FROM fh JOIN w ON w.f = j GROUP BY ALL)",
    )
    + "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(k AS BIGINT) AS k, round(c, 4) AS c FROM fw"
)
def idct_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exploded(decode.transformed_exactly(T.blocks(spark, sf_dir), "c", "c")).withColumn("c", F.round("c", 4))


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.colour(T.image_blocks(spark, sf_dir))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.block_pixels(_rgb(spark, sf_dir), None, None)


@query(T.with_(*RAW_PIXELS) + f"SELECT {T.as_long('image', 'y', 'x', 'r', 'g', 'b')} FROM px")
def ycbcr_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir)


FLOAT_RGB = {"r": "y + 1.402e0 * cr", "g": "y - 0.344e0 * cb - 0.714e0 * cr", "b": "y + 1.772e0 * cb"}


@query(T.with_(T.CB, T.units()) + "SELECT CAST(image AS BIGINT) AS image, CAST(brow AS BIGINT) AS brow, CAST(bcol AS BIGINT) AS bcol, CAST(k AS BIGINT) AS k, " + ", ".join(f"CAST({T.clamp(f'round_even({e} + 128, 0)')} AS BIGINT) AS {c}" for c, e in FLOAT_RGB.items()) + " FROM u")
def rgb_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour formula with real factors."""
    long = T.image_blocks(spark, sf_dir).select("image", "brow", "bcol", F.posexplode(F.arrays_zip("y", "cb", "cr")).alias("k", "p")).select("image", "brow", "bcol", "k", "p.*")
    return long.select("image", "brow", "bcol", "k", *(x.cast("long").alias(c) for c, x in P.rgb_float(F.col("y"), F.col("cb"), F.col("cr")).items()))


@query(T.with_(*RAW_PIXELS) + "SELECT CAST(image AS BIGINT) AS image, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS BIGINT) AS l FROM px")
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("image", "y", "x", quality.luma(*map(F.col, CHANNELS)).alias("l"))


@query(
    T.with_(
        T.CB, T.units(),
        """s AS (SELECT l.image, l.brow, l.bcol, l.k, l.y, c.cb, c.cr FROM u l JOIN u c ON c.image = l.image AND c.brow = l.brow // 2 * 2 AND c.bcol = l.bcol // 2 * 2
  AND c.k = (l.k // 8 + 8 * (l.brow % 2)) // 2 * 8 + (l.k % 8 + 8 * (l.bcol % 2)) // 2)""",
        T.rgb("s"),
    )
    + f"SELECT {T.as_long('image', 'brow', 'bcol', 'k', 'r', 'g', 'b')} FROM rgb"
)
def chroma_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = F.explode(F.array(*(F.struct(F.lit(n).alias("comp"), F.col(c).alias("px")) for n, c in enumerate(("y", "cb", "cr"))))).alias("p")
    long = T.image_blocks(spark, sf_dir).select(F.col("image").alias("file_index"), "brow", "bcol", planes).select("file_index", "brow", "bcol", "p.comp", "p.px")
    kept = long.filter("comp = 0 or (brow % 2 = 0 and bcol % 2 = 0)").withColumns({"max_h": F.lit(2), "max_v": F.lit(2)})
    out = decode.rgb_blocks(kept).select(F.col("file_index").alias("image"), "brow", "bcol", F.posexplode(F.arrays_zip(*CHANNELS)).alias("k", "p"))
    return out.select("image", "brow", "bcol", "k", "p.r", "p.g", "p.b")


SUMS = "SELECT CAST(image AS BIGINT) AS image, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in CHANNELS) + " FROM {0} GROUP BY image"


@query(T.with_(IDCT, T.units("whole"), T.rgb()) + SUMS.format("rgb"))
def decode_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to samples, samples to colour, colour to sums by image."""
    samples = decode.transformed(T.blocks(spark, sf_dir), "c", "c")
    return aggregate.sum_rgb_blocks(decode.colour(T.image_blocks(spark, sf_dir, df=samples)))


@query(T.with_(*RAW_PIXELS) + SUMS.format("px"))
def sum_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.sum_rgb_blocks(_rgb(spark, sf_dir))


# -- geometry ----------------------------------------------------------------

DIMS = "d AS (SELECT p_partkey, p_size * 7 + p_partkey % 13 + 1 AS w, p_size * 5 + p_partkey % 11 + 1 AS h, 1 + p_partkey % 2 AS sh, 1 + (p_partkey // 2) % 2 AS sv FROM part)"


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size * 7 + p_partkey % 13 + 1 AS w", "p_size * 5 + p_partkey % 11 + 1 AS h", "1 + p_partkey % 2 AS sh", "1 + (p_partkey div 2) % 2 AS sv"
    )


@query(
    T.with_(DIMS, "m AS (SELECT *, (w + 7) // 8 AS mcu_w, (h + 7) // 8 AS mcu_h FROM d)")
    + "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(mcu_w AS BIGINT) AS mcu_w, CAST(mcu_h AS BIGINT) AS mcu_h, CAST(mcu_w + CASE WHEN sh = 2 THEN mcu_w % 2 ELSE 0 END AS BIGINT) AS mcu_w_real,"
    " CAST(mcu_h + CASE WHEN sv = 2 THEN mcu_h % 2 ELSE 0 END AS BIGINT) AS mcu_h_real, CAST(w % 4 AS BIGINT) AS bmp_padding FROM m"
)
def mcu_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry.mcu_geometry(*(F.col(c) for c in ("w", "h", "sh", "sv")))
    return _dims(spark, sf_dir).select("p_partkey", *(v.alias(k) for k, v in g.items()))


@query(
    T.with_(DIMS)
    + "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(w % 4 AS BIGINT) AS padding, CAST((w * 3 + w % 4) * h AS BIGINT) AS image_bytes, CAST((w * 3 + w % 4) * h + 54 AS BIGINT) AS file_bytes, CAST(w * 3 * h + 54 AS BIGINT) AS legacy_bytes FROM d"
)
def bmp_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bmp.sizes(F.col("w"), F.col("h"))
    return _dims(spark, sf_dir).select("p_partkey", *(v.alias(k) for k, v in s.items()))


@query(T.with_(*RAW_PIXELS) + f"SELECT CAST(image AS BIGINT) AS image, CAST(54 + (15 - y) * 96 + 3 * x AS BIGINT) AS offset_, CAST(b AS BIGINT) AS b0, CAST(g AS BIGINT) AS b1, CAST(r AS BIGINT) AS b2 FROM px")
def bmp_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the bytes of each pixel of a 32 x 16 image lie in its bitmap."""
    return _pixels(spark, sf_dir).select("image", bmp.offset(F.col("x"), F.col("y"), F.lit(32), F.lit(16)).alias("offset_"), F.col("b").alias("b0"), F.col("g").alias("b1"), F.col("r").alias("b2"))


@query(
    T.with_(T.CB, T.units(), T.rgb("(SELECT image, brow, bcol - 1 AS bcol, k, y, cb, cr FROM u WHERE bcol BETWEEN 1 AND 2 AND brow = 0)"), T.PIXELS)
    + f"SELECT {T.as_long('image', 'y', 'x', 'r', 'g', 'b')} FROM px"
)
def crop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.block_pixels(decode.colour(geometry.crop_blocks(T.image_blocks(spark, sf_dir), 8, 0, 16, 8)), None, None)


@query(T.with_(*RAW_PIXELS) + "SELECT CAST(image AS BIGINT) AS image, CAST(y - 3 AS BIGINT) AS y, CAST(x - 5 AS BIGINT) AS x, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM px WHERE x BETWEEN 5 AND 21 AND y BETWEEN 3 AND 12")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.crop(_pixels(spark, sf_dir), 5, 3, 17, 10)


@query(T.with_(*RAW_PIXELS) + "SELECT CAST(image AS BIGINT) AS image, CAST(y AS BIGINT) AS y, CAST(31 - x AS BIGINT) AS x, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM px")
def hflip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.mirror(_pixels(spark, sf_dir), 32)


def _boxes(f: int, src: str = "px") -> str:
    means = ", ".join(f"CAST(CAST(sum({c}) AS BIGINT) // {f * f} AS BIGINT) AS {c}" for c in CHANNELS)
    return f"SELECT CAST(image AS BIGINT) AS image, CAST(y // {f} AS BIGINT) AS y, CAST(x // {f} AS BIGINT) AS x, {means} FROM {src} GROUP BY image, y // {f}, x // {f}"


def _downscale(f: int) -> None:
    QUERIES[f"downscale{f}"] = lambda spark, sf_dir: T.longs(geometry.downscale(_pixels(spark, sf_dir), f))
    ORACLE_SQL[f"downscale{f}"] = T.with_(*RAW_PIXELS) + _boxes(f)


for _f in (2, 4, 8):
    _downscale(_f)


@query(T.with_(*RAW_PIXELS, "sq AS (SELECT image, y, x - 8 AS x, r, g, b FROM px WHERE x BETWEEN 8 AND 23)") + _boxes(4, "sq"))
def crop_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.crop_and_scale(_pixels(spark, sf_dir), 32, 16, 4)


@query(
    T.with_(DIMS, "p AS (SELECT t.range AS e FROM range(31) t)")
    + "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(coalesce(max(CASE WHEN (1 + w % 9) * (CAST(1 AS BIGINT) << e) <= h THEN (1 + w % 9) * (CAST(1 AS BIGINT) << e) END), max(1 + w % 9)) AS BIGINT) AS side FROM d, p GROUP BY p_partkey"
)
def round_down_mult(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dims(spark, sf_dir).select("p_partkey", geometry.round_down(F.col("h"), 1 + F.col("w") % 9).alias("side"))


# -- scores ------------------------------------------------------------------

SHIFTED = "p2 AS (SELECT image, y, x, " + ", ".join(f"greatest(0, least(255, {c} + ((x * 7 + y * 3) % 5 + 1) * (1 + image % 12))) AS {c}2" for c in CHANNELS) + " FROM px)"
MSE = (
    "m AS (SELECT px.image, " + ", ".join(f"CAST(sum(({c} - {c}2) * ({c} - {c}2)) AS DOUBLE) / count(*) AS m_{c}" for c in CHANNELS) + " FROM px JOIN p2 ON px.image = p2.image AND px.y = p2.y AND px.x = p2.x GROUP BY px.image),\n"
    "s AS (SELECT image, " + ", ".join(f"10 * log10(65025 / m_{c}) AS psnr_{c}" for c in CHANNELS) + " FROM m)"
)


def _psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _rgb(spark, sf_dir)
    y, x = (lambda k: F.col("brow") * 8 + F.shiftright(k, 3)), (lambda k: F.col("bcol") * 8 + k % 8)
    change = lambda k: ((x(k) * 7 + y(k) * 3) % 5 + 1) * (1 + F.col("image") % 12)
    b = a.select("image", "brow", "bcol", *(F.transform(c, lambda v, k: P.clamp(v + change(k))).alias(c) for c in CHANNELS))
    return quality.psnr_channels(a, b)


@query(T.with_(*RAW_PIXELS, SHIFTED, MSE) + "SELECT CAST(image AS BIGINT) AS image, round(psnr_r, 6) AS psnr_r, round(psnr_g, 6) AS psnr_g, round(psnr_b, 6) AS psnr_b, round((psnr_r + psnr_g + psnr_b) / 3, 6) AS psnr FROM s")
def psnr_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _psnr(spark, sf_dir)
    return s.select("image", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query(T.with_(*RAW_PIXELS, SHIFTED, MSE) + "SELECT CAST(image AS BIGINT) AS image, (psnr_r + psnr_g + psnr_b) / 3 < 30.0 AS corrupted FROM s")
def corrupt_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _psnr(spark, sf_dir).select("image", quality.corrupted(F.col("psnr")).alias("corrupted"))


@query(
    T.with_(
        T.CB, "ab AS (SELECT vec_id, k, ((c % 256) + 256) % 256 AS a, (((c + k % 7) % 256) + 256) % 256 AS b FROM cb)", "o(oy, ox) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1))",
        """w AS (SELECT vec_id, oy, ox, CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(b) AS DOUBLE) AS sb, CAST(sum(a * a) AS DOUBLE) AS saa, CAST(sum(b * b) AS DOUBLE) AS sbb, CAST(sum(a * b) AS DOUBLE) AS sab
  FROM ab JOIN o ON k // 8 BETWEEN oy AND oy + 6 AND k % 8 BETWEEN ox AND ox + 6 GROUP BY ALL)""",
        "v AS (SELECT vec_id, sa / 49 AS ma, sb / 49 AS mb, (saa - sa * sa / 49) / 48 AS va, (sbb - sb * sb / 49) / 48 AS vb, (sab - sa * sb / 49) / 48 AS cov FROM w)",
    )
    + "SELECT CAST(vec_id AS BIGINT) AS vec_id, round(avg(((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 6) AS ssim FROM v GROUP BY vec_id"
)
def ssim_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = T.blocks(spark, sf_dir).select("vec_id", F.transform("c", lambda x: F.pmod(x, F.lit(256))).alias("a"), F.transform("c", lambda x, k: F.pmod(x + k % 7, F.lit(256))).alias("b"))
    return df.select("vec_id", F.round(quality.ssim_block(F.col("a"), F.col("b")), 6).alias("ssim"))


# -- bitstreams --------------------------------------------------------------


def jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_index, path, length, content: the images of 32 x 16 as files, three full components, a restart every four units."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.plans.fixture_jpeg import encode

        for batch in batches:
            files = []
            for row in batch.to_pylist():
                blocks = {(k, b["brow"], b["bcol"]): b[c] for b in row["blocks"] for k, c in enumerate(("y", "cb", "cr"))}
                files.append((row["image"], f"img{row['image']}.jpg", encode(32, 16, [(1, 1, 1), (2, 1, 1), (3, 1, 1)], blocks, interval=4)))
            if files:
                index, path, content = (list(c) for c in zip(*files))
                arrays = [pa.array(index, pa.int32()), pa.array(path), pa.array([len(c) for c in content], pa.int64()), pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["file_index", "path", "length", "content"])

    limited = T.blocks(spark, sf_dir).withColumn("c", F.transform("c", lambda x: F.greatest(F.lit(-1023), F.least(F.lit(1023), x))))
    images = T.image_blocks(spark, sf_dir, df=limited)
    # Eight rows a group.
    grouped = images.groupBy("image").agg(F.collect_list(F.struct("brow", "bcol", "y", "cb", "cr")).alias("blocks"))
    return grouped.mapInArrow(run, "file_index int, path string, length long, content binary")


LIMITED = "lim AS (SELECT vec_id, k, greatest(-1023, least(1023, c)) AS c FROM cb)"


@query(
    T.with_(T.CB, LIMITED, T.units("lim"))
    + "SELECT CAST(image AS BIGINT) AS image, CAST(brow AS BIGINT) AS brow, CAST(bcol AS BIGINT) AS bcol, CAST(comp AS BIGINT) AS comp, CAST(k AS BIGINT) AS k, CAST(c AS BIGINT) AS c FROM"
    " (SELECT image, brow, bcol, k, 0 AS comp, y AS c FROM u UNION ALL SELECT image, brow, bcol, k, 1, cb FROM u UNION ALL SELECT image, brow, bcol, k, 2, cr FROM u) t"
)
def jpeg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients that come back from encoded files."""
    out = decode.predict_dc(decode.coefficients(jpegs(spark, sf_dir))).withColumn("c", P.dezigzag(F.col("zz")))
    return T.exploded(out.withColumnRenamed("file_index", "image"), "c", "image", "brow", "bcol", "comp")


JPEG_SUMS = T.with_(T.CB, LIMITED, T.idct_pass("half", "lim", 8), T.idct_pass("whole", "half", 1), T.units("whole"), T.rgb()) + SUMS.format("rgb")


@query(JPEG_SUMS)
def jpeg_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to pixels by table operators, then sums."""
    return aggregate.sum_rgb(decode.decode_relational(jpegs(spark, sf_dir)), "file_index").withColumnRenamed("file_index", "image")


@query(JPEG_SUMS)
def jpeg_decode_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the fused decoder."""
    return aggregate.image_sums(decode.decode(jpegs(spark, sf_dir))).withColumnRenamed("file_index", "image")


@query(T.with_(T.CB, T.units()) + "SELECT DISTINCT CAST(image AS BIGINT) AS image, TRUE AS valid, CAST(32 AS BIGINT) AS width, CAST(16 AS BIGINT) AS height, CAST(3 AS BIGINT) AS n_comp, CAST(4 AS BIGINT) AS restart_interval, CAST(4 AS BIGINT) AS mcu_w, CAST(2 AS BIGINT) AS mcu_h FROM u")
def header_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = decode.headers(jpegs(spark, sf_dir).filter(decode.soi()))
    return heads.select(F.col("file_index").alias("image"), "valid", "width", "height", "n_comp", "restart_interval", "mcu_w", "mcu_h")


@query(T.with_(T.CB, T.units()) + "SELECT DISTINCT CAST(image AS BIGINT) AS image, CAST(32 AS BIGINT) AS width, CAST(16 AS BIGINT) AS height, TRUE AS same FROM u")
def bmp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written as bitmaps and read again."""
    images = bmp.with_bmp(decode.decode(jpegs(spark, sf_dir)))
    files = images.select(bmp.bmp_name(F.col("path")).alias("path"), F.length("bmp").cast("long").alias("length"), F.col("bmp").alias("content"))
    back = bmp.read_bmps(files).select("path", "width", "height", F.col("rgb").alias("back"))
    kept = images.select(F.col("file_index").alias("image"), bmp.bmp_name(F.col("path")).alias("path"), "rgb")
    return kept.join(back, "path").select("image", "width", "height", (F.col("rgb") == F.col("back")).alias("same"))
