"""Queries over image files of many forms: sources, sinks, headers, whole decodes, scores; with their SQL.

The files are made from the vectors of ``embeddings``. Image n has a size,
sampling, quantizers, code tables, restart interval and application segment that
follow from n, so all that a decoder finds can be said in SQL. Of nine images one
is cut within its scan and one has a precision that isn't supported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregate, classify, decode, quality
from tessera.plans import tables as T
from tessera.plans.image_queries import CHANNELS, LIMITED, SUMS, jpegs
from tessera.plans.scratch import folder
from tessera.ship import ship
from tessera.sources import bmp, files, images, plot, sink
from tessera.streaming import decode as streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: T.longs(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def form(n: int) -> dict:
    """What image n is like."""
    wide = n % 3 == 0
    luma = [1 + (k * 13 + n) % (400 if wide else 54) for k in range(64)]
    chroma = [1 + (k * 3 + n) % 30 for k in range(64)]
    return {
        "width": 32 - n % 7, "height": 16 - n % 5, "interval": n % 4, "wide_tables": wide, "quants": [luma, chroma, chroma], "h": 1 + n // 2 % 2, "v": 1 + n // 4 % 2,
        "extra": n % 50, "skewed": n % 2 == 1, "damage": {4: "cut", 7: "precision"}.get(n % 9),
    }


#: The same as a table: one row an image.
FORM = """form AS (SELECT image, 32 - image % 7 AS width, 16 - image % 5 AS height, image % 4 AS interval_, image % 3 = 0 AS wide, 1 + image // 2 % 2 AS sh, 1 + image // 4 % 2 AS sv,
  image % 50 AS extra, image % 9 = 4 AS cut, image % 9 = 7 AS odd FROM (SELECT DISTINCT vec_id // 24 AS image FROM embeddings))"""
LUMA_Q, CHROMA_Q = "1 + (k * 13 + image) % CASE WHEN image % 3 = 0 THEN 400 ELSE 54 END", "1 + (k * 3 + image) % 30"


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_index, path, length, content of the images."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.plans.fixture_jpeg import AC_TABLE, DC_TABLE, encode, segment, skewed_table

        skewed = tuple(skewed_table(t[1]) for t in (DC_TABLE, AC_TABLE))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n = row["image"]
                f = form(n)
                held = {(b["brow"], b["bcol"]): b for b in row["blocks"]}
                blocks = {(0, *at): b["y"] for at, b in held.items()}
                blocks |= {(k, y, x): b[c] for (y, x), b in held.items() for k, c in ((1, "cb"), (2, "cr")) if y % f["v"] == 0 and x % f["h"] == 0}
                raw = encode(
                    f["width"], f["height"], [(1, f["h"], f["v"]), (2, 1, 1), (3, 1, 1)], blocks, quants=f["quants"], interval=f["interval"], wide_tables=f["wide_tables"],
                    extra=segment(0xE0, b"x" * f["extra"]), tables=skewed if f["skewed"] else None,
                )
                if f["damage"] == "cut":
                    scan = raw.index(b"\xff\xda")
                    raw = raw[: scan + 14 + (len(raw) - scan) // 3]
                if f["damage"] == "precision":
                    at = raw.index(b"\xff\xc0") + 4
                    raw = raw[:at] + b"\x0c" + raw[at + 1 :]
                out.append((n, f"d{n % 3}/img{n}.jpg", len(raw), raw))
            if out:
                index, path, length, content = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(path), pa.array(length, pa.int64()), pa.array(content, pa.binary())], ["file_index", "path", "length", "content"])

    limited = T.blocks(spark, sf_dir).withColumn("c", F.transform("c", lambda x: F.greatest(F.lit(-1023), F.least(F.lit(1023), x))))
    # Eight rows a group.
    grouped = T.image_blocks(spark, sf_dir, df=limited).groupBy("image").agg(F.collect_list(F.struct("brow", "bcol", "y", "cb", "cr")).alias("blocks"))
    return grouped.mapInArrow(run, "file_index int, path string, length long, content binary")


def number(path: str = "path") -> Column:
    """The image's number from its name."""
    return F.regexp_extract(path, r"img([0-9]+)", 1).cast("long")


# -- headers -----------------------------------------------------------------


@query(
    T.with_(FORM)
    + "SELECT CAST(image AS BIGINT) AS image, NOT odd AS valid, CASE WHEN odd THEN 'precision isn''t 8' END AS error, "
    + ", ".join(
        f"CAST(CASE WHEN NOT odd THEN {x} END AS BIGINT) AS {n}"
        for n, x in {
            "width": "width", "height": "height", "n_comp": "3", "restart_interval": "interval_", "h": "sh", "v": "sv", "mcu_w": "4", "mcu_h": "2", "mcu_w_real": "4", "mcu_h_real": "2",
            "bmp_padding": "width % 4", "decoded_bytes": "128 * ((2 + 1) * 4 + 4 + 1) * 3", "warnings": "0",
            "data_start": "2 + 4 + extra + 3 * (69 + 64 * CAST(wide AS INT)) + 19 + 33 + 183 + CASE WHEN interval_ > 0 THEN 6 ELSE 0 END + 14",
        }.items()
    )
    + " FROM form"
)
def header_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = decode.headers(varied(spark, sf_dir))
    first = F.col("comps")[0]
    return heads.select(
        F.col("file_index").alias("image"), "valid", "error", "width", "height", "n_comp", "restart_interval", first["h"].alias("h"), first["v"].alias("v"), "mcu_w", "mcu_h",
        "mcu_w_real", "mcu_h_real", "bmp_padding", "decoded_bytes", "warnings", "data_start",
    )


@query(
    T.with_(FORM, T.ZZ)
    + f"SELECT CAST(image AS BIGINT) AS image, CAST(t.range AS BIGINT) AS tbl, CAST(k AS BIGINT) AS k, CAST(CASE WHEN t.range = 0 THEN {LUMA_Q} ELSE {CHROMA_Q} END AS BIGINT) AS q"
    " FROM (SELECT image, odd, nat AS k FROM form, zz) f, range(3) t WHERE NOT odd"
)
def quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantizers of 8 and 16 bits in natural order."""
    heads = decode.valid(decode.headers(varied(spark, sf_dir)))
    return heads.select(F.col("file_index").alias("image"), F.explode("qt").alias("tbl", "q")).select("image", "tbl", F.posexplode("q").alias("k", "q"))


@query(
    T.with_(FORM)
    + """SELECT CAST(image AS BIGINT) AS file_index, CAST(row_number() OVER (PARTITION BY image ORDER BY seq) - 1 AS BIGINT) AS seq, CAST(code AS BIGINT) AS code,
  CAST(coalesce(sum(CASE WHEN code = 216 THEN 2 ELSE 2 + len END) OVER (PARTITION BY image ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, CAST(len AS BIGINT) AS length
FROM (SELECT image, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS seq, unnest([216, 224, 219, 219, 219, 192, 196, 196, 221, 218]) AS code,
  unnest([2, 2 + extra, 67 + 64 * CAST(wide AS INT), 67 + 64 * CAST(wide AS INT), 67 + 64 * CAST(wide AS INT), 17, 31, 181, CASE WHEN interval_ > 0 THEN 4 END, 12]) AS len FROM form) t
WHERE len IS NOT NULL"""
)
def marker_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments before the scan; offsets move with the application segment that is passed over."""
    return decode.marker_table(varied(spark, sf_dir))


# -- decoding ----------------------------------------------------------------

_DEQUANTIZED = f"deq AS (SELECT vec_id, k, {T.wrap(f'c * (CASE WHEN vec_id % 3 = 0 THEN {LUMA_Q} ELSE {CHROMA_Q} END)')} AS c FROM (SELECT *, vec_id // 24 AS image FROM lim) l)"
_SAMPLED = """smp AS (SELECT l.image, l.brow, l.bcol, l.k, l.y, c.cb, c.cr FROM u l JOIN form f ON f.image = l.image JOIN u c ON c.image = l.image AND c.brow = l.brow // sv * sv AND c.bcol = l.bcol // sh * sh
  AND c.k = (l.k // 8 + 8 * (l.brow % sv)) // sv * 8 + (l.k % 8 + 8 * (l.bcol % sh)) // sh)"""
_CUT = "img AS (SELECT px.image, y, x, r, g, b FROM px JOIN form f ON f.image = px.image WHERE x < width AND y < height AND NOT cut AND NOT odd)"
DECODED = [T.CB, LIMITED, FORM, _DEQUANTIZED, T.idct_pass("half", "deq", 8), T.idct_pass("whole", "half", 1), T.units("whole"), _SAMPLED, T.rgb("smp"), T.PIXELS, _CUT]
FORM_SUMS = T.with_(*DECODED) + SUMS.format("img")


@query(FORM_SUMS)
def decode_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samplings, quantizers and code tables by the fused decoder."""
    return aggregate.image_sums(decode.decode(varied(spark, sf_dir))).withColumnRenamed("file_index", "image")


def _relational(coeffs: DataFrame) -> DataFrame:
    pixels = decode.block_pixels(decode.rgb_blocks(decode.samples(coeffs)))
    return aggregate.sum_rgb(pixels, "file_index").withColumnRenamed("file_index", "image")


@query(FORM_SUMS)
def decode_forms_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relational(decode.coefficients(varied(spark, sf_dir)))


@query(T.with_(*DECODED) + SUMS.format("(SELECT * FROM img WHERE image % 4 > 0)"))
def decode_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a restart interval, whose segments are rows of their own; a file with a broken segment is left out."""
    found = decode.segment_coefficients(varied(spark, sf_dir).filter("file_index % 4 > 0"), 8)
    broken = found.filter("error is not null").select("file_index").distinct()
    return _relational(found.join(broken, "file_index", "left_anti"))


@query(T.with_(*DECODED) + SUMS.format("(SELECT * FROM img WHERE image % 4 = 0)"))
def decode_by_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a restart interval, whose scans are cut into pieces of equal bytes; a scan of too few blocks is left out."""
    found = decode.piece_coefficients(varied(spark, sf_dir), 3)
    whole = found.groupBy("file_index").agg(F.count("*").alias("n")).join(decode.headers(varied(spark, sf_dir)).filter("valid").select("file_index", F.expr("mcu_w_real * mcu_h_real + 2 * (mcu_w_real div max_h) * (mcu_h_real div max_v)").alias("all")), "file_index").filter("n = all")
    return _relational(found.join(whole.select("file_index"), "file_index"))


@query(T.with_(FORM) + "SELECT CAST(image AS BIGINT) AS image, NOT cut AND NOT odd AS decoded, CAST(CASE WHEN cut OR odd THEN 0 ELSE 8 + 16 // (sh * sv) END AS BIGINT) AS blocks, TRUE AS timed FROM form")
def decode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and time of each file; broken files are rows as well."""
    done = decode.decode(varied(spark, sf_dir))
    return done.select(F.col("file_index").alias("image"), F.col("error").isNull().alias("decoded"), "blocks", (F.col("elapsed_s") >= 0).alias("timed"))


@query(
    T.with_(FORM)
    + "SELECT count(*) AS files, CAST(count(*) FILTER (cut OR odd) AS BIGINT) AS failed, CAST(sum(8 + 16 // (sh * sv)) FILTER (NOT cut AND NOT odd) AS BIGINT) AS blocks, CAST(sum(width * height) FILTER (NOT cut AND NOT odd) AS BIGINT) AS pixels FROM form"
)
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.job_totals(decode.decode(varied(spark, sf_dir))).select("files", "failed", "blocks", "pixels")


@query(
    T.with_(FORM, "t AS (SELECT image % 4 AS slot, sum(CASE WHEN cut OR odd THEN 0 ELSE 8 + 16 // (sh * sv) END) AS blocks FROM form GROUP BY 1)")
    + "SELECT CAST(slot AS BIGINT) AS slot, CAST(0 AS BIGINT) AS seq, printf('[%d] called decode_mcu %d times', slot, CAST(blocks AS BIGINT)) AS line FROM t"
    " UNION ALL SELECT CAST(slot AS BIGINT), CAST(1 AS BIGINT), printf('[%d] total %.5f (%d cycles)', slot, CAST(blocks * 1000 AS DOUBLE) / (800e6 / 3), CAST(blocks * 1000 AS BIGINT)) FROM t"
)
def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each slot as lines of text."""
    done = decode.decode(varied(spark, sf_dir)).select((F.col("file_index") % 4).alias("slot"), F.col("blocks").cast("long").alias("blocks"), (F.col("blocks").cast("long") * 1000).alias("cycles"))
    return aggregate.stats_lines(done, "slot")


# -- sources and sinks -------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The images as files below folders, with an empty file and one that is no image."""
    sink.register(spark)
    more = spark.createDataFrame([("d1/empty.jpg", bytearray()), ("d2/notes.txt", bytearray(b"no image")), ("d2/text.jpg", bytearray(b"no image"))], "path string, content binary")
    out = folder(spark, name)
    varied(spark, sf_dir).select("path", "content").unionByName(more).write.format("files").mode("append").save(out)
    return out


FILE_LIST = "names AS (SELECT 'd' || image % 3 || '/img' || image || '.jpg' AS name, image, cut, odd FROM form UNION ALL SELECT 'd1/empty.jpg', NULL, FALSE, TRUE UNION ALL SELECT 'd2/text.jpg', NULL, FALSE, TRUE)"


@query(T.with_(FORM, FILE_LIST) + "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS file_index, NOT cut AND NOT odd AS decoded FROM names")
def folder_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found below a folder, numbered in order of their paths, and whether they decode."""
    root = _stored(spark, sf_dir, "tree")
    found = files.indexed(files.files(spark, root, "*.jpg", recursive=True))
    return decode.decode(found).select(F.regexp_extract("path", r"(d[0-9]/[^/]+)$", 1).alias("name"), "file_index", F.col("error").isNull().alias("decoded"))


@query(T.with_(FORM, FILE_LIST) + "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS file_index, name <> 'd1/empty.jpg' AS passes FROM (SELECT name FROM names WHERE image % 2 = 0 OR image IS NULL) t")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a text names; names of folders and of nothing are left out, and the gate tells the empty one."""
    root = _stored(spark, sf_dir, "listed")
    names = T.read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 24).alias("n")).distinct().filter("n % 2 = 0").select(F.format_string("%s/d%d/img%d.jpg", F.lit(root), F.col("n") % 3, "n").alias("name"))
    more = spark.createDataFrame([(f"{root}/{x}",) for x in ("d1/empty.jpg", "d2/text.jpg", "d1", "d1/none.jpg")], "name string")
    whole = names.unionByName(more).agg(F.array_join(F.array_sort(F.collect_list("name")), "\r\n\t").alias("value"))
    text = folder(spark, "list")
    whole.coalesce(1).write.text(text)
    found = files.from_list(spark, text)
    kept = files.gate(found).select("path", F.lit(True).alias("passes"))
    return found.join(kept, "path", "left").select(F.regexp_extract("path", r"(d[0-9]/[^/]+)$", 1).alias("name"), "file_index", F.coalesce("passes", F.lit(False)).alias("passes"))


@query(T.with_(*DECODED) + "SELECT 'd' || image % 3 || '/img' || image || '-out.bmp' AS name, CAST(max(x) + 1 AS BIGINT) AS width, CAST(max(y) + 1 AS BIGINT) AS height, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in CHANNELS) + " FROM img GROUP BY image")
def bitmap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded images written by the bitmap sink and read from its folder; broken images leave no file."""
    bmp.register(spark)
    out = folder(spark, "bitmaps")
    decode.decode(varied(spark, sf_dir)).select("path", "width", "height", "rgb").write.format("bmp").option("suffix", "-out.bmp").mode("append").save(out)
    back = bmp.read_bmps(files.files(spark, out, "*.bmp", recursive=True))
    sums = aggregate.image_sums(back, "path")
    return back.select("path", "width", "height").join(sums, "path").withColumn("path", F.regexp_extract("path", r"(d[0-9]/[^/]+)$", 1)).withColumnRenamed("path", "name")


@query(FORM_SUMS)
def stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images as files that a stream finds and decodes."""
    root, out = _stored(spark, sf_dir, "arriving"), folder(spark, "streamed")
    streaming.start(spark, f"{root}/*", out, folder(spark, "state")).awaitTermination()
    done = spark.read.parquet(out).withColumn("image", number())
    return aggregate.image_sums(done, "image")


@query("SELECT CAST(n_nationkey AS BIGINT) AS class_id, n_name AS name FROM nation")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of names, one line a class, with synonyms behind commas."""
    lines = T.read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    text = folder(spark, "names")
    lines.select(F.concat_ws("\n", F.transform("n", lambda x: F.concat(x["n_name"], F.lit(", synonym, other")))).alias("value")).coalesce(1).write.text(text)
    return files.class_names(spark, text)


# -- scores ------------------------------------------------------------------

# References: the image itself made brighter; for image n, n % 6 says what else differs.
_PAIRED = """ref AS (SELECT image, y, x, """ + ", ".join(f"greatest(0, least(255, {c} + ((x * 7 + y * 3) % 5 + 1) * (1 + image % 12))) AS {c}" for c in CHANNELS) + """ FROM img),
planes AS (SELECT i.image, i.y, i.x, unnest([0, 1, 2]) AS ch, unnest(CASE WHEN i.image % 6 = 1 THEN list_resize([{l1}], 3, {l1}) ELSE [i.r, i.g, i.b] END) AS a,
  unnest(CASE WHEN i.image % 6 = 1 THEN list_resize([{l2}], 3, {l2}) ELSE [r.r, r.g, r.b] END) AS b FROM img i JOIN ref r ON r.image = i.image AND r.y = i.y AND r.x = i.x WHERE i.image % 6 < 4)""".format(
    l1="(i.r * 19595 + i.g * 38470 + i.b * 7471 + 32768) >> 16", l2="(r.r * 19595 + r.g * 38470 + r.b * 7471 + 32768) >> 16"
)
_SCORED = """p AS (SELECT image, ch, CAST(sum((a - b) * (a - b)) AS DOUBLE) / count(*) AS mse FROM planes GROUP BY ALL),
q AS (SELECT image, ch, 10 * log10(65025 / mse) AS psnr FROM p),
w AS (SELECT c.image, c.ch, c.y, c.x, CAST(sum(d.a) AS DOUBLE) AS sa, CAST(sum(d.b) AS DOUBLE) AS sb, CAST(sum(d.a * d.a) AS DOUBLE) AS saa, CAST(sum(d.b * d.b) AS DOUBLE) AS sbb, CAST(sum(d.a * d.b) AS DOUBLE) AS sab
  FROM planes c JOIN planes d ON d.image = c.image AND d.ch = c.ch AND d.y BETWEEN c.y AND c.y + 6 AND d.x BETWEEN c.x AND c.x + 6 GROUP BY ALL HAVING count(*) = 49),
v AS (SELECT image, ch, sa / 49 AS ma, sb / 49 AS mb, (saa - sa * sa / 49) / 48 AS va, (sbb - sb * sb / 49) / 48 AS vb, (sab - sa * sb / 49) / 48 AS cov FROM w),
s AS (SELECT image, ch, avg(((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS ssim FROM v GROUP BY ALL),
all_ AS (SELECT image, max(psnr) FILTER (ch = 0) AS pr, max(psnr) FILTER (ch = 1) AS pg, max(psnr) FILTER (ch = 2) AS pb, max(ssim) FILTER (ch = 0) AS sr, max(ssim) FILTER (ch = 1) AS sg, max(ssim) FILTER (ch = 2) AS sb_
  FROM q JOIN s USING (image, ch) GROUP BY image)"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of outputs and references: bitmaps, and PNGs that are brighter; grey, of another size or broken for some, for others none."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from tessera.operators.quality import np_luma
        from tessera.sources import bmp, png

        for batch in batches:
            out = []
            for f in batch.to_pylist():
                n = f["file_index"]
                rgb = np.frombuffer(f["rgb"], np.uint8).reshape(f["height"], f["width"], 3)
                y, x = np.mgrid[: f["height"], : f["width"]]
                bright = np.clip(rgb.astype(int) + (((x * 7 + y * 3) % 5 + 1) * (1 + n % 12))[..., None], 0, 255).astype(np.uint8)
                out.append((f"q/img{n}-cpu.bmp", bmp.encode(rgb)))
                kind = n % 6
                if kind == 5:
                    continue
                raw = png.encode(np_luma(bright).astype(np.uint8) if kind == 1 else bright[:-1] if kind == 4 else bright)
                out.append((f"q/img{n}" + (".PNG" if kind == 2 else "x.png" if kind == 3 else ".png"), raw))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["path", "content"])

    good = decode.decode(varied(spark, sf_dir)).filter("error is null")
    return good.select("file_index", "width", "height", "rgb").mapInArrow(run, "path string, content binary")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = images.pictures(_pictures(spark, sf_dir))
    matched = quality.match_references(quality.outputs(seen.select("path")), seen.select("path"), numbered=True)
    side = lambda names, ref: seen.select(*(F.col(c).alias(n) for c, n in names.items())).withColumnRenamed("_path", ref)
    out = side({"path": "_path", "width": "width", "height": "height", "rgb": "rgb"}, "out_path")
    ref = side({"path": "_path", "mode": "ref_mode", "width": "ref_width", "height": "ref_height", "rgb": "ref_rgb"}, "ref_path")
    return matched.join(out, "out_path").join(ref, "ref_path", "left").withColumn("key", F.regexp_extract("ref_path", r"([^/]+)$", 1))


NAMED = "CASE image % 6 WHEN 2 THEN '.PNG' WHEN 3 THEN 'x.png' ELSE '.png' END"


@query(
    T.with_(*DECODED, _PAIRED, _SCORED)
    + f"SELECT 'img' || image || {NAMED} AS image, (pr + pg + pb) / 3 < 30.0 OR (sr + sg + sb_) / 3 < 0.95 AS corrupted, "
    + ", ".join(f'round({x}, 5) AS "{n}"' for n, x in {"SSIM-R": "sr", "SSIM-G": "sg", "SSIM-B": "sb_", "SSIM": "(sr + sg + sb_) / 3", "PSNR-R": "pr", "PSNR-G": "pg", "PSNR-B": "pb", "PSNR": "(pr + pg + pb) / 3"}.items())
    + f""", 'q/img' || image || {NAMED} AS "reference path", 'q/img' || image || '-cpu.bmp' AS "output path" FROM all_"""
)
def quality_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole images scored against references of other formats; the table is written with a header line and read again."""
    table = quality.quality_table(_pairs(spark, sf_dir))
    out = folder(spark, "quality")
    bmp.write_csv(table, out)
    back = files.results_csv(spark, out, reduce(lambda a, f: f"{a}, `{f.name}` {f.dataType.simpleString()}", table.schema.fields[1:], f"`{table.schema.fields[0].name}` string"))
    return back.select(*(F.round(f"`{n}`", 5).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in back.dtypes))


@query(
    T.with_(FORM)
    + "SELECT 'q/img' || image || '-cpu.bmp' AS out_path, CASE WHEN image % 6 = 5 THEN 'no reference' WHEN image % 6 = 4 THEN 'size mismatch' END AS reason FROM form WHERE NOT cut AND NOT odd"
)
def score_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why outputs have no scores."""
    return quality.skips(_pairs(spark, sf_dir))


# -- classification ----------------------------------------------------------

#: Away from values that lie between two roundings.
SIDE, BIAS = 8, [0.50035, 0.00035, -0.24965, 0.00035]


def _axis(name: str, n: int) -> str:
    """Weights of the samples of an axis of n for each of SIDE places, bilinear."""
    at = f"greatest(0, least({n - 1}, (t.range + 0.5e0) * {n} / {SIDE} - 0.5e0))"
    return f"""{name}0 AS (SELECT t.range AS o, {at} AS at_, floor({at}) AS low FROM range({SIDE}) t),
{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT o, low AS i, 1 - (at_ - low) AS w FROM {name}0 UNION ALL SELECT o, least(low + 1, {n - 1}), at_ - low FROM {name}0) t GROUP BY o, i)"""


_BLOB = [
    T.CB, LIMITED, T.idct_pass("half", "lim", 8), T.idct_pass("whole", "half", 1), T.units("whole"), T.rgb(), T.PIXELS, _axis("wy", 16), _axis("wx", 32),
    "bl AS (SELECT image, wy.o AS y, wx.o AS x, " + ", ".join(f"(sum({c} * wy.w * wx.w) - {m}) * 0.01 AS {c}" for c, m in zip(CHANNELS, ("123e0", "117e0", "104e0"))) + " FROM px JOIN wy ON wy.i = px.y JOIN wx ON wx.i = px.x GROUP BY ALL)",
]


@query(T.with_(*_BLOB) + "SELECT CAST(image AS BIGINT) AS image, CAST(c AS BIGINT) AS channel, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(v, 5) AS v FROM (SELECT image, y, x, unnest([0, 1, 2]) AS c, unnest([b, g, r]) AS v FROM bl) t")
def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as the input of a model: resized, in the order B, G, R, means off, scaled."""
    done = classify.blobs(decode.decode(jpegs(spark, sf_dir)), SIDE).select(F.col("file_index").alias("image"), F.posexplode("blob").alias("at", "v"))
    plane = SIDE * SIDE
    return done.select("image", F.floor(F.col("at") / plane).alias("channel"), F.floor(F.col("at") % plane / SIDE).alias("y"), (F.col("at") % SIDE).alias("x"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query(
    T.with_(*_BLOB, "m AS (SELECT image, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM bl GROUP BY image)")
    + "SELECT CAST(image AS BIGINT) AS image, unnest([CAST(0 AS BIGINT), 1, 2, 3]) AS class_id, unnest([" + ", ".join(f"round({x} + {b}e0, 2) + 0" for x, b in zip(("b * 2", "g * 2 - r", "r * 2", "b + g + r"), BIAS)) + "]) AS logit FROM m"
)
def model_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small model of mean, product and sum, run on decoded images from its file."""
    from tessera.plans.fixture_onnx import mean_model

    weights = [[2, 0, 0, 1], [0, 2, 0, 1], [0, -1, 2, 1]]
    sink.register(spark)
    out = folder(spark, "model")
    spark.createDataFrame([("model.onnx", bytearray(mean_model(SIDE, weights, BIAS)))], "path string, content binary").write.format("files").mode("append").save(out)
    model = classify.load_model(spark, f"{out}/model.onnx")
    return classify.forward(decode.decode(jpegs(spark, sf_dir)), model, SIDE).select(F.col("file_index").alias("image"), F.posexplode("logits").alias("class_id", "logit")).withColumn("logit", F.round("logit", 2) + 0.0)


# -- plots -------------------------------------------------------------------

STAGES = ("view", "click", "purchase", "signup", "error")


@query(
    "WITH t AS (SELECT user_id, event_type, sum(CAST(round(value * 1000000) AS BIGINT)) AS time FROM events WHERE value IS NOT NULL GROUP BY ALL),\n"
    "w AS (SELECT user_id, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{s}' THEN time ELSE 0 END) AS DOUBLE) AS {s}" for s in STAGES) + " FROM t GROUP BY user_id),\n"
    f"sh AS (SELECT user_id, {', '.join(f'{s} / ({" + ".join(STAGES)}) AS {s}' for s in STAGES)} FROM w WHERE {' + '.join(STAGES)} <> 0),\n"
    "b AS (SELECT user_id, unnest([" + ", ".join(str(k) for k in range(len(STAGES))) + "]) AS seq, unnest([" + ", ".join(f"'{s}'" for s in STAGES) + "]) AS stage, unnest([" + ", ".join(" + ".join(["0e0", *STAGES[:k]]) for k in range(len(STAGES))) + "]) AS lo, unnest(["
    + ", ".join(" + ".join(["0e0", *STAGES[: k + 1]]) for k in range(len(STAGES))) + "]) AS hi, unnest([" + ", ".join(STAGES) + "]) AS share FROM sh)\n"
    "SELECT user_id, CAST(seq AS BIGINT) AS seq, stage, CAST(floor(lo * 400 + 0.5) AS BIGINT) AS x0, CAST(floor(hi * 400 + 0.5) AS BIGINT) AS x1, CASE WHEN share > 0.1 THEN printf('%.1f%%', share * 100) END AS text FROM b"
)
def plot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plot of stacked shares draws."""
    micro = F.round(F.col("value") * 1000000).cast("long")
    times = T.read(spark, sf_dir, "events").filter("value is not null").groupBy("user_id").pivot("event_type", list(STAGES)).agg(F.sum(micro)).na.fill(0, list(STAGES))
    shares = aggregate.timing_share_wide(times.select("user_id", *(F.col(s).cast("double").alias(s) for s in STAGES)), list(STAGES)).filter(F.col(STAGES[0]).isNotNull())
    return plot.bars(shares, "user_id", list(STAGES))
