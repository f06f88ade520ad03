"""Queries over file lists, result pairs, timings and logits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregate, classify, manifest, quality
from tessera.plans import tables as T
from tessera.sources import bmp, files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FILES = "f AS (SELECT doc_id AS file_index, 'd.1/img' || doc_id || '.jpg' AS path, n_chars AS length FROM documents)"
GATE = 2000


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: T.longs(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d.1/img"), F.col("doc_id"), F.lit(".jpg"))
    return T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_index"), path.alias("path"), F.col("n_chars").alias("length"))


@query(T.with_(FILES) + f"SELECT file_index, path, length FROM f WHERE length > 0 AND length <= {GATE}")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.gate(_files(spark, sf_dir), GATE)


@query(T.with_(FILES) + f"SELECT file_index, path, length, CASE WHEN length = 0 THEN 'empty file' ELSE 'file over the limit' END AS error FROM f WHERE length = 0 OR length > {GATE}")
def manifest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rejects(_files(spark, sf_dir), GATE)


@query(T.with_(FILES) + "SELECT file_index, path, length FROM f ORDER BY file_index LIMIT 64")
def manifest_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.take(_files(spark, sf_dir), 64)


@query(
    T.with_(FILES, "last AS (SELECT * FROM f ORDER BY file_index DESC LIMIT 1)", "n AS (SELECT count(*) AS n FROM f)")
    + "SELECT * FROM f UNION ALL SELECT CAST(file_index + t.range AS BIGINT), path, length FROM last, n, range(1, 129) t"
)
def manifest_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128 files more than the list has: the last is repeated."""
    every = _files(spark, sf_dir)
    return files.replicate(every, every.count() + 128)


@query(T.with_(FILES) + r"SELECT file_index, regexp_replace(path, '\.[^./]*$', '') || '-cpu.bmp' AS name FROM f")
def bmp_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_index", bmp.bmp_name(F.col("path")).alias("name"))


SLOTS = (
    f"k AS (SELECT *, row_number() OVER (ORDER BY file_index) - 1 AS rank FROM f WHERE length > 0 AND length <= {GATE}),\n"
    "dealt AS (SELECT file_index, length, rank % 64 AS slot, rank // 64 AS round, sum(length) OVER (PARTITION BY rank % 64 ORDER BY rank) AS filled FROM k)"
)


@query(T.with_(FILES, SLOTS) + f"SELECT {T.as_long('file_index', 'length', 'slot', 'round', 'filled')} FROM dealt")
def slot_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.slot_assign(_files(spark, sf_dir), 64, GATE)


LIMIT, PER_SLOT, SLOT_COUNT = 6000, 3, 8


@query(
    f"""WITH RECURSIVE {FILES},
l AS (SELECT file_index, length, row_number() OVER (ORDER BY file_index) - 1 AS rank FROM f WHERE length <= {LIMIT}),
dealt AS (
  SELECT CAST(-1 AS BIGINT) AS rank, CAST(-1 AS BIGINT) AS file_index, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS start,
    CAST(0 AS BIGINT) AS turn, list_transform(range({SLOT_COUNT}), lambda x: CAST(0 AS BIGINT)) AS held, list_transform(range({SLOT_COUNT}), lambda x: CAST(0 AS BIGINT)) AS filled
  UNION ALL
  SELECT l.rank, l.file_index, l.length, c.batch, CASE WHEN fits THEN c.turn END, CASE WHEN fits THEN c.held[c.turn + 1] END, CASE WHEN fits THEN c.filled[c.turn + 1] END,
    CASE WHEN fits THEN (c.turn + 1) % {SLOT_COUNT} ELSE c.turn END,
    CASE WHEN fits THEN list_transform(c.held, lambda x, i: CASE WHEN i = c.turn + 1 THEN x + 1 ELSE x END) ELSE c.held END,
    CASE WHEN fits THEN list_transform(c.filled, lambda x, i: CASE WHEN i = c.turn + 1 THEN x + l.length ELSE x END) ELSE c.filled END
  FROM (SELECT rank, l0.length < {LIMIT} AS fits, closes, batch + CAST(closes AS BIGINT) AS batch, CASE WHEN closes THEN 0 ELSE turn END AS turn,
      CASE WHEN closes THEN list_transform(held, lambda x: CAST(0 AS BIGINT)) ELSE held END AS held, CASE WHEN closes THEN list_transform(filled, lambda x: CAST(0 AS BIGINT)) ELSE filled END AS filled
    FROM (SELECT d.*, l1.length AS next_length, (held[turn + 1] = {PER_SLOT} OR filled[turn + 1] + l1.length >= {LIMIT}) AND list_sum(held) > 0 AS closes FROM dealt d JOIN l l1 ON l1.rank = d.rank + 1) s
    JOIN (SELECT rank AS r0, length FROM l) l0 ON l0.r0 = s.rank + 1) c JOIN l ON l.rank = c.rank + 1
)
SELECT file_index, length, rank, CASE WHEN slot IS NOT NULL THEN batch END AS batch, slot, place, start FROM dealt WHERE rank >= 0"""
)
def bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files dealt to slots with caps on their number and their bytes."""
    return manifest.bin_packing(_files(spark, sf_dir), SLOT_COUNT, PER_SLOT, LIMIT)


@query(T.with_(FILES, SLOTS) + "SELECT CAST(slot AS BIGINT) AS slot, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes, max(length) AS max_bytes FROM dealt GROUP BY slot")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.batch_stats(manifest.slot_assign(_files(spark, sf_dir), 64, GATE), "slot")


PAIRS = (
    "o AS (SELECT 'd.1/img' || doc_id || '-cpu.bmp' AS out_path, 'd.1/img' || doc_id AS stem FROM documents),\n"
    "n AS (SELECT 'd.1/img' || doc_id || CASE lang WHEN 'en' THEN '.JPEG' WHEN 'de' THEN 'b.png' WHEN 'fr' THEN '.gif' ELSE '.png' END AS ref_path FROM documents),\n"
    r"r AS (SELECT ref_path FROM n WHERE regexp_matches(ref_path, '(?i)\.(jpg|jpeg|png)$')),"
    "\n"
    r"j AS (SELECT out_path, ref_path, row_number() OVER (PARTITION BY out_path ORDER BY CASE WHEN regexp_replace(ref_path, '\.[^.]*$', '') = stem THEN 0 ELSE 1 END, length(ref_path), ref_path) AS at_"
    " FROM o LEFT JOIN r ON starts_with(ref_path, stem))"
)


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("d.1/img"), F.col("doc_id"))
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "lang")
    ending = F.when(F.col("lang") == "en", ".JPEG").when(F.col("lang") == "de", "b.png").when(F.col("lang") == "fr", ".gif").otherwise(".png")
    return quality.outputs(docs.select(F.concat(name, F.lit("-cpu.bmp")).alias("path"))), docs.select(F.concat(name, ending).alias("path"))


@query(T.with_(PAIRS) + "SELECT out_path, ref_path FROM j WHERE at_ = 1")
def ref_match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.match_references(*_pairs(spark, sf_dir))


@query(T.with_(PAIRS) + "SELECT out_path FROM j WHERE at_ = 1 AND ref_path IS NULL")
def ref_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_references(*_pairs(spark, sf_dir))


# Sums of whole microunits, so that their order doesn't matter.
TIMES = "t AS (SELECT user_id, event_type, sum(CAST(round(value * 1000000) AS BIGINT)) AS time FROM events WHERE value IS NOT NULL GROUP BY ALL)"


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    micro = F.round(F.col("value") * 1000000).cast("long")
    return T.read(spark, sf_dir, "events").filter("value is not null").groupBy("user_id", "event_type").agg(F.sum(micro).alias("time"))


@query(T.with_(TIMES) + "SELECT user_id, event_type, round(CASE WHEN sum(time) OVER (PARTITION BY user_id) <> 0 THEN CAST(time AS DOUBLE) / CAST(sum(time) OVER (PARTITION BY user_id) AS DOUBLE) END, 6) AS share FROM t")
def timing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = aggregate.timing_share(_times(spark, sf_dir), "user_id")
    return shares.select("user_id", "event_type", F.round("share", 6).alias("share"))


WIDE = ("view", "click", "purchase", "signup", "error")


@query(
    T.with_(TIMES, "w AS (SELECT user_id, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{s}' THEN time ELSE 0 END) AS DOUBLE) AS {s}" for s in WIDE) + " FROM t GROUP BY user_id)")
    + "SELECT user_id, " + ", ".join(f"round(CASE WHEN {' + '.join(WIDE)} <> 0 THEN {s} / ({' + '.join(WIDE)}) END, 6) AS {s}" for s in WIDE) + " FROM w"
)
def timing_share_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.sum(F.when(F.col("event_type") == s, F.col("time")).otherwise(0)).cast("double").alias(s) for s in WIDE]
    shares = aggregate.timing_share_wide(_times(spark, sf_dir).groupBy("user_id").agg(*sums), list(WIDE))
    return shares.select("user_id", *(F.round(s, 6).alias(s) for s in WIDE))


@query("SELECT CAST(1 << CAST(t.range AS INT) AS BIGINT) AS files, round((1 << CAST(t.range AS INT)) / (0.5 + t.range), 6) AS fps FROM range(15) t")
def fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the doubling sweep."""
    sweep = spark.range(15).select(F.expr("shiftleft(1, int(id))").alias("files"), (F.col("id") + F.lit(0.5)).alias("total"))
    return sweep.select("files", F.round(aggregate.rate(F.col("files"), F.col("total")), 6).alias("fps"))


@query("SELECT l_orderkey, l_linenumber, round(l_partkey * 1000 / (800e6 / 3), 9) AS seconds FROM lineitem".replace("l_linenumber", "CAST(l_linenumber AS BIGINT) AS l_linenumber"))
def cycles_to_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = F.col("l_partkey") * 1000
    return T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(aggregate.cycles_to_seconds(cycles), 9).alias("seconds"))


LOGITS = "x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS class_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(T.with_(LOGITS) + "SELECT vec_id, CAST(class_id AS BIGINT) AS class_id, round(100 * exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS prob FROM x")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double"))
    probs = T.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(classify.softmax(logits)).alias("class_id", "prob"))
    return probs.withColumn("prob", F.round("prob", 6))


@query(
    T.with_(LOGITS, "p AS (SELECT vec_id, class_id, 100 * exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, class_id) AS at_ FROM x)")
    + "SELECT vec_id, CAST(class_id AS BIGINT) AS class_id, round(prob, 6) AS prob, n_name AS name, coalesce(n_name, 'null') || ', ' || printf('%.3f', prob) AS label FROM p LEFT JOIN nation ON n_nationkey = class_id WHERE at_ = 1"
)
def softmax_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class among the largest, with its name where there is one."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    top = T.read(spark, sf_dir, "embeddings").select("vec_id", classify.top_class(logits).alias("t")).select("vec_id", "t.class_id", "t.prob")
    names = T.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    return classify.label(top, names).select("vec_id", "class_id", F.round("prob", 6).alias("prob"), "name", "label")
