"""Quality rules: counts within each document, and line frequency across documents.

Across documents, lines are normalised (lower case, white space run to one
space) and hashed. For each host the distinct documents that have a line are
counted, and those of the host in the same way: equal texts are one document,
near copies are several. A line in more documents than ``max(least_docs, share *
documents of the host)`` is boilerplate. A document is depleted, and rejected, if boilerplate lines hold more than
``depleted`` of its words.

Nulls: a null text has no words and fails the base rules; a null host is the
host with the empty name. Repeated rows get the same verdict and ties need no
rule. A text is read whole, however long, in time that grows with its length. An
empty table gives an empty result. Columns other than the named ones are not
read, or kept where the whole document is returned, also with clashing names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, map_batches, materialize, ship, texts_of

LEAST_DOCS = 20
SHARE = 0.05
DEPLETED = 0.8
WINDOW = 8
BLANK = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: bytes) -> int:
    """Of the normalised line."""
    return signed(xxhash.xxh64_intdigest(b" ".join(line.decode("utf-8", "replace").lower().encode("utf-8", "replace").split()), 42))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows that the list holds more than once: windows get ids by doubling, so equal ids are equal windows."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) > len(words) - width:
        return 0
    span = 1
    while span < width:
        _, ids = np.unique(ids[: len(ids) - span] << 32 | ids[span:], return_inverse=True)
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge) > 0))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANK)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.translate(None, BLANK)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


STATS = "doc_id long, tkey long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<long>, line_words array<int>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_key(text: Column) -> Column:
    """The same hash as ``document_stats`` gives; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_stats(df: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its counts, its distinct lines, and the words that each holds there."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lines, held = [], [], []
        keys = []
        for t in texts_of(batch, "text"):
            c = counts(t)
            rows.append((*c, failed(c[0], c[4])))
            raw = t.encode("utf-8", "surrogatepass")
            keys.append(signed(xxhash.xxh64_intdigest(raw, 42)))
            own: dict[int, int] = {}
            for line in raw.split(b"\n"):
                if n := len(line.split()):
                    h = line_hash(line)
                    own[h] = own.get(h, 0) + n
            lines.append(list(own))
            held.append(list(own.values()))
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        arrays = [column(batch, "doc_id"), pa.array(keys, pa.int64()), column(batch, "host"), *cols]
        arrays += [pa.array([r[5] for r in rows], pa.bool_()), pa.array(lines, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in STATS.split(", ")])

    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    return map_batches(read, run, STATS)


def verdicts(df: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", least_docs: int = LEAST_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """The counts of each document with ``removed`` (its boilerplate lines' hashes), ``removed_words`` and ``kept``."""
    stats = materialize(document_stats(df, text, host, doc_id).withColumn("row", F.monotonically_increasing_id()), "document-stats")
    lines = stats.select("row", "host", "tkey", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", "tkey", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    seen = lines.select("host", "line", "tkey").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least_docs)
    size = stats.select("host", "tkey").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    common = seen.join(size, "host").filter(F.col("n") > share * F.col("docs")).select("host", "line")
    removed = lines.join(common, ["host", "line"]).groupBy("row").agg(F.collect_set("line").alias("removed"), F.sum("words").alias("removed_words"))
    out = stats.drop("lines", "line_words").join(removed, "row", "left").drop("row")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= depleted * F.col("n_words")))


def without_lines(text: str, removed: set[int]) -> str:
    raw = text.encode("utf-8", "surrogatepass").split(b"\n")
    return b"\n".join(x for x in raw if not x.split() or line_hash(x) not in removed).decode("utf-8", "surrogatepass")


def keep_good(df: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", **limits: float) -> DataFrame:
    """The kept documents without their boilerplate lines; all columns stay."""
    ship(df.sparkSession)
    v = verdicts(df, text, host, doc_id, **limits).filter("kept").select("doc_id", "tkey", "host", "removed").dropDuplicates(["doc_id", "tkey", "host"])
    v = v.select(F.struct("doc_id", "tkey", "host").alias("_own"), F.col("removed").alias("_removed"))

    @F.arrow_udf("string")
    def rest(texts: pa.Array, removed: pa.Array) -> pa.Array:
        return pa.array([t if not r else without_lines(t, set(r)) for t, r in zip(texts.to_pylist(), removed.to_pylist())], pa.string())

    key = F.struct(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("tkey"), F.coalesce(F.col(host), F.lit("")).alias("host"))
    whole = df.select(F.struct("*").alias("_doc"), key.alias("_key")).join(v, F.col("_key").eqNullSafe(F.col("_own")))
    cols = [rest(F.col("_doc")[text], F.col("_removed")).alias(c) if c == text else F.col("_doc")[c].alias(c) for c in df.columns]
    return whole.select(*cols)


def quality_digest(df: DataFrame) -> DataFrame:
    return verdicts(df).select("doc_id", *BASE, "base_failed", "kept", "removed_words")


def oracle_sql(least_docs: int = LEAST_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> str:
    """The digest in DuckDB SQL, with the lines themselves for their hashes."""
    word, blank = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
words AS (SELECT r, regexp_extract_all(text, '{word}') AS w FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS held FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW}) x),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, held) AS n FROM windows) x WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + t.range) AS n_repeat_words FROM twice, range({WINDOW}) t GROUP BY r),
lines AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM docs),
normal AS (SELECT r, host, text, line, regexp_extract_all(lower(line), '{word}') AS w FROM lines WHERE regexp_matches(line, '{blank}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM normal GROUP BY r),
named AS (SELECT r, host, text, array_to_string(w, ' ') AS line, len(w) AS n FROM normal),
common AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM named GROUP BY host, line) x JOIN (SELECT host, count(DISTINCT text) AS docs FROM docs GROUP BY host) y USING (host)
  WHERE n > {least_docs} AND n > {share}e0 * docs
),
gone AS (SELECT r, CAST(sum(n) AS BIGINT) AS removed_words FROM named JOIN common USING (host, line) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM docs JOIN words USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_words <= {depleted}e0 * n_words AS kept, removed_words FROM judged
"""
