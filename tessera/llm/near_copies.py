"""Near copies: SimHash links and bands of least hashes propose, the exact Jaccard similarity of word shingles decides.

A 64-bit fingerprint can't tell a similarity of 0.8: there fingerprints differ in
about 10 bits, and probing for that many reaches a fixed share of all pairs. So
the links of ``simhash`` (general pigeonhole, ``DISTANCE`` bits) find the closer
copies, and bands find the others: of BANDS bands, each the least values of ROWS
hash functions over the set of shingles, a pair of similarity s shares one with
probability 1 - (1 - s^ROWS)^BANDS: 0.9995 at 0.8, 0.99999 at 0.85, and under
0.01 at 0.3. Texts with a component or a band in common form a list.

A short list is paired off. In a long one, the text with most texts in its lists
is the hub and is held against all others, so a large group with its original is
settled at once. What is left are lists that still hold more than one component.
Their texts are joined by prefix filtering, which misses no similar pair: the
shingles of a text are put in order, those rare among these texts first, and of
two similar texts with x and y shingles of which at least o are common, one
common shingle is among the x - o + 1 first of the one and the y - o + 1 first of
the other. Copies edited on their own have their edits there, which no other text
has; so what isn't similar hardly ever meets, however large the group.

Nulls: a null text counts as empty; texts without words are copies of each other.
Ties: equal texts are one from the start. A text of any length has a list of
fixed size and is hashed in blocks. An empty table gives an empty result. All
columns are kept, also those with names of the result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import column, discard, map_batches, materialize, ship, texts_of
from tessera.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
DISTANCE = 2
BANDS, ROWS = 32, 7
#: Lists up to this are paired off at once.
FEW = 12

_random = np.random.default_rng(simhash.SEED)
_TURNS = _random.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def distinct_hashes(text: str) -> np.ndarray:
    """The set of shingles by their hashes; no words are one shingle."""
    return _set(simhash.shingle_hashes(text, WIDTH))


def similar(a: str, b: str, least: float) -> bool:
    x, y = distinct_hashes(a), distinct_hashes(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(both >= least * (len(x) + len(y) - both) - 1e-9)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band: equal where the least values of its hash functions are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for first in range(0, len(hashes), 1024):
        turned = (hashes[None, first : first + 1024] ^ _TURNS[0][:, None]) * _TURNS[1][:, None]
        np.minimum(least, turned.min(1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    return mixed ^ mixed >> np.uint64(29)


_MARKS = "id long, n int, fp long, bands array<long>"


def _marks(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, n, fps, tokens = [], [], [], []
    for key, text in dict(zip(column(batch, "id").to_pylist(), texts_of(batch, "text"))).items():
        hashes = simhash.shingle_hashes(text, WIDTH)
        own = _set(hashes)
        ids.append(key)
        n.append(len(own))
        fps.append(simhash.signed(simhash.fingerprint_of(hashes)))
        tokens.append(bands(own).view(np.int64))
    cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(fps, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _MARKS.split(", ")])


def lists(marks: DataFrame) -> DataFrame:
    """token, size (texts of it), id, n and weight (how many texts its lists hold) of the texts that share a token; marks: one row a text."""
    classes = materialize(marks.groupBy("fp").agg(F.count("*").alias("texts")), "fingerprints")
    roots = components(simhash.links(classes.select("fp"), DISTANCE)).withColumnRenamed("node", "fp")
    by_print = marks.join(roots, "fp", "left").select(F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("token"), "id", "n")
    each = by_print.unionByName(marks.select(F.posexplode("bands").alias("band", "value"), "id", "n").select(F.xxhash64("band", "value").alias("token"), "id", "n"))
    each = materialize(each, "tokens")
    sizes = materialize(each.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"), "list-sizes")
    shared = materialize(each.join(sizes, "token"), "shared-tokens")
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    posts = materialize(shared.join(weights, "id"), "posts")
    discard(classes, each, sizes, shared)
    return posts


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """A written table of the similar ones of pairs a, b; held: k, text, which both sides of the join read alike, so it is dealt out once."""

    @F.arrow_udf("boolean")
    def same(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similar(s.as_py(), t.as_py(), similarity) for s, t in zip(x, y)], pa.bool_())

    side = lambda end, name: held.withColumnsRenamed({"k": end, "text": name})
    compared = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return materialize(compared.withColumn("same", same("x", "y")).filter("same").select("a", "b"), "verified")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def by_hubs(posts: DataFrame, similarity: float) -> DataFrame:
    """A written table of pairs a, b: all of a short list, those with the hub of a long one; posts: token, id, n, weight, size."""
    whole = F.when(F.col("size") <= FEW, F.col("id"))
    hubs = posts.groupBy("token", whole.alias("whole")).agg(F.max(F.struct("weight", "id", "n")).alias("hub")).select("token", "hub")
    ratio = (F.least("n", "hub.n") >= similarity * F.greatest("n", "hub.n") - 1e-6) & (F.col("id") != F.col("hub.id"))
    return materialize(posts.join(hubs, "token").filter(ratio).select(*_pair("id", "hub.id")).distinct(), "hub-pairs")


def _shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes = [distinct_hashes(t).view(np.int64) for t in texts_of(batch, "text")]
    return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([len(h) for h in hashes], pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["id", "n", "hashes"])


def by_prefix(texts: DataFrame, similarity: float) -> DataFrame:
    """A written table of pairs a, b with different roots, all similar ones among them; texts: id, root, text."""
    each = materialize(map_batches(texts.select("id", "text"), _shingles, "id long, n int, hashes array<long>").select("id", "n", F.explode("hashes").alias("h")), "late-shingles")
    often = each.groupBy("h").agg(F.count("*").alias("f")).filter("f > 1")
    # Shingles of one text come first and meet nothing: only their number counts.
    shared = each.join(often, "h")
    every = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(every) + F.row_number().over(every.orderBy("f", "h")) - 1
    least = lambda n: F.ceil(n - 1e-9)
    first = shared.withColumn("at", place).filter(F.col("at") <= F.col("n") - least(similarity * F.col("n"))).select("h", "id", "n", "at")
    first = materialize(first.join(texts.select("id", "root"), "id"), "late-prefixes")
    # Texts of a list's commonest root needn't meet each other.
    roots = first.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root"))["root"].alias("top"))
    others = first.join(roots.filter("roots > 1"), "h").filter("root != top").select("h", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "root")))
    both = least(similarity / (1 + similarity) * (F.col("n") + F.col("n2")))
    close = (F.col("root") != F.col("root2")) & (F.col("at") <= F.col("n") - both) & (F.col("at2") <= F.col("n2") - both)
    pairs = materialize(first.join(others, "h").filter(close).select(*_pair("id", "id2")).distinct(), "late-pairs")
    discard(each, first)
    return pairs


def linked(posts: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """node and root of the components of the similar pairs in lists; posts: token, id, n (shingles), weight, size; held: k, text."""
    tried = by_hubs(posts, similarity)
    found = verified(tried, held, similarity)
    roots = components(found)
    rooted = posts.filter(F.col("size") > FEW).join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("token")
    late = materialize(rooted.join(open_, "token", "left_semi").select("id", "root").distinct(), "late-texts")
    if late.isEmpty():
        return roots
    more = by_prefix(late.join(held.withColumnRenamed("k", "id"), "id"), similarity).join(tried, ["a", "b"], "left_anti")
    more = materialize(more, "late-untried")
    # Few of the texts are in these pairs.
    ends = more.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    more = verified(more, materialize(held.join(ends, "k", "left_semi"), "late-held"), similarity)
    return roots if more.isEmpty() else components(found.unionByName(more))


def text_classes(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, tkey (hash of the text) and root (the class) of every row."""
    ship(df.sparkSession)
    read = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    marks = materialize(map_batches(read.select(F.col("tkey").alias("id"), "text"), _marks, _MARKS).dropDuplicates(["id"]), "marks")
    posts = lists(marks)
    discard(marks)
    # Copies fold into one before the shuffle.
    texts = read.groupBy(F.col("tkey").alias("k")).agg(F.first("text").alias("text"))
    held = materialize(texts.join(posts.select(F.col("id").alias("k")).distinct(), "k", "left_semi"), "held-texts")
    roots = linked(posts, held, similarity).withColumnRenamed("node", "tkey")
    return read.select("doc_id", "tkey").join(roots, "tkey", "left").withColumn("root", F.coalesce("root", "tkey"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the least id (null ids last) and text hash; all columns stay."""
    found = text_classes(df, text, key, similarity)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("f"))
    own = lambda i, t: {"_none": i.isNull(), "_id": F.coalesce(i, F.lit(0)), "_text": t}
    kept = first.select(*(c.alias(n) for n, c in own(F.col("f.doc_id"), F.col("f.tkey")).items()))
    whole = df.select(F.struct("*").alias("_doc"), *(c.alias(n) for n, c in own(F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).items()))
    # The same three columns, none of them null, deal the rows for the join and for rows that repeat.
    one = whole.join(kept, ["_none", "_id", "_text"]).dropDuplicates(["_none", "_id", "_text"])
    return one.select(*(F.col("_doc")[c].alias(c) for c in df.columns))
