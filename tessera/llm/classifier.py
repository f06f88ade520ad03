"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Trees are full binary trees of one depth in level order, so a whole batch goes
through all trees by numpy indexing, one step a level.

The learner reads at most ``most_rows`` labelled rows (those with the least hash
of the id, a documented bound); scores are given to every document.

Nulls: a null or empty text has statistics of zero and is scored like any other;
rows without a label, or with a null id, teach nothing. Labels that contradict
each other for one id: the larger counts. Without labelled rows, or with one
class only, all scores are the class's share (0.5 for none). Repeated rows get
the same score. An empty table gives an empty result. Columns other than the
text and the id are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, map_batches, texts_of

MOST_ROWS = 50_000

FEATURES = (
    "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "upper", "digits", "punctuation", "symbols", "pipes", "bangs",
    "non_ascii", "log_lines", "mean_line", "repeated_lines", "closed_lines", "commas", "stops", "entropy", "short_words",
)

_DROP = {name: bytes(set(range(256)) - set(keep)) for name, keep in {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "punctuation": b".,;:?!'\"()-", "symbols": b"#*$%&<>|=+/\\^~_@{}[]", "pipes": b"|", "bangs": b"!",
    "non_ascii": bytes(range(128, 256)), "commas": b",", "stops": b".",
}.items()}


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES; all zero for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    share = {name: len(raw.translate(None, drop)) / size for name, drop in _DROP.items()}
    known: dict[bytes, int] = {}
    for w in words:
        known[w] = known.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = seen[seen > 0] / size
    return [
        log2(n), float(lengths.mean()), log2(float(lengths.max())), len(known) / n, max(known.values()) / n, share["upper"], share["digits"],
        share["punctuation"], share["symbols"], share["pipes"], share["bangs"], share["non_ascii"], log2(len(lines)), n / len(lines),
        1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?:\"" for x in lines) / len(lines), share["commas"], share["stops"],
        float(-(p * np.log2(p)).sum()), float((lengths <= 2).mean()),
    ]


@dataclass
class Forest:
    """Trees as arrays: inner nodes have a feature and a threshold, leaves a value; children of node i are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for first in range(0, len(x), 4096):
            part = x[first : first + 4096]
            rows = np.arange(len(part))
            for feature, threshold, value in zip(self.feature, self.threshold, self.value):
                at = np.zeros(len(part), np.int64)
                while at[0] < inner:
                    at = 2 * at + 1 + (part[rows, feature[at]] > threshold[at])
                out[first : first + 4096] += value[at - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic boosting on binned features; ``least``: the hessian a child must have."""
    mean = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or mean in (0.0, 1.0):
        none = np.zeros((0, 2**depth - 1))
        flat = 0.0 if not len(y) else float(np.log((mean * len(y) + 0.5) / (len(y) - mean * len(y) + 0.5)))
        return Forest(flat, none.astype(np.int64), none, np.zeros((0, 2**depth)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            gains = np.zeros(nodes)
            for j in range(width):
                if not len(edges[j]):
                    continue
                cell = local * bins + binned[j]
                gs = np.bincount(cell, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(cell, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                cut = slice(0, len(edges[j]))
                gl, hl = gs[:, cut], hs[:, cut]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                best = gain.argmax(1)
                top = gain[np.arange(nodes), best]
                for k in np.flatnonzero(top > gains + 1e-9):
                    gains[k], feature[first + k], threshold[first + k] = top[k], j, edges[j][best[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values))


def with_statistics(df: DataFrame, text: str = "text", key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """key, the other columns named, and the statistics as an array."""
    kept = [key, *more]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", statistics array<double>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in texts_of(batch, "_text")]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(x, pa.list_(pa.float64()))], [*kept, "statistics"])

    return map_batches(df.select(*kept, F.col(text).alias("_text")), run, schema)


def train(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", most_rows: int = MOST_ROWS) -> Forest:
    """A forest from at most ``most_rows`` labelled rows of df."""
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    )
    # Joined by broadcast: most_rows bounds it.
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")
    got = with_statistics(rows, "_t", "_id", ("_y",)).groupBy("_id").agg(F.min(F.struct("statistics", "_y")).alias("s")).orderBy("_id").select("s.statistics", "s._y").toArrow()
    y = got.column("_y").to_numpy()
    x = np.array(got.column("statistics").to_pylist(), float).reshape(len(y), len(FEATURES))
    return fit(x, y)


SCORES = "doc_id long, score double"


def score(df: DataFrame, forest: Forest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts_of(batch, "text")])
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(forest.scores(x), pa.float64())], ["doc_id", "score"])

    return map_batches(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, SCORES)


def quality_scores(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; ids whose CRC-32 leaves 1 when divided by 3 are held out."""
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    forest = train(documents, labels.select("doc_id", "quality").filter(~out), most_rows=most_rows)
    scored = score(documents, forest)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
