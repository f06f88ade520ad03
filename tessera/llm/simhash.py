"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits are split into parts of correlated bits; part i gets a threshold
t_i, possibly -1, with the sum of (t_i + 1) equal to the distance plus 1. Two
fingerprints within the distance then differ in at most t_i bits in some part.
Thresholds are allocated by dynamic programming on estimated candidate counts,
which come from the collisions of every part's values over all fingerprints.
Fingerprints probe the buckets of a part's values with up to t_i bits flipped,
and candidates are verified.

Scale: exact copies are one fingerprint from the start. A bucket of more than
``bucket`` fingerprints isn't paired off: fingerprints that reach one meet at
the points within half the distance of them instead, a fixed number of rows for
each, and at one point there can only be that many. This loses no link, as two
fingerprints are within the distance just if such points meet. So nothing grows
with the square of a group.

Nulls: a null text counts as empty, with fingerprint zero; a null id is kept and
never the id of a component that has another. Ties and repeated rows: rows of
one fingerprint are one class, whose id is the least. A text of any length is
hashed whole, its bits unpacked in blocks. An empty table gives an empty result.
Columns other than those named are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, map_batches, materialize, texts_of
from tessera.llm.components import components

BITS = 64
SEED = 42
BUCKET = 48
#: Numbers of parts among which the estimated cost decides.
PARTS = (2, 3, 4)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The XXH64 of all word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    ends = starts[width:] if len(words) >= width else starts[-1:]
    hashes = b"".join([xxhash.xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)])
    return np.frombuffer(hashes, ">u8", n).astype(np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without any. Bits are unpacked in blocks, so a long text takes no more memory."""
    sums = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 65536):
        block = hashes[first : first + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(block, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big")


def fingerprint(text: str, width: int) -> int:
    """Bits set in over half of the hashes of all word shingles; zero without words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(df: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, tkey (a hash of the text) and fp of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "text")
        fps = [signed(fingerprint(t, width)) for t in texts]
        keys = [signed(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED)) for t in texts]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(keys, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "tkey", "fp"])

    return map_batches(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, tkey long, fp long")


# -- parts and thresholds ----------------------------------------------------


def bit_products(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits set; the number of all in the extra last cell."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = column(batch, "fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
        x = np.unpackbits(raw, axis=1).astype(np.float64)
        cells = np.append((x.T @ x).ravel(), len(x))
        return pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["cell", "n"])

    held = map_batches(fps.select("fp"), run, "cell int, n double").groupBy("cell").agg(F.sum("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for cell, n in held:
        out[cell] = n
    return out


def correlations(cells: np.ndarray) -> np.ndarray:
    n = max(cells[-1], 1)
    both = cells[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(corr: np.ndarray, parts: int) -> list[int]:
    """Masks of parts of nearly equal width: each starts from the bit most correlated with the rest and takes the bits closest to it."""
    free, masks = set(range(BITS)), []
    for k in range(parts, 0, -1):
        width = -(-len(free) // k)
        idle = sorted(free)
        own = [max(idle, key=lambda b: (corr[b, idle].sum(), -b))]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        # Bit 0 of a row is the highest of the number.
        masks.append(sum(1 << BITS - 1 - b for b in own))
    return masks


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def allocate(widths: list[int], collisions: list[float], rows: int, distance: int) -> tuple[list[int], float]:
    """Thresholds that sum to distance + 1 - parts at the least cost: probes, and candidates bounded by collisions times values in the ball."""

    def cost(part: int, t: int) -> float:
        return 0.0 if t < 0 else ball(widths[part], t) * (rows + collisions[part])

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in range(len(widths)):
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for t in range(-1, min(widths[part], distance - used) + 1):
                to = used + t + 1
                total = so_far + cost(part, t)
                if to <= distance + 1 and (to not in now or total < now[to][0]):
                    now[to] = (total, [*chosen, t])
        best = now
    total, chosen = best[distance + 1]
    return chosen, total


def flips(mask: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits out of those in mask, as signed numbers."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [signed(sum(c)) for k in range(radius + 1) for c in combinations(bits, k)]


def plan(fps: DataFrame, distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the parts of the cheapest split; parts that aren't probed are left out."""
    cells = bit_products(fps)
    rows = int(cells[-1])
    corr = correlations(cells)
    splits = {m: group_bits(corr, m) for m in PARTS}
    keys = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("v")) for m, masks in splits.items() for i, mask in enumerate(masks)))
    counted = fps.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("c"))
    found = {(m, i): s for m, i, s in counted.groupBy("k.m", "k.i").agg(F.sum(F.col("c") * (F.col("c") - 1))).collect()}
    options = []
    for m, masks in splits.items():
        t, cost = allocate([x.bit_count() for x in masks], [found.get((m, i), 0.0) for i in range(m)], rows, distance)
        options.append((cost, [(mask, k) for mask, k in zip(masks, t) if k >= 0]))
    return min(options, key=lambda x: x[0])[1]


# -- links -------------------------------------------------------------------


def _near(x: Column, y: Column, distance: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= distance


def _flipped(value: Column, mask: int, radius: int) -> Column:
    return F.transform(F.array(*map(F.lit, flips(mask, radius))), lambda f: f.bitwiseXOR(value))


def links(fps: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Links a, b that connect distinct fingerprints ``fp`` as all pairs within the distance do; every link is within it."""
    if distance % 2:
        raise ValueError("the distance must be even")
    parts = plan(fps, distance)
    index = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("v")) for i, (mask, _) in enumerate(parts)))).alias("k")).select("fp", "k.i", "k.v")
    probe = None
    for i, (mask, t) in enumerate(parts):
        value = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        own = fps.select("fp", F.lit(i).alias("i"), F.explode(_flipped(value, mask, t)).alias("v"))
        probe = own if probe is None else probe.unionByName(own)
    alone = [i for i, (_, t) in enumerate(parts) if t > 0]
    size = index.groupBy("i", "v").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("i").isin(alone))
    few = index.join(size.filter(F.col("n") <= bucket), ["i", "v"]).groupBy("i", "v").agg(F.collect_list("fp").alias("own"))
    buckets = materialize(few.unionByName(size.filter(F.col("n") > bucket).select("i", "v", F.lit(None).cast("array<bigint>").alias("own"))), "buckets")
    reached = materialize(
        probe.join(buckets, ["i", "v"]).select("fp", F.col("own").isNull().alias("large"), F.filter("own", lambda y: (y > F.col("fp")) & _near(y, F.col("fp"), distance)).alias("near")).filter("large or size(near) > 0"),
        "reached",
    )
    # With thresholds above 0 a pair may be reached from one side only in another part, so both orders are probed; "y > fp" keeps one.
    paired = reached.filter("not large").select(F.col("fp").alias("a"), F.explode("near").alias("b"))
    points = reached.filter("large").select("fp").distinct().select("fp", F.explode(_flipped(F.col("fp"), (1 << BITS) - 1, distance // 2)).alias("point"))
    met = points.groupBy("point").agg(F.collect_list("fp").alias("own")).filter("size(own) > 1").select(F.array_min("own").alias("a"), F.explode("own").alias("b")).filter("a != b")
    return paired.unionByName(met)


def near_duplicates(rows: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Adds component_id, the least doc_id reachable, to a written table with doc_id and fp."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), distance, bucket)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(ids, "root").drop("root"), "fp")


def keep_one(df: DataFrame, width: int = 5, distance: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, that of the least id and text hash; all columns stay."""
    rows = materialize(fingerprints(df, width, text, key), "fingerprints")
    found = near_duplicates(rows, distance)
    # A component without any id is told by its fingerprint's root only through its rows, so those are kept apart by fingerprint.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    first = found.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("f"))
    first = first.select(F.struct("f.doc_id", "f.tkey").alias("_first"))
    own = F.struct(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tkey"))
    whole = df.select(F.struct("*").alias("_doc"), own.alias("_key"))
    kept = whole.join(first, F.col("_key").eqNullSafe(F.col("_first"))).dropDuplicates(["_key"])
    return kept.select(*(F.col("_doc")[c].alias(c) for c in df.columns))


def simhash_digest(df: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    rows = materialize(fingerprints(df, width), "fingerprints")
    return near_duplicates(rows, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
