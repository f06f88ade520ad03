import random
import re

import pytest
import xxhash

from tessera.llm import simhash as s
from tessera.llm.common import materialize
from tessera.llm.components import components


def slow(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 50, 700):
        text = "".join(rnd.choice(["Ab", "É", "c", "\x85"]) + rnd.choice([" ", "\n", "\t\x0b"]) for _ in range(n))
        assert s.fingerprint(text, 3) == slow(text)


def groups(fps, distance):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    fps = sorted(fps)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in fps}


@pytest.mark.parametrize("bucket", [2, 48])
@pytest.mark.parametrize("distance", [2, 4])
def test_links_are_whole(spark, bucket, distance):
    rnd = random.Random(distance)
    fps = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 12])):
            x ^= 1 << rnd.randrange(64)
            fps.add(x)
            x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, 7}
    df = spark.createDataFrame([(s.signed(x),) for x in fps], "fp long").repartition(3)
    made = s.links(materialize(df, "fps"), distance, bucket)
    pairs = [(r.a, r.b) for r in made.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in pairs)
    roots = {r.node: r.root for r in components(made).collect()}
    classes, want = {}, {}
    for x in fps:
        classes.setdefault(roots.get(s.signed(x), s.signed(x)), set()).add(x)
    for x, r in groups(fps, distance).items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_allocation():
    for widths, collisions in (([16] * 4, [5.0, 1e6, 2.0, 3.0]), ([32, 32], [1.0, 9.0]), ([22, 21, 21], [0.0] * 3)):
        t, _ = s.allocate(widths, collisions, 1000, 2)
        assert sum(x + 1 for x in t) == 3
    assert s.allocate([16] * 4, [5.0, 1e6, 2.0, 3.0], 1000, 2)[0][1] == -1


def test_documents(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(20)]
    rows = [(10 * k + j, b + (" tail" if j == 1 else "")) for k, b in enumerate(base) for j in range(3)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, base[0]), (903, "one"), (903, "one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = s.simhash_digest(df).collect()
    fps = {slow(t or "") for _, t in rows}
    roots = groups(fps, 2)
    least = {}
    for k, t in rows:
        r = roots[slow(t or "")]
        least[r] = min(least.get(r, 10**9), 10**9 if k is None else k)
    want = sorted((str(k), f"{slow(t or ''):016x}", least[roots[slow(t or "")]]) for k, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = s.keep_one(df, 3)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(least.values())
    assert s.simhash_digest(df.limit(0)).count() == 0 and s.keep_one(df.limit(0)).count() == 0
