import numpy as np
import pyarrow.parquet as pq

from tessera.llm import classifier as c


def walk(forest, row):
    """One tree after the other, one node after the other."""
    out = forest.base
    for f, t, v in zip(forest.feature, forest.threshold, forest.value):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if row[f[at]] > t[at] else 1)
        out += v[at - len(f)]
    return 1 / (1 + np.exp(-out))


def test_learns_and_walks():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = c.fit(x[:2000], y[:2000], trees=40)
    p = forest.scores(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(p[:20], [walk(forest, r) for r in x[2000:2020]])


def test_few_labels():
    assert c.fit(np.zeros((0, 20)), np.zeros(0)).scores(np.zeros((2, 20))).tolist() == [0.5, 0.5]
    assert (c.fit(np.zeros((30, 20)), np.ones(30)).scores(np.zeros((2, 20))) > 0.9).all()


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in c.quality_scores(documents, labels).collect()}
    told = pq.read_table(f"{d}/labels.parquet").to_pylist()
    right = [got[r["doc_id"]].predicted == r["quality"] for r in told if got[r["doc_id"]].held_out]
    assert len(right) > 100 and np.mean(right) > 0.93


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (2, "x " * 9), (2, "x " * 9)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = c.quality_scores(df, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert c.quality_scores(df.limit(0), labels.limit(0)).count() == 0
