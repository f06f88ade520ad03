import random

from tessera.llm import near_copies as n


def edited(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"edit{rnd.random()}"
    return " ".join(out)


def test_keeps_one_of_each_group(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows, group, sources = [], {}, []
    for k in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 150, 400, 900]))]
        text = " ".join(words) + "\n" + passage
        sources.append(text)
        for j in range(rnd.choice([1, 1, 3, 8])):
            copy = text if j < 1 else edited(rnd, text.split(" "), max(1, len(words) // 150))
            group[len(rows)] = k
            rows.append((len(rows), copy))
    assert all(n.similar(sources[group[k]], t, 0.8) for k, t in rows)
    extra = [(9000, None), (9001, ""), (None, "alone"), (9002, "short text"), (9002, "short text"), (9003, sources[0])]
    df = spark.createDataFrame([(*r, "f") for r in rows + extra], "doc_id long, text string, fp string")
    kept = n.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 9000)
    firsts = sorted({min(i for i, g in group.items() if g == k) for k in group.values()})
    # No clean document is lost; hardly any copy stays.
    assert set(firsts) <= set(got)
    assert len(got) - len(firsts) <= 0.02 * len(rows)
    assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id is None or r.doc_id >= 9000) == ["9000", "9002", "None"]
    assert n.keep_one(df.limit(0)).count() == 0


def kept_ids(spark, texts):
    return sorted(r.doc_id for r in n.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_copies_similar_only_to_the_original(spark):
    rnd = random.Random(4)
    for words, edits, copies in ((300, 6, 50), (1000, 20, 50)):
        base = [f"v{rnd.randrange(5000)}" for _ in range(words)]
        texts = [" ".join(base)] + [edited(rnd, base, edits) for _ in range(copies)]
        texts = [t for t in texts if n.similar(texts[0], t, 0.8)]
        assert sum(n.similar(a, b, 0.8) for a in texts[1:] for b in texts[1:] if a < b) < len(texts) ** 2 / 8
        rnd.shuffle(texts)
        assert kept_ids(spark, texts) == [0]


def test_as_all_pairs(spark):
    """Short texts, texts that repeat lines, chains and groups without an original, against brute force."""
    rnd = random.Random(9)
    texts = []
    for k in range(60):
        base = [f"s{rnd.randrange(900)}" for _ in range(rnd.choice([3, 20, 25, 30, 40]))]
        texts += [" ".join(base), " ".join([*base, f"end{k}"]), " ".join([f"other{k}", *base[1:]])]
    line = "the same line again and again of it"
    texts += ["\n".join([line] * 30 + ["one two three four five six"]), "\n".join([line] * 2 + ["one two three four five six"])]
    base = [f"g{rnd.randrange(5000)}" for _ in range(300)]
    texts += [edited(rnd, base, 5) for _ in range(30)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if n.similar(a, texts[j], 0.8):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    assert kept_ids(spark, texts) == [i for i in range(len(texts)) if root[i] == i]


def test_recall_in_each_length_class():
    """Of pairs with a similarity of 0.8 to 0.86, how many share a band; a pair that shares one is compared exactly."""
    rnd = random.Random(3)
    for words in (25, 40, 100, 300, 1000):
        met = tried = 0
        while tried < 150:
            base = [f"r{rnd.randrange(9000)}" for _ in range(words)]
            copy = list(base)
            for _ in range(max(1, words // 50)):
                copy[rnd.randrange(words)] = f"edit{rnd.random()}"
            a, b = n.distinct_hashes(" ".join(base)), n.distinct_hashes(" ".join(copy))
            both = len(set(a.tolist()) & set(b.tolist()))
            if 0.8 <= both / (len(a) + len(b) - both) <= 0.86 or words < 100 and n.similar(" ".join(base), " ".join([*base, "end"]), 0.8):
                b = b if words >= 100 else n.distinct_hashes(" ".join([*base, "end"]))
                tried += 1
                met += bool((n.bands(a) == n.bands(b)).any())
        assert met >= 0.99 * tried, (words, met)
