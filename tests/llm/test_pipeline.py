"""The pipeline against a version of plain loops."""

import random
from collections import defaultdict

import pytest
from test_mixing import brute as mixed

from tessera.llm import mixing, near_copies, secrets


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(21)
    vocabulary = [f"w{k}" for k in range(2500)]
    words = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = []
    # A host with a template of three lines, one with a line that only copies share.
    for k in range(60):
        out.append((k, f"Top of the page\n{words(rnd.randint(30, 60))}\nRead more here\nAll rights kept", "en", "host"))
    out += [(100 + k, f"{words(40)}\nToken = \"{k:032x}\" and then\n{words(5)}", "de", f"src{k % 3}") for k in range(30)]
    # Near copies, exact copies, depleted, short, repeating and empty documents.
    base = words(200)
    for k in range(12):
        edited = base.split()
        edited[rnd.randrange(200)] = f"edit{k}"
        out.append((200 + k, " ".join(edited), "fr", "src7"))
    out += [(300 + k, out[70][1], "de", "src1") for k in range(5)]
    out += [(400 + k, "Top of the page\nRead more here\nAll rights kept\nAll rights kept\nTop of the page\nRead more here\nRead more here\none", "en", "host") for k in range(3)]
    out += [(500, "too short", "en", "x"), (501, "again and again " * 40, "en", "x"), (502, "", "en", "x"), (503, None, "en", "x"), (None, words(50), None, None), (504, words(60), None, "src9")]
    out += [out[3], out[3]]
    return [(*r, None if r[1] is None else len(r[1]), "clash") for r in out]


def words_of(text):
    return text.encode().split()


def plain(rows):
    # Rules.
    named = lambda line: b" ".join(line.lower().encode().split())
    texts, docs = defaultdict(set), defaultdict(set)
    for _, text, _, source, *_ in rows:
        t, host = text or "", source or ""
        docs[host].add(t)
        for line in t.split("\n"):
            if line.split():
                texts[host, named(line)].add(t)
    common = {k for k, v in texts.items() if len(v) > 20 and len(v) > 0.05 * len(docs[k[0]])}
    kept = []
    for doc, text, lang, source, *_ in rows:
        t, host = text or "", source or ""
        w = words_of(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        repeated = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        gone = [x for x in t.split("\n") if x.split() and (host, named(x)) in common]
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and sum(len(x.split()) for x in gone) <= 0.8 * len(w):
            kept.append((doc, "\n".join(x for x in t.split("\n") if not x.split() or (host, named(x)) not in common), lang, source))
    # Near copies.
    root = list(range(len(kept)))
    for i, a in enumerate(kept):
        for j in range(i):
            if near_copies.similar(a[1], kept[j][1], 0.8):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(kept[k])
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    # Secrets, mix.
    kept = [(d, secrets.redacted(t, secrets.spans(t)[1]), lang, source) for d, t, lang, source in kept]
    from zlib import crc32

    path = lambda lang, source: (f"dom{crc32((source or '').encode()) % 4}", lang or "", source or "")
    drawn, _ = mixed([(d, path(lang, source), len(words_of(t))) for d, t, lang, source in kept], mixing.SHARE, mixing.EPOCHS, mixing.WEIGHTS)
    by = {str((d, *path(lang, source))): (d, lang, source, t) for d, t, lang, source in kept}
    return [by[x.rsplit(", ", 2)[0] + ")"] for x in drawn]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


def test_against_plain_loops(spark, rows, tmp_path):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import corpus_pipeline

    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted(str((d, lang, source, coder.encode_ordinary(t))) for d, lang, source, t in plain(rows))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.lang, r.source, r.ids)) for r in got) == want and len(want) > 40
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_bear_empty_tables(spark, rows):
    import corpus_pipeline

    docs = frame(spark, rows)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == empty.columns, name
        assert stage(spark, empty, "").count() == 0, name
    assert docs.filter("fp = 'clash'").count() == docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0
