import random

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODER = bpe.Encoder(bpe.load(PATH), public_tokenizers.PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.v.ranks, special_tokens={})
PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "a", "B", "é", "ß", "1", "٣", "½", "!", "#", "'s", "'ll", "中", "😀", "_", "\r", "\x00", "​", "́", "the", " the", "\x0b"]


def test_pattern_is_wordwise():
    assert ENCODER.by_words


@pytest.mark.parametrize("seed", range(20))
def test_random_texts(seed):
    rnd = random.Random(seed)
    for _ in range(500):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        ids = ENCODER.encode(text)
        assert list(ids) == KNOWN.encode_ordinary(text), text
        assert ENCODER.decode(ids) == text.encode()


def test_long_piece():
    for text in ("a" * 20000, "=" * 3000, " " * 3000, "xyzzy" * 2000):
        assert list(ENCODER.encode(text)) == KNOWN.encode_ordinary(text)


def test_prefixes_and_edits():
    rnd = random.Random(3)
    table = bpe.PrefixTable(ENCODER.v, b"")
    raw = bytes(rnd.choice(b"abcdehinorst") for _ in range(400))
    for k in range(0, 400, 7):
        table.append(raw[k : k + 7])
    for end in (1, 5, 50, 399, 400):
        assert b"".join(ENCODER.v.bytes[t] for t in table.tokens(end)) == raw[:end]
        assert table.tokens(end) == bpe.PrefixTable(ENCODER.v, raw[:end]).tokens()
    for _ in range(60):
        a = rnd.randint(0, len(raw))
        b = min(len(raw), a + rnd.randint(0, 5))
        new = bytes(rnd.choice(b"abcdehinorst") for _ in range(rnd.randint(0, 4)))
        raw = raw[:a] + new + raw[b:]
        table.replace(a, b, new)
        assert table.piece == raw and table.last == bpe.PrefixTable(ENCODER.v, raw).last


def test_frames(spark):
    rows = [(1, None), (2, ""), (None, "the end"), (2, "the end"), (3, "x  y \n z " * 500)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, ids string")
    pattern = public_tokenizers.PATTERN
    got = bpe.token_digest(df, PATH, pattern).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(KNOWN.encode_ordinary(t or "")) for _, t in rows)
    assert bpe.token_digest(df.limit(0), PATH, pattern).count() == 0
    back = bpe.decode_column(bpe.encode_column(df, PATH, pattern), PATH, pattern).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
