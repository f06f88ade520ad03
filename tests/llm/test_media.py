import random

import pytest

from tessera.llm import media as m


@pytest.mark.parametrize("kind", [m.XIPH, m.FIXED, m.EBML_LACING, m.NO_LACING])
@pytest.mark.parametrize("n", [1, 575, 576, 577, 576 * 8, 576 * 300 + 5])
def test_round_trip(kind, n):
    raw = random.Random(n).randbytes(n)
    data = raw + b"\xff" * (-n % 576)
    file = m.write_matroska(data, per_block=1 if kind == m.NO_LACING else 8, kind=kind)
    packets = m.parse_matroska(file)
    assert b"".join(file[p.start : p.start + p.size] for p in packets) == data
    assert [p.timestamp for p in packets] == [72 * k for k in range(len(packets))]
    assert sum(p.cued for p in packets) == -(-len(packets) // 256)


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACING])
def test_uneven_laces(kind):
    rnd = random.Random(1)
    frames = [rnd.randbytes(rnd.choice([1, 3, 254, 255, 256, 700, 20000])) for _ in range(9)]
    body = m.lace(frames, kind)
    assert [body[a : a + n] for a, n in m.unlace(body, 0, len(body), kind)] == frames


def test_malformed():
    good = m.write_matroska(b"x" * 576)
    for bad in (b"", b"\x00", good[:40], good[:-3]):
        with pytest.raises(m.Malformed):
            m.parse_matroska(bad)


def test_unknown_sizes():
    good = m.write_matroska(b"x" * 576 * 600)
    at = good.index(m._id(m.SEGMENT)) + 4
    _, after, _ = m.read_vint(good, at)
    open_ended = good[:at] + b"\xff" + good[after:]
    assert [p.size for p in m.parse_matroska(open_ended)] == [576] * 600


def test_digest(spark):
    rows = [(1, None), (1, ""), (2, "é" * 5000), (None, "a"), (2, "é" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, media string")
    got = sorted(m.media_digest(df).collect(), key=str)
    want = sorted([(k, *m.round_trip(t or "")) for k, t in rows], key=str)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert m.media_digest(df.limit(0)).count() == 0
    table = m.packet_table(m.store_text(df.drop("media")), "doc_id")
    assert table.filter("doc_id = 2").count() == 2 * -(-10000 // 576)


def test_query_against_the_text(spark):
    """All columns from the text itself; the stored form is read by a parser of its own."""
    from hashlib import sha256
    from zlib import crc32

    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "z" * 400_000]
    df = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in m.media_digest(df).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r, stored = got[k], m.write_matroska(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha256(stored).hexdigest())
    assert got[0].feature == got[1].feature and m.media_digest(df.limit(0)).count() == 0
    assert m.store_text(df).columns == df.columns
