import random

import numpy as np
import pytest

from tessera.functions import jpeg, pixels
from tessera.plans.fixture_jpeg import encode, segment
from tessera.operators import classify, decode, quality
from tessera.sources import bmp

SAMPLINGS = {"444": (1, 1), "422": (2, 1), "440": (1, 2), "420": (2, 2)}


def coefficients(width, height, comps, seed=1):
    rng = random.Random(seed)
    mh, mv = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-(-(-width // 8)) // mh), -(-(-(-height // 8)) // mv)
    block = lambda: [rng.randint(-200, 200)] + [rng.choice((0, 0, 0, 0, rng.randint(-60, 60))) for _ in range(63)]
    return {
        (k, m // across * mv + y, m % across * mh + x): block()
        for m in range(across * down) for k, (_, h, v) in enumerate(comps) for y in range(v) for x in range(h)
    }


def colour(h=1, v=1):
    return [(1, h, v), (2, 1, 1), (3, 1, 1)]


def image(width=17, height=9, h=1, v=1, **options):
    return encode(width, height, colour(h, v), coefficients(width, height, colour(h, v)), **options)


def table(spark, contents):
    rows = [(k, f"f{k}.jpg", len(c), bytearray(c)) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "file_index int, path string, length long, content binary")


@pytest.mark.parametrize("size", [(33, 21), (8, 8), (34, 17)])
@pytest.mark.parametrize("sampling", SAMPLINGS)
@pytest.mark.parametrize("interval", [0, 1, 3])
def test_coefficients_come_back(size, sampling, interval):
    comps = colour(*SAMPLINGS[sampling])
    blocks = coefficients(*size, comps)
    data = encode(*size, comps, blocks, interval=interval)
    zz, keys = jpeg.decode_scan(data, jpeg.parse_header(data))
    sums, seen = {}, {}
    for row, (brow, bcol, comp, _, part) in zip(zz.tolist(), keys.tolist()):
        sums[comp, part] = row[0] = sums.get((comp, part), 0) + row[0]
        seen[comp, brow, bcol] = pixels.np_dezigzag(np.array([row]))[0].tolist()
    assert seen == blocks


def test_fused_and_relational_agree(spark):
    contents = [image(33, 21, *s) for s in SAMPLINGS.values()]
    contents.append(encode(16, 16, [(1, 1, 1)], coefficients(16, 16, [(1, 1, 1)])))
    df = table(spark, contents)
    fused = {r.file_index: np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3) for r in decode.decode(df).collect()}
    rows = decode.decode_relational(df).collect()
    assert len(rows) == sum(x.shape[0] * x.shape[1] for x in fused.values())
    assert all(tuple(fused[r.file_index][r.y, r.x].tolist()) == (r.r, r.g, r.b) for r in rows)
    grey = fused[4]
    assert (grey[..., 0] == grey[..., 1]).all() and (grey[..., 1] == grey[..., 2]).all()


def broken():
    good = image()
    sof = good.index(b"\xff\xc0")
    sos = good.index(b"\xff\xda")
    at = lambda k, v: good[:k] + bytes([v]) + good[k + 1 :]
    yield from (b"", b"no image", good[: sos - 4], good[: len(good) // 2 + 40 if len(good) // 2 > sos else sos + 16])
    yield at(sof + 4, 12)  # precision
    yield good[: sof + 7] + b"\0\0" + good[sof + 9 :]  # no width
    yield at(sof + 9, 4)  # components
    yield at(sof + 10, 0)  # component id
    yield at(sof + 11, 0x31)  # luma factor
    yield at(sof + 14, 0x21)  # chroma factor
    yield at(sof + 1, 0xC2)  # progressive
    yield at(sos + 4, 2)  # component count
    yield at(sos + 11, 1)  # Ss
    yield at(sos + 13, 1)  # Ah, Al
    yield good[:2] + segment(0xDD, b"\0\0\0") + good[2:]  # restart length
    yield good[:2] + b"\xff\xe0\0\1" + good[2:]  # segment length
    yield good[:2] + segment(0xDB, b"\4" + bytes(64)) + good[2:]  # table id
    yield good[:2] + b"\xff\xd9" + good[2:]  # end in the header


def test_broken_files_give_reasons_and_the_batch_goes_on(spark):
    bad = list(broken())
    rows = decode.decode(table(spark, [*bad, image()])).orderBy("file_index").collect()
    assert [r.file_index for r in rows if r.error is None] == [len(bad)]
    assert all(r.error and r.rgb is None for r in rows[:-1])


def test_junk_and_table_forms_are_borne():
    plain = jpeg.decode_image(image(33, 21))[1]
    for options in ({"extra": segment(0xE0, b"app") + segment(0xFE, b"note")}, {"wide_tables": True}, {"joined": True}, {"end": False}, {"fill": b"\xff"}):
        assert (jpeg.decode_image(image(33, 21, **options))[1] == plain).all()


def test_integer_transform_is_near_the_exact_one():
    blocks = np.random.default_rng(3).integers(-100, 100, (50, 64))
    assert np.abs(pixels.np_idct(blocks) - pixels.np_idct_float(blocks)).max() < 16


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_bitmaps_come_back(width):
    rgb = np.random.default_rng(width).integers(0, 256, (3, width, 3)).astype(np.uint8)
    data = bmp.encode(rgb)
    assert len(data) == 54 + 3 * (width * 3 + width % 4)
    assert (bmp.read(data) == rgb).all()


def test_bitmap_sink(spark, tmp_path):
    bmp.register(spark)
    out = tmp_path / "out"
    decode.decode(table(spark, [image(), b"bad"])).select("path", "width", "height", "rgb").write.format("bmp").mode("append").save(str(out))
    assert [p.name for p in out.glob("*.bmp")] == ["f0-cpu.bmp"]


def test_scores(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 250, (16, 16, 3)).astype(np.uint8)
    pairs = [("same", a, a), ("plus one", a + 1, a), ("noise", rng.integers(0, 256, a.shape).astype(np.uint8), a), ("small", a[:5], a[:5]), ("size", a[:8], a)]
    rows = [(k, x.shape[1], x.shape[0], bytearray(x.tobytes()), y.shape[1], y.shape[0], bytearray(y.tobytes())) for k, x, y in pairs]
    df = spark.createDataFrame(rows, "key string, width int, height int, rgb binary, ref_width int, ref_height int, ref_rgb binary")
    got = {r.key: r for r in quality.score(df).collect()}
    assert got["same"].psnr == float("inf") and got["same"].ssim == pytest.approx(1) and got["same"].corrupted is False
    assert got["plus one"].psnr == pytest.approx(48.1308, abs=1e-4)
    assert got["noise"].corrupted is True
    assert got["small"].reason == "side below 7 pixels" and got["size"].reason == "size mismatch"


def test_blob():
    x = classify.blob(np.full((30, 40, 3), 200, np.uint8))
    assert x.shape == (1, 3, 224, 224)
    assert x[0, :, 0, 0].tolist() == pytest.approx([0.96, 0.83, 0.77], abs=1e-5)


def test_stream(spark, tmp_path):
    from tessera.streaming.decode import start

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(image())
    start(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("error is null").count() == 1


def test_references_of_numbered_files(spark):
    names = spark.createDataFrame([(f"q/{n}",) for n in ("img3-cpu.bmp", "img3x.png", "img30.png", "img5-cpu.bmp", "img50.png")], "path string")
    match = lambda **o: {r.out_path: r.ref_path for r in quality.match_references(quality.outputs(names), names, **o).collect()}
    assert match(numbered=True) == {"q/img3-cpu.bmp": "q/img3x.png", "q/img5-cpu.bmp": None}
    assert match() == {"q/img3-cpu.bmp": "q/img30.png", "q/img5-cpu.bmp": "q/img50.png"}


def shared(spark):
    """Two outputs of one reference, and one of another folder's reference of that name."""
    px = np.random.default_rng(6).integers(0, 250, (16, 16, 3)).astype(np.uint8)
    side = lambda x: (x.shape[1], x.shape[0], bytearray(x.tobytes()))
    rows = [("a.png", f"{f}/a-{kind}.bmp", f"{f}/a.png", *side(x), *side(px)) for f, kind, x in (("d", "cpu", px + 1), ("d", "dpu", px[:8]), ("e", "cpu", px + 2))]
    return spark.createDataFrame(rows, "key string, out_path string, ref_path string, width int, height int, rgb binary, ref_width int, ref_height int, ref_rgb binary")


def test_outputs_that_share_a_reference(spark):
    got = quality.quality_table(shared(spark)).collect()
    assert sorted((r["image"], r["output path"], r["reference path"], r["PSNR"] > 45) for r in got) == [("a.png", "d/a-cpu.bmp", "d/a.png", True), ("a.png", "e/a-cpu.bmp", "e/a.png", False)]


def test_reasons_of_outputs_that_share_a_reference(spark):
    lone = shared(spark).limit(1).selectExpr("null key", "'f/b-cpu.bmp' out_path", "null ref_path", "width", "height", "rgb", "null ref_width", "null ref_height", "null ref_rgb")
    got = [tuple(r) for r in quality.skips(shared(spark).unionByName(lone)).collect()]
    assert sorted(got) == [("d/a-cpu.bmp", None), ("d/a-dpu.bmp", "size mismatch"), ("e/a-cpu.bmp", None), ("f/b-cpu.bmp", "no reference")]
