"""Sources, sinks, pictures, plots, packing and the command line."""

import random
import zlib

import numpy as np
import pytest
from test_images import colour, coefficients, encode, image, table

from tessera import cli
from tessera.functions import jpeg, pixels
from tessera.operators import decode, geometry, manifest
from tessera.sources import bmp, files, images, plot, png, sink


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (3, 4, 3), (1, 1, 3)])
def test_png_comes_back(shape):
    px = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    mode, back = png.read(png.encode(px))
    assert mode == ("RGB" if len(shape) == 3 else "L") and (back == px).all()


def test_png_filters():
    """Rows filtered by the five rules of the format, against a plain loop."""
    rng = np.random.default_rng(4)
    px = rng.integers(0, 256, (10, 6, 3)).astype(int)
    rows, before = [], np.zeros(18, int)
    for y, row in enumerate(px.reshape(10, 18)):
        kind, out = y % 5, []
        for x, v in enumerate(row):
            a, b, c = (row[x - 3] if x > 2 else 0), before[x], (before[x - 3] if x > 2 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        rows.append(bytes([kind, *out]))
        before = row
    raw = png.encode(px.astype(np.uint8))
    at = raw.index(b"IDAT") - 4
    data = png.MAGIC + raw[8:at] + png._chunk(b"IDAT", zlib.compress(b"".join(rows))) + png._chunk(b"IEND", b"")
    assert (png.read(data)[1] == px).all()
    for bad in (b"", data[:40], data.replace(b"IHDR\0\0\0\6", b"IHDR\0\0\0\7")):
        with pytest.raises(ValueError):
            png.read(bad)


def test_pictures(spark):
    rgb = np.random.default_rng(3).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    rows = [("a.bmp", bytearray(bmp.encode(rgb))), ("b.png", bytearray(png.encode(rgb))), ("c.png", bytearray(png.encode(rgb[..., 0]))), ("d.jpg", bytearray(image())), ("e.txt", bytearray(b"x")), ("f", None)]
    got = {r.path: r for r in images.pictures(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert bytes(got["a.bmp"].rgb) == bytes(got["b.png"].rgb) == rgb.tobytes() and got["c.png"].mode == "L" and bytes(got["c.png"].rgb) == rgb[..., 0].tobytes()
    assert (got["d.jpg"].width, got["d.jpg"].mode) == (17, "RGB") and got["e.txt"].error and got["f"].error


def test_sink_keeps_folders_and_overwrites(spark, tmp_path):
    sink.register(spark)
    rows = [("a/x.jpg", bytearray(b"1")), ("b/x.jpg", bytearray(b"2")), ("file:/c/../x.jpg", bytearray(b"3")), ("none", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    out = tmp_path / "out"
    df.write.format("files").mode("append").save(str(out))
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == {"a/x.jpg": b"1", "b/x.jpg": b"2", "c/x.jpg": b"3"}
    df.limit(1).write.format("files").mode("overwrite").save(str(out))
    assert [p.name for p in out.rglob("*") if p.is_file()] == ["x.jpg"]


def test_lists_and_missing_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.jpg").write_bytes(image() if k else b"")
    (tmp_path / "folder").mkdir()
    names = [str(tmp_path / n) for n in ("f3.jpg", "f0.jpg", "folder", "none.jpg", "f1.jpg")]
    (tmp_path / "list.txt").write_text("\t".join(names[:2]) + "\r\n" + "\n".join(names[2:]))
    assert files.existing(spark, names) == [names[0], names[1], names[4]]
    assert sorted(r.path for r in files.missing(spark, names).collect()) == sorted([names[2], names[3]])
    got = files.from_list(spark, str(tmp_path / "list.txt")).orderBy("file_index").collect()
    assert [(r.path.rsplit("/", 1)[1], r.length > 0, r.file_index) for r in got] == [("f0.jpg", False, 0), ("f1.jpg", True, 1), ("f3.jpg", True, 2)]
    assert [r.error for r in files.rejects(files.from_list(spark, str(tmp_path / "list.txt"))).collect()] == ["empty file"]
    assert files.files(spark, [str(tmp_path / "none.jpg")]).count() == 0


def test_numbers_are_those_of_sorted_paths(spark):
    rnd = random.Random(3)
    paths = [f"{rnd.choice('abc')}/{rnd.random()}.jpg" for _ in range(500)]
    got = files.indexed(spark.createDataFrame([(p,) for p in paths], "path string").repartition(7), 16).collect()
    assert {r.path: r.file_index for r in got} == {p: k for k, p in enumerate(sorted(paths))}
    assert files.indexed(spark.createDataFrame([], "path string")).count() == 0


def packed(lengths, slots, per_slot, limit):
    """The serial packer."""
    out, batch, turn, held, filled = [], 0, 0, [0] * slots, [0] * slots
    for index, n in enumerate(lengths):
        if n > limit:
            continue
        if (held[turn] == per_slot or filled[turn] + n >= limit) and any(held):
            batch, turn, held, filled = batch + 1, 0, [0] * slots, [0] * slots
        if n == limit:
            out.append((index, None, None, None, None))
            continue
        out.append((index, batch, turn, held[turn], filled[turn]))
        held[turn] += 1
        filled[turn] += n
        turn = (turn + 1) % slots
    return out


def test_bin_packing(spark):
    rnd = random.Random(6)
    for slots, per_slot, limit in ((1, 1, 50), (4, 3, 100), (7, 100, 60)):
        lengths = [rnd.choice([rnd.randint(0, 40), rnd.randint(30, 120)]) for _ in range(300)]
        df = spark.createDataFrame(list(enumerate(lengths)), "file_index int, length int").repartition(5)
        got = manifest.bin_packing(df, slots, per_slot, limit).orderBy("file_index").collect()
        assert [(r.file_index, r.batch, r.slot, r.place, r.start) for r in got] == packed(lengths, slots, per_slot, limit)
    assert manifest.bin_packing(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (1, 2), (2, 2)])
def test_pieces_and_segments_are_the_whole_scan(sampling):
    for interval in (0, 2):
        comps = colour(*sampling)
        data = encode(50, 40, comps, coefficients(50, 40, comps, seed=9), interval=interval)
        h = jpeg.parse_header(data)
        zz, keys = jpeg.decode_scan(data, h)
        if interval:
            parts = [jpeg.decode_scan(data, h, k) for k in range(len(jpeg.scan_parts(data, h)))]
            assert (np.concatenate([a for a, _ in parts]) == zz).all() and (np.concatenate([b for _, b in parts]) == keys).all()
            continue
        for pieces in (1, 2, 5, 16):
            found, begin = [], 0
            for k in range(pieces):
                blocks, until = jpeg.decode_piece(data, h, k, pieces)
                found += [b for b in blocks if b[0] >= begin]
                begin = max(begin, until)
            assert [b for _, b in sorted(found)][: len(zz)] == zz.tolist()


def test_both_paths_have_one_gate(spark, monkeypatch):
    df = table(spark, [image(64, 64), b""])
    assert decode.headers(df).filter("valid").select("decoded_bytes").first()[0] == 128 * ((8 + 1) * 8 + 8 + 1) * 3
    monkeypatch.setattr(jpeg, "MAX_DECODED", 1000)
    with pytest.raises(jpeg.Invalid, match="decoded size"):
        jpeg.decode_image(image(64, 64))
    with pytest.raises(jpeg.Invalid, match="decoded size"):
        jpeg.gated_header(image(64, 64))


def test_low_accuracy_is_less_accurate():
    blocks = np.random.default_rng(3).integers(-100, 100, (200, 64))
    error = [np.abs(pixels.np_idct(blocks, a) - pixels.np_idct_float(blocks)).mean() for a in ("high", "low")]
    assert error[0] < error[1] < 5


def test_packed_geometry(spark):
    rgb = np.random.default_rng(1).integers(0, 256, (9, 13, 3)).astype(np.uint8)
    df = spark.createDataFrame([(13, 9, bytearray(rgb.tobytes())), (None, None, None)], "width int, height int, rgb binary")
    r = geometry.packed(df, True, 4).filter("rgb is not null").first()
    want = rgb[:8, ::-1][:, :12].astype(int).reshape(2, 4, 3, 4, 3).sum((1, 3)) // 16
    assert (r.width, r.height) == (3, 2) and bytes(r.rgb) == want.astype(np.uint8).tobytes()


def test_plot(spark, tmp_path):
    shares = spark.createDataFrame([(1, 0.25, 0.7, 0.05), (2, 0.0, 0.5, 0.5)], "run int, a double, b double, c double")
    table_ = plot.bars(shares, "run", ["a", "b", "c"])
    assert [(r.x0, r.x1, r.text) for r in table_.filter("run = 1").orderBy("seq").collect()] == [(0, 100, "25.0%"), (100, 380, "70.0%"), (380, 400, None)]
    assert plot.draw(table_, "run", str(tmp_path / "p.png")) == 2
    assert images.read_any((tmp_path / "p.png").read_bytes())[1].shape == (2 * (plot.BAR + plot.GAP) + plot.GAP, 400, 3)


def test_percentages_round_as_printf(spark):
    """All ties of a decimal, and shares around them and far above."""
    values = [k / 2000 for k in range(201, 2001)] + [np.nextafter(k / 2000, to) for k in range(205, 2000, 10) for to in (0, 1)] + [0.99999, 123.45125, 1e7 + 0.0003125, 2e13 / 3, 1.3e16]
    shares = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "run int, a double")
    got = dict(plot.bars(shares, "run", ["a"]).select("run", "text").collect())
    assert [(v, got[k]) for k, v in enumerate(values) if got[k] != "%.1f%%" % (v * 100)] == []


def test_command_line(spark, tmp_path):
    names = []
    for k in range(4):
        names.append(str(tmp_path / f"f{k}.jpg"))
        (tmp_path / f"f{k}.jpg").write_bytes(image(33, 21) if k != 2 else b"broken")
    out = tmp_path / "out"
    lines = cli.run(spark, cli.options([*names, str(tmp_path / "none.jpg"), "-o", str(out), "-f", "-s", "2", "-r", "2"]))
    assert lines[-5:-1] == ["Number of files: 4", "Failed: 1", "Blocks: 135", "Pixels: 2079"] and "f2.jpg" in lines[0]
    written = sorted(out.rglob("*.bmp"))
    assert [p.name for p in written] == ["f0-cpu.bmp", "f1-cpu.bmp", "f3-cpu.bmp"]
    whole = jpeg.decode_image(image(33, 21))[1]
    half = whole[:20, ::-1][:, :32].astype(int).reshape(10, 2, 16, 2, 3).sum((1, 3)) // 4
    assert (bmp.read(written[0].read_bytes()) == half).all()
    (tmp_path / "list").write_text("\n".join(names))
    assert cli.run(spark, cli.options(["-l", str(tmp_path / "list"), "-m", "1"]))[0] == "Number of files: 1"
    assert "Number of files: 6" in cli.run(spark, cli.options([names[0], names[1], "-S", "-m", "6"]))
    assert cli.run(spark, cli.options([names[0], "-d"])) == [f"0: {' '.join(str(int(whole[..., c].sum())) for c in range(3))}"]
    assert "Failed: 0" in cli.run(spark, cli.options([names[0], "-w", "10", "-o", str(tmp_path / "small")]))
    with pytest.raises(SystemExit):
        cli.options(["-S"])
