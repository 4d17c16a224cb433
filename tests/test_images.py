"""PNG decoding and resampling against plain loops, and as plans with damaged rows."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from panelwright.functions import raster as R
from panelwright.settings import Settings
from panelwright.sources import images as I


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows, step, kinds):
    """Lines of bytes with their filters, byte by byte."""
    out, above = b"", [0] * len(rows[0])
    for row, kind in zip(rows, kinds):
        line = []
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, near][kind]) % 256)
        out += bytes([kind, *line])
        above = row
    return out


def packed_rows(samples, depth):
    """Samples (rows of pixels of channels) as lines of bytes of the given depth."""
    lines = []
    for row in samples:
        bits = "".join(f"{v:0{depth}b}" for pixel in row for v in pixel)
        bits += "0" * (-len(bits) % 8)
        lines.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
    return lines


def png(samples, depth, colour, kinds, palette=b"", interlaced=False, extra=b""):
    height, width, channels = len(samples), len(samples[0]), len(samples[0][0])
    step = max(1, channels * depth // 8)
    data = b""
    for x, y, dx, dy in R.ADAM7 if interlaced else [(0, 0, 1, 1)]:
        part = [row[x::dx] for row in samples[y::dy]]
        if part and part[0]:
            lines = packed_rows(part, depth)
            data += filtered(lines, step, [kinds[i % len(kinds)] for i in range(len(lines))])
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    half = zlib.compress(data)
    cut = len(half) // 2
    return R.PNG + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + extra + chunk(b"IDAT", half[:cut]) + chunk(b"IDAT", half[cut:]) + chunk(b"IEND", b"")


def rgb_of(samples, depth, colour, palette):
    def one(p):
        if colour == 3:
            return tuple(palette[3 * p[0] : 3 * p[0] + 3]) if 3 * p[0] < len(palette) else (0, 0, 0)
        v = [x >> 8 for x in p] if depth == 16 else [x * 255 // ((1 << depth) - 1) for x in p] if depth < 8 else p
        return (v[0],) * 3 if len(v) < 3 else tuple(v[:3])

    return [[one(p) for p in row] for row in samples]


@pytest.mark.parametrize("colour,depth", [(c, d) for c, depths in R.DEPTHS.items() for d in depths])
@pytest.mark.parametrize("interlaced", [False, True])
def test_decodes_every_kind_of_png(colour, depth, interlaced):
    rng = random.Random(colour * 100 + depth)
    for width, height in ((1, 1), (7, 5), (13, 11), (3, 20)):
        palette = bytes(rng.randrange(256) for _ in range(3 * min(1 << depth, 200))) if colour == 3 else b""
        samples = [[[rng.randrange(1 << depth) for _ in range(R.CHANNELS[colour])] for _ in range(width)] for _ in range(height)]
        for kinds in ([0, 1, 2, 3, 4], [4], [1, 2, 0]):
            made = png(samples, depth, colour, kinds, palette, interlaced, extra=chunk(b"tEXt", b"a\0b"))
            assert R.decode_png(made).tolist() == [list(map(list, row)) for row in rgb_of(samples, depth, colour, palette)]


def test_encoder_and_decoder_agree():
    rng = np.random.default_rng(3)
    for colour, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        samples = rng.integers(0, 256, (17, 9, channels)).astype(np.uint8)
        got = R.decode_png(R.encode_png(samples, colour, np.arange(17) % 5))
        assert (got == (samples[:, :, :3] if channels > 2 else samples[:, :, :1])).all()


def plain_resize(rows, width, height):
    """Bilinear with a window that grows with the reduction; weights of 22 bits, bytes after each direction."""

    def line(values, out):
        size = len(values)
        scale = size / out
        wide = max(scale, 1.0)
        found = []
        for o in range(out):
            centre = (o + 0.5) * scale
            lo, hi = max(int(centre - wide + 0.5), 0), min(int(centre + wide + 0.5), size)
            w = [max(0.0, 1.0 - abs((i - centre + 0.5) * (1.0 / wide))) for i in range(lo, hi)]
            total = 0.0
            for x in w:
                total += x
            k = [int(0.5 + x * (1.0 / total) * 2**22) for x in w]
            found.append([min(255, max(0, (2**21 + sum(a * values[lo + i][c] for i, a in enumerate(k))) >> 22)) for c in range(3)])
        return found

    rows = [line(row, width) for row in rows] if width != len(rows[0]) else rows
    if height != len(rows):
        columns = [line(list(column), height) for column in zip(*rows)]
        rows = [list(row) for row in zip(*columns)]
    return rows


def noise(width, height, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


@pytest.mark.parametrize("old,new", [((10, 7), (3, 5)), ((5, 5), (12, 9)), ((33, 8), (10, 8)), ((9, 40), (9, 6)), ((1, 1), (4, 3)), ((64, 48), (1, 1))])
def test_resampling_equals_plain_loops(old, new):
    pixels = noise(*old)
    assert R.resized(pixels, *new).tolist() == plain_resize(pixels.tolist(), *new)


def test_letterbox_and_crop():
    for width, height in ((55, 71), (71, 83), (83, 55), (30, 30), (40, 90), (200, 50)):
        pixels = noise(width, height)
        box = R.letterboxed(pixels, 64)
        ratio = width / height
        w, h = (64, int(64 / ratio)) if ratio > 1 else (int(64 * ratio), 64)
        x, y = (64 - w) // 2, (64 - h) // 2
        assert box[y : y + h, x : x + w].tolist() == plain_resize(pixels.tolist(), w, h)
        inside = np.zeros((64, 64), bool)
        inside[y : y + h, x : x + w] = True
        assert (box[~inside] == 114).all()
        crop = R.center_cropped(pixels, 24)
        ratio = 24 / min(width, height)
        w, h = int(width * ratio), int(height * ratio)
        x, y = (w - 24) // 2, (h - 24) // 2
        small = plain_resize(pixels.tolist(), w, h)
        want = [[small[r][c] if 0 <= r < h and 0 <= c < w else [0, 0, 0] for c in range(x, x + 24)] for r in range(y, y + 24)]
        assert crop.tolist() == want


@pytest.mark.parametrize("side", [55, 71, 83])
def test_sides_that_come_out_a_pixel_short(side):
    """At the classifier's size these sides scale to 223: the crop begins one pixel outside, which is black."""
    crop = R.center_cropped(np.full((side, side, 3), 200, np.uint8), 224)
    assert math.floor(side * (224 / side)) == 223
    assert (crop[0] == 0).all() and (crop[:, 0] == 0).all() and (crop[1:, 1:] == 200).all()


def broken():
    good = R.encode_png(noise(20, 10), 2, np.arange(10) % 5)
    at = good.index(b"IDAT")
    head = good.index(b"IHDR") + 4
    bomb = bytearray(good)
    bomb[head : head + 8] = struct.pack(">II", 1 << 20, 1 << 20)
    bomb[head + 13 : head + 17] = struct.pack(">I", zlib.crc32(b"IHDR" + bytes(bomb[head : head + 13])))
    short = R.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 50, 50, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 40)) + chunk(b"IEND", b"")
    junk = R.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"no zlib data") + chunk(b"IEND", b"")
    odd = R.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x09abc")) + chunk(b"IEND", b"")
    kind = R.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 3, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0abc")) + chunk(b"IEND", b"")
    bare = R.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 3, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0a")) + chunk(b"IEND", b"")
    return [
        (None, I.NO_IMAGE), (b"", I.EMPTY_IMAGE), (b"not_an_image_at_all", "cannot identify image file"), (good[:60], "image file is truncated"),
        (good[: at + 9] + bytes([good[at + 9] ^ 1]) + good[at + 10 :], "broken chunk"), (bytes(bomb), "too many pixels"), (short, "image file is truncated"),
        (junk, "damaged samples"), (odd, "unknown filter"), (kind, "unknown kind of image"), (bare, "image without palette"), (R.PNG, "image file is truncated"),
    ]


def test_bad_images_are_rows(spark):
    good = R.encode_png(noise(20, 10), 2, np.arange(10) % 5)
    cases = broken()
    rows = [(i, c, "kept") for i, (c, _) in enumerate(cases)] + [(100, good, "kept"), (101, R.encode_png(noise(700, 1), 2, np.zeros(1, int)), "kept")]
    df = spark.createDataFrame(rows, "id int, content binary, ok string").repartition(3)
    found = {r.id: r for r in I.prepared(df, "pixels", "detector", "classifier", s=Settings(detector_size=32, classifier_size=8)).collect()}
    for i, (_, why) in enumerate(cases):
        want = why if why in (I.NO_IMAGE, I.EMPTY_IMAGE) else why.join(I.BAD_IMAGE)
        assert tuple(found[i].image) == (False, want, None, None, None, None, None) and found[i].ok == "kept"
    image = found[100].image
    assert (image.ok, image.error, image.width, image.height) == (True, None, 20, 10)
    assert bytes(image.pixels) == noise(20, 10).tobytes()
    assert bytes(image.detector) == R.letterboxed(noise(20, 10), 32).tobytes() and bytes(image.classifier) == R.center_cropped(noise(20, 10), 8).tobytes()
    narrow = found[101].image
    assert (narrow.ok, narrow.error, narrow.width, narrow.height, narrow.detector) == (False, "height and width must be > 0", 700, 1, None)


def test_many_pixels_leave_a_task_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(I, "FLUSH_BYTES", 1000)
    rows = [(i, R.encode_png(noise(10, 10, i), 2, np.zeros(10, int))) for i in range(30)]
    got = I.prepared(spark.createDataFrame(rows, "id int, content binary").coalesce(1), "pixels").collect()
    assert {r.id: bytes(r.image.pixels) for r in got} == {i: noise(10, 10, i).tobytes() for i in range(30)}
    assert I.prepared(spark.createDataFrame([], "content binary")).count() == 0
    with pytest.raises(ValueError, match="no such parts"):
        I.prepared(spark.createDataFrame(rows, "id int, content binary"), "tensor")


def test_image_files_are_scanned(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.png").write_bytes(R.encode_png(noise(6, 4), 2, np.zeros(4, int)))
    (tmp_path / "in" / "b.png").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_text("no image")
    df = I.image_files(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r for r in I.prepared(df.withColumn("size", I.png_size()), "pixels").collect()}
    assert set(found) == {"a.png", "b.png"} and found["b.png"].size is None and not found["b.png"].image.ok
    assert tuple(found["a.png"].size) == (6, 4) and bytes(found["a.png"].image.pixels) == noise(6, 4).tobytes()


def test_production_inputs_of_the_table(spark, sf_dir):
    """The detector's and the classifier's squares at their real sizes, for some rows against plain loops."""
    import hashlib

    from panelwright.plans.queries import QUERIES
    from panelwright.sources import adapters

    rows = {r.run_id: r for r in QUERIES["image_inputs"](spark, sf_dir).collect()}
    table = adapters.images(spark, sf_dir)
    assert len(rows) == table.count()
    checked = 0
    for r in table.where("run_id % 41 = 7").collect():
        if rows[r.run_id].error:
            continue
        pixels = R.decode_png(bytes(r.content))
        box = R.letterboxed(pixels, 640)
        h, w = pixels.shape[:2]
        new_w, new_h = (640, int(640 / (w / h))) if w / h > 1 else (int(640 * (w / h)), 640)
        x, y = (640 - new_w) // 2, (640 - new_h) // 2
        if checked < 1:
            assert box[y : y + new_h, x : x + new_w].tolist() == plain_resize(pixels.tolist(), new_w, new_h)
        assert rows[r.run_id].detector_md5 == hashlib.md5(box.tobytes()).hexdigest()
        assert rows[r.run_id].classifier_md5 == hashlib.md5(R.center_cropped(pixels, 224).tobytes()).hexdigest()
        checked += 1
    assert checked


def test_batches_of_images_are_bounded_by_bytes(spark):
    """A task holds a batch of samples at once: its size follows BATCH_BYTES, not the rows of the task."""
    from panelwright.sources import images as source

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    made = spark.range(600, numPartitions=1).selectExpr(
        "id", "20000 AS width", "1 AS height", "0 AS colour", "CAST(null AS binary) AS palette", "0 AS first_filter", "transform(sequence(1, 20000), i -> cast(i % 2 as int)) AS samples"
    )
    done = source.encoded(made)
    assert "samples" not in done.columns
    sizes = [r.n for r in made.mapInArrow(counted, "n long").collect()]
    assert sum(sizes) == 600 and max(sizes) * 80_000 <= 2 * source.BATCH_BYTES
