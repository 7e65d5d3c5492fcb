"""Image functions against plain loops, and files in and out."""

import math
import zlib

import numpy as np
import pytest

from sightline.functions import imaging as I
from sightline.sources import codecs
from sightline.sources import images as SI
from sightline.sources import records

RNG = np.random.default_rng(7)
IMAGES = [RNG.integers(0, 256, s, dtype=np.uint8) for s in ((3, 3), (4, 7), (32, 20), (16, 16))] + [np.full((5, 5), 9, np.uint8), np.tile(np.array([0, 255], np.uint8), (6, 4))]


def test_resize():
    for image in IMAGES:
        h, w = image.shape
        for nw, nh in ((1, 1), (w, h), (5, 9), (2 * w, 3)):
            got = I.resize_bilinear(image, nw, nh)
            for y in range(nh):
                for x in range(nw):
                    sy, sx = min(y * h / nh, h - 1), min(x * w / nw, w - 1)
                    y0, x0 = int(sy), int(sx)
                    y1, x1, dy, dx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - y0, sx - x0
                    v = (image[y0, x0] * (1 - dx) + image[y0, x1] * dx) * (1 - dy) + (image[y1, x0] * (1 - dx) + image[y1, x1] * dx) * dy
                    assert abs(int(got[y, x]) - v) <= 0.5 + 1e-9
    rgb = RNG.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert all(np.array_equal(I.resize_bilinear(rgb, 7, 4)[..., c], I.resize_bilinear(rgb[..., c], 7, 4)) for c in range(3))


def test_sums_and_statistics():
    for image in IMAGES:
        table, squares = I.integral(image), I.integral(image.astype(np.int64) ** 2)
        h, w = image.shape
        for x, y, bw, bh in ((0, 0, w, h), (-2, -1, 3, 3), (1, 1, 99, 99), (w, h, 2, 2), (1, 1, 0, 2), (2, 1, 1, 1)):
            x0, y0 = max(x, 0), max(y, 0)
            part = image[y0 : y0 + bh, x0 : x0 + bw].astype(np.int64) if bw > 0 and bh > 0 else np.zeros((0, 0), np.int64)
            assert I.box_sum(table, x, y, bw, bh) == part.sum()
            mean, dev = I.window_stats(table, squares, x, y, bw, bh)
            if bw * bh:
                assert mean == pytest.approx(part.sum() / (bw * bh))
                assert dev == pytest.approx(math.sqrt(max((part**2).sum() / (bw * bh) - (part.sum() / (bw * bh)) ** 2, 0)))
            else:
                assert (mean, dev) == (0, 0)
    assert I.laplacian_variance(np.zeros((2, 9), np.uint8)) == 0 and I.laplacian_variance(IMAGES[4]) == 0
    assert abs(I.standardise(IMAGES[2]).mean()) < 1e-9 and np.all(I.standardise(IMAGES[4]) == 0)


def test_texture():
    for image in IMAGES:
        codes = I.texture_codes(image)
        h, w = image.shape
        for y in range(h):
            for x in range(w):
                want = 0
                if 0 < x < w - 1 and 0 < y < h - 1:
                    for k in range(8):
                        a = 2 * math.pi * k / 8
                        want |= int(image[round(y - math.sin(a)), round(x - math.cos(a))] >= image[y, x]) << k
                assert codes[y, x] == want
    d = I.texture_descriptor(I.preprocess(IMAGES[2]), I.FACE_W, I.FACE_H)
    assert d.shape == (16384,) and np.allclose(d.reshape(64, 256).sum(axis=1), 1)
    t = I.tracker_descriptor(IMAGES[2], (-3, 4, 15, 40))
    assert t.shape == (16384,) and np.allclose(t.reshape(64, 256).sum(axis=1), 1)


def test_gradients():
    image = RNG.integers(0, 256, (64, 64), dtype=np.uint8)
    cells = np.zeros((8, 8, 9))
    v = image.astype(float)
    for y in range(64):
        for x in range(64):
            gx = v[y, min(x + 1, 63)] - v[y, max(x - 1, 0)]
            gy = v[min(y + 1, 63), x] - v[max(y - 1, 0), x]
            a = math.atan2(gy, gx)
            a += math.pi if a < 0 else 0
            p = a / math.pi * 9
            b = math.floor(p)
            cells[y // 8, x // 8, b % 9] += math.hypot(gx, gy) * (1 - (p - b))
            cells[y // 8, x // 8, (b % 9 + 1) % 9] += math.hypot(gx, gy) * (p - b)
    assert np.allclose(I.gradient_cells(image), cells)
    d = I.gradient_descriptor(image)
    assert d.shape == (1764,) and np.allclose(np.linalg.norm(d.reshape(49, 36), axis=1), 1, atol=1e-3)
    assert I.gradient_of_box(image, (70, 70, 4, 4)).shape == (1764,) and not I.gradient_of_box(image, (70, 70, 4, 4)).any()


def test_alignment():
    image = RNG.integers(0, 256, (50, 60), dtype=np.uint8)
    box = (10, 8, 24, 30)
    got = I.align(image, box, I.landmarks(box), 20, 25)
    (lx, ly), (rx, _) = I.landmarks(box)[:2]
    scale = 20 * 0.35 / (rx - lx)
    for y in range(25):
        for x in range(20):
            sx = math.floor((x - 10) / scale + (lx + rx) / 2 + 0.5)
            sy = math.floor((y - 10) / scale + ly + 0.5)
            want = image[sy, sx] if 0 <= sx < 60 and 0 <= sy < 50 else 0
            assert got[y, x] == want
    drawn = I.draw_box(image, (5, 5, 10, 8), 1)
    assert (drawn[5, 5:15] == sum(I.PALETTE[1]) // 3).all() and np.array_equal(drawn[6:12, 6:14], image[6:12, 6:14])


def test_text():
    blank = np.zeros((9, 12), np.uint8)
    one = I.draw_text(blank, 1, 2, "1")
    assert ["".join(".#"[int(v > 0)] for v in row[1:4]) for row in one[2:7]] == [".#.", "##.", ".#.", ".#.", "###"]
    assert len({I.draw_text(blank, 0, 0, c).tobytes() for c in I.GLYPHS}) == len(I.GLYPHS)
    assert np.array_equal(I.draw_text(blank, 0, 0, "a"), I.draw_text(blank, 0, 0, "A")) and not I.draw_text(blank, 0, 0, "?").any()
    assert I.draw_text(blank, -2, 7, "888888").shape == blank.shape


def test_codecs():
    for image in IMAGES:
        assert np.array_equal(codecs.read_pgm(codecs.write_pgm(image)), image)
        assert np.array_equal(codecs.read_png_stored(codecs.write_png(image)), image)
    rgb = RNG.integers(0, 256, (200, 301, 3), dtype=np.uint8)
    assert np.array_equal(codecs.read_ppm(codecs.write_ppm(rgb)), rgb) and np.array_equal(codecs.read_png_stored(codecs.write_png(rgb)), rgb)
    assert np.array_equal(codecs.read_pgm(b"P5 # c\n# d 9\n2\t1\n255\n\x01\x02extra"), [[1, 2]])
    for bad in (b"P5 2 2 255\n\x01", b"P5 1 1 256\n\x01\x01", b"P4 1 1 1\n\x01", b"P5 x", b""):
        with pytest.raises(codecs.BadImage):
            codecs.read_pgm(bad)
    png = codecs.write_png(IMAGES[0])
    assert int.from_bytes(png[29:33], "big") == zlib.crc32(png[12:29])


def test_folders(spark, tmp_path):
    frames = tmp_path / "frames"
    frames.mkdir()
    for k in range(3):
        (frames / f"frame_{k + 1:06d}.pgm").write_bytes(codecs.write_pgm(IMAGES[2]))
    (frames / "broken_000009.pgm").write_bytes(b"P5 9 9 255\n")
    (frames / "notes.txt").write_text("x")
    got = {r.idx: r for r in SI.read_frames(spark, str(frames), fps=2.0).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1].problem and got[1].frame_idx == 9
    assert got[3].frame_idx == 2 and got[3].ts == 0.5 and bytes(got[3].data) == IMAGES[2].tobytes()
    people = tmp_path / "people"
    for name, n in (("ann", 2), ("bob", 1)):
        (people / name).mkdir(parents=True)
        for k in range(n):
            (people / name / f"{k}.pgm").write_bytes(codecs.write_pgm(IMAGES[3]))
    (people / "cat_1.ppm").write_bytes(codecs.write_ppm(RNG.integers(0, 256, (8, 8, 3), dtype=np.uint8)))
    rows = SI.read_labelled(spark, str(people), (10, 12)).collect()
    assert sorted((r.name, r.label, r.width, r.height) for r in rows) == [("ann", 0, 10, 12)] * 2 + [("bob", 1, 10, 12), ("cat", 2, 10, 12)]
    SI.write_files(SI.encoded(SI.read_labelled(spark, str(people)).where("channels = 1"), {"name": "string"}, "pgm").dropDuplicates(["name"]), str(tmp_path / "out"))
    assert codecs.read_pgm((tmp_path / "out" / "bob").read_bytes()).shape == (112, 92)


def test_records(spark, tmp_path):
    schema = "index bigint, ts double, frame_idx bigint, file_name string, boxes array<struct<x:int,y:int,w:int,h:int>>, face_ids array<int>"
    rows = [(2, 1.5, 3, "b.png", [(1, 2, 3, 4), (-5, 6, 7, 8)], [0, 4]), (1, 0.0, 1, "a.png", [], [])]
    records.write_manifest(spark.createDataFrame(rows, schema), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text.splitlines()[0].startswith("#") and text.splitlines()[2].split("\t")[:1] == ["1"]
    got = {r["index"]: r for r in records.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert [tuple(b) for b in got[2].boxes] == [(1, 2, 3, 4), (-5, 6, 7, 8)] and got[2].face_ids == [0, 4] and got[1].boxes == [] and got[1].face_ids == []
    t = "face_id bigint, first_ts double, last_ts double, frame_count bigint, name string, box struct<x:int,y:int,w:int,h:int>, gallery array<double>, frames array<struct<file_index:bigint,timestamp_secs:double,box:array<int>>>"
    tracks = spark.createDataFrame([(0, 0.0, 2.0, 2, None, (1, 2, 3, 4), [0.5], [(1, 0.0, [1, 2, 3, 4])]), (1, 1.0, 1.0, 1, 'q"u', (5, 6, 7, 8), [0.25], [])], t)
    records.write_tracks(tracks, str(tmp_path / "t"))
    back = {r.face_id: r for r in records.read_track_lines(spark, str(tmp_path / "t")).collect()}
    assert back[0].name is None and back[1].name == 'q"u' and back[0].sample_box == [1, 2, 3, 4] and back[0].duration_secs == 2 and back[0].frames[0].box == [1, 2, 3, 4]
    (tmp_path / "whole.json").write_text('{"summary": {"total_unique_faces": 1},\n "tracks": [{"face_id": 3, "frames": []}, {"face_id": 4, "name": "n"}]}')
    assert [(r.face_id, r.name) for r in records.read_tracks(spark, str(tmp_path / "whole.json")).orderBy("face_id").collect()] == [(3, None), (4, "n")]
    lines = spark.createDataFrame([(k, v) for k, v in enumerate(["1: Ann", "# 2: no", "", "2 = Bob: x", "1: Ann B", "x: y"])], "line_no int, value string")
    assert {r.face_id: r.name for r in records.parse_labels(lines).collect()} == {1: "Ann B", 2: "Bob: x"}


def test_videos_without_a_decoder(spark, tmp_path):
    import shutil

    from sightline.sources.video import read_videos

    (tmp_path / "a.mp4").write_bytes(b"not a video")
    rows = read_videos(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].problem
    if shutil.which("ffmpeg") is None:
        assert rows[0].problem == "ffmpeg is not installed"


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from sightline.scratch import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: d)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
    found = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "s3a://b/c/"), sparkContext=context)
    assert shared_dir(found) == "s3a://b/c"


def test_scratch_tables_go_when_cleared(spark):
    from sightline import scratch

    df = scratch.written(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    import os

    assert df.count() == 5 and os.path.isdir(path)
    scratch.clear(spark)
    assert not os.path.exists(path)
    assert scratch.written(spark.range(3)).count() == 3
