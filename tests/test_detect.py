"""Detectors, tracker, merging, models and whole runs against plain loops on synthetic scenes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline import pipeline
from sightline.functions import boxes as B
from sightline.functions import imaging as I
from sightline.operators import boxes as OB
from sightline.operators import detect as D
from sightline.operators import frames as FR
from sightline.operators import models as M
from sightline.operators import tracks as T
from sightline.options import Benchmark, Run, algorithms
from sightline.plans import learning as M_queries
from sightline.plans.learning import DEMO
from sightline.sources import cascades, codecs, records, reports
from sightline.sources import images as SI

XML = """<?xml version="1.0"?><!-- made for tests --><opencv_storage><cascade type_id="x"><height>12</height><width>12</width>
<stages><_><maxWeakCount>1</maxWeakCount><stageThreshold>5.0e-01</stageThreshold><weakClassifiers>
<_><internalNodes>0 -1 0 6.0e-01</internalNodes><leafValues>0. 1.</leafValues></_></weakClassifiers></_>
<_><stageThreshold>0.5</stageThreshold><weakClassifiers><_><internalNodes>0 -1 1 0.4</internalNodes><leafValues>1. 0.</leafValues></_></weakClassifiers></_></stages>
<features><_><rects><_>0 0 12 12 -1.</_><_>3 3 6 6 4.</_></rects></_><_><rects><_>0 0 12 6 -1.</_><_>0 6 12 6 1.</_></rects></_></features></cascade></opencv_storage>"""


def scene(left, top, side=8, w=48, h=40):
    y, x = np.mgrid[0:h, 0:w]
    image = 40 + (x * 3 + y * 5) % 23
    image[top : top + side, left : left + side] = 220
    return image.astype(np.uint8)


def test_cascade_files(tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    found = cascades.read_cascade(str(tmp_path / "c.xml"))
    assert found.window == DEMO.window and found.stages == DEMO.stages and all(np.array_equal(a, b) for a, b in zip(found.features, DEMO.features))
    stage = XML[XML.index("<_><maxWeakCount>") : XML.index("</stages>")]
    for bad in (
        XML.replace(stage, ""),
        XML.replace("<_><internalNodes>0 -1 1 0.4</internalNodes><leafValues>1. 0.</leafValues></_>", ""),
        XML.replace("</rects></_></features>", "</rects><tilted>1</tilted></_></features>"),
        XML.replace("<rects><_>0 0 12 12 -1.</_><_>3 3 6 6 4.</_></rects>", "<rects/>"),
        XML.replace("0 -1 1 0.4", "0 -1 7 0.4"),
        "<opencv_storage/>",
    ):
        with pytest.raises(cascades.BadCascade):
            cascades.parse_cascade(bad)


@pytest.mark.parametrize("how", [(12, 24, 1.25, 1), (10, 40, 1.1, 3)])
def test_scan_is_the_plain_loop(how):
    low, high, factor, step = how
    image = scene(20, 15)
    got, scores = D.scan(DEMO, image, low, high, factor, step)
    want, scale = [], 1.0
    v = image.astype(float)
    while 12 * scale <= 48 and 12 * scale <= 40:
        size = int(12 * scale)
        if size > high:
            break
        stride = max(int(step * scale), 1)
        for y in range(0, 40 - size + 1, stride) if size >= low else ():
            for x in range(0, 48 - size + 1, stride):
                dev = max(v[y : y + size, x : x + size].std(), 1.0)
                ok = True
                for threshold, weak in DEMO.stages:
                    total = 0.0
                    for p in weak:
                        f = 0.0
                        for rx, ry, rw, rh, weight in DEMO.features[p.feature]:
                            x0, y0 = x + int(rx * scale), y + int(ry * scale)
                            f += weight * v[y0 : y0 + int(rh * scale), x0 : x0 + int(rw * scale)].sum()
                        total += p.low if f / size**2 < p.threshold * dev else p.high
                    ok = ok and total >= threshold
                if ok:
                    want.append((x, y, size, size))
        scale *= factor
    assert sorted(map(tuple, got.tolist())) == sorted(want) and want and len(scores) == len(want)


def test_faces_find_the_square():
    for left, top in ((10, 8), (30, 20)):
        found = D.faces(scene(left, top), DEMO, D.Options(min_size=12, max_size=20, step=1, min_neighbors=2, flip=True))
        assert len(found) >= 1
        assert OB.iou_matrix(found, np.array([[left - 2, top - 2, 12, 12]])).max() > 0.4
    assert len(D.faces(np.full((40, 48), 90, np.uint8), DEMO, D.Options(min_size=12, max_size=20, step=1))) == 0
    assert D.Options().stride == 4 and D.Options(step=2).stride == 2 and D.Options.high_recall().stride == 2 and D.Options.high_recall().min_size == 20


def test_gradient_detector():
    rng = np.random.default_rng(3)

    def disc(noise):
        y, x = np.mgrid[0:64, 0:64]
        return np.clip(np.where((x - 32) ** 2 + (y - 32) ** 2 < 400, 200, 40) + rng.normal(0, noise, (64, 64)), 0, 255).astype(np.uint8)

    def bars(noise):
        x = np.mgrid[0:64, 0:64][1]
        return np.clip(np.where(x // 8 % 2, 200, 40) + rng.normal(0, noise, (64, 64)), 0, 255).astype(np.uint8)

    margin = D.train_gradients([disc(8) for _ in range(8)], [bars(8) for _ in range(8)], iterations=60)
    image = np.full((96, 112), 40, np.uint8)
    image[20:84, 30:94] = disc(2)
    boxes, scores = D.scan_gradients(margin, image, 64, 64, 1.2, 2, 0.5)
    best = boxes[np.argmax(scores)]
    assert abs(best[0] - 30) <= 8 and abs(best[1] - 20) <= 8
    # window by window, with a descriptor each
    want = []
    for y in range(0, 33, 2):
        for x in range(0, 49, 2):
            score = float(margin.score(I.gradient_descriptor(image[y : y + 64, x : x + 64])[None, :])[0])
            if score >= 0.5:
                want.append((x, y, 64, 64, round(score, 9)))
    assert [(*map(int, b), round(float(v), 9)) for b, v in zip(boxes, scores)] == want
    merged = D.faces(image, DEMO, D.Options(min_size=12, max_size=64, step=4, margin_threshold=0.5), margin)
    assert len(merged)


def test_gradient_query(spark):
    margin = M_queries.demo_margin()
    got = M_queries.detect_gradients(spark, "/root/testdata/sf0.001").where("img < 4").collect()
    images = {r.img: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in M_queries.scenes(spark, "/root/testdata/sf0.001").where("img < 4").collect()}
    assert got and images
    for key, image in images.items():
        want, size = [], 64.0  # windows of 64 at least: the image isn't enlarged
        scale = 64 / size
        small = I.resize_bilinear(image, 64, 64)
        score = float(margin.score(I.gradient_descriptor(small)[None, :])[0])
        if score >= 0:
            want.append((0, 0, 64, 64, round(score, 4)))
        assert scale == 1 and [tuple(r)[1:] for r in got if r.img == key and r.w == 64] == want


def test_grouping_forms_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), k, tuple(int(v) for v in (*rng.integers(0, 60, 2), *rng.integers(1, 40, 2)))) for i in range(12) for k in range(int(rng.integers(1, 9)))]
    rows += [(50, k, b) for k, b in enumerate([(0, 0, 10, 10), (0, 0, 10, 10), (0, 0, 0, 0), (3, 3, 2, 2), (10, 0, 5, 5)])]
    df = spark.createDataFrame(rows, f"image int, id int, box {B.BOX}")
    for least in (1, 2, 3):
        got = sorted((r.image, tuple(r.box)) for r in OB.group_boxes(df, "image", "id", "box", least).collect())
        want = sorted((i, tuple(map(int, b))) for i in {r[0] for r in rows} for b in OB.group_boxes_local(np.array([r[2] for r in rows if r[0] == i]), least))
        assert got == want
        assert sorted((r.image, tuple(r.box)) for r in OB.group_boxes_joined(df, "image", "id", "box", least).collect()) == want


def test_suppression():
    boxes = np.array([(0, 0, 10, 10), (1, 1, 10, 10), (20, 20, 5, 5), (0, 0, 10, 10)])
    assert OB.suppressed(boxes, np.array([0.5, 0.9, 0.1, 0.9]), 0.3).tolist() == [1, 2]
    assert OB.suppressed(np.zeros((0, 4), int), np.zeros(0), 0.3).tolist() == []


def plain_tracker(rows, threshold):
    """rows in order: box, descriptor; ids"""
    tracks, out = [], []
    for (x, y, w, h), d in rows:
        cx, cy, best, at = x + w // 2, y + h // 2, math.inf, None
        for k, (last, g) in enumerate(tracks):
            if abs(last[0] - cx) > 100 or abs(last[1] - cy) > 100:
                continue
            na, nb = math.sqrt(sum(v * v for v in g)), math.sqrt(sum(v * v for v in d))
            s = 1.0 if na == 0 or nb == 0 else 1 - max(-1, min(1, sum(a * b for a, b in zip(g, d)) / (na * nb)))
            if s < best:
                best, at = s, k
        if at is not None and best < threshold:
            tracks[at] = ((cx, cy), [0.8 * a + 0.2 * b for a, b in zip(tracks[at][1], d)])
        else:
            at = len(tracks)
            tracks.append(((cx, cy), list(d)))
        out.append(at)
    return out


def detections(seed, videos=4, n=120):
    rng = np.random.default_rng(seed)
    kinds = rng.random((5, 6))
    rows = []
    for v in range(videos):
        for k in range(n):
            for pos in range(int(rng.integers(1, 3))):
                kind = int(rng.integers(0, 5))
                d = np.zeros(6) if rng.random() < 0.03 else kinds[kind] + rng.normal(0, 0.05, 6)
                rows.append((v, k, pos, (int(kind * 60 + rng.integers(0, 30)), int(rng.integers(0, 200)), 40, int(rng.integers(30, 50))), [float(x) for x in d]))
    return rows


DET = f"video bigint, idx bigint, pos int, box {B.BOX}, descriptor array<double>"


def test_tracker(spark):
    rows = detections(1)
    got = {(r.video, r.idx, r.pos): r.face_id for r in T.track(spark.createDataFrame(rows, DET).repartition(5), 0.05).collect()}
    for v in range(4):
        own = sorted((r for r in rows if r[0] == v), key=lambda r: (r[1], r[2]))
        assert [got[r[:3]] for r in own] == plain_tracker([(r[3], r[4]) for r in own], 0.05)
    assert len(set(got.values())) > 3 and T.track(spark.createDataFrame([], DET)).count() == 0


def test_packed_descriptors_give_the_same_tracks(spark):
    how = D.Options(min_size=12, max_size=24, step=1, min_neighbors=2)
    tracked = []
    for packed in (False, True):
        found = D.detect(M_queries.scenes(spark, "/root/testdata/sf0.001"), DEMO, how, ["img"], "img bigint", packed=packed)
        box = B.box("x", "y", "w", "h").alias("box")
        rows = found.select(F.floor(F.col("img") / 25).alias("video"), F.col("img").alias("idx"), "pos", box, "descriptor").cache()
        size = F.length("descriptor") if packed else 8 * F.size("descriptor")
        tracked.append((sorted(map(tuple, T.track(rows).collect()), key=lambda r: r[:3]), rows.agg(F.sum(size)).first()[0]))
        rows.unpersist()
    (plain, whole), (same, small) = tracked
    assert repr(same) == repr(plain) and len(same) > 100 and small < whole / 20


def test_results_of_images_are_passed_on_in_parts():
    """10,000 descriptors of one batch of images were 5 GB at once."""

    class Rows:
        def select(self, *names):
            return self

        def mapInPandas(self, go, schema):
            return go

    images = pd.DataFrame({"img": range(300), "width": 2, "height": 2, "channels": 1, "data": [bytes([k % 251] * 4) for k in range(300)]})
    for made in (lambda v: v, lambda v: v.tolist(), lambda v: v.tobytes()):
        go = I.per_image(Rows(), lambda image, row: [{"img": row["img"], "vec": made(np.full(16384, image[0, 0] / 2))}], "img bigint, vec array<double>", ["img"])
        parts = list(go(iter([images])))
        assert max(map(len, parts)) * 16384 * 8 < 16 << 20
        assert [k for p in parts for k in p["img"]] == list(range(300))
        assert all(np.array_equal(v, made(np.full(16384, k % 251 / 2))) if not isinstance(v, bytes) else v == made(np.full(16384, k % 251 / 2)) for p in parts for k, v in zip(p["img"], p["vec"]))


def test_stream_gives_the_same_tracks(spark, tmp_path):
    from sightline.streaming.tracker import track_stream

    rows = detections(2, videos=2, n=40)
    df = spark.createDataFrame(rows, DET).withColumn("ts", F.timestamp_seconds(F.col("idx") + 1000))
    want = {(r.video, r.idx, r.pos): r.face_id for r in T.track(df, 0.05).collect()}
    for k in range(4):  # four files, shuffled inside the delay
        df.where(f"idx div 10 = {k}").orderBy(F.rand(k)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    last = spark.createDataFrame([(9, 9999, 0, (0, 0, 1, 1), [1.0] * 6)], DET).withColumn("ts", F.timestamp_seconds(F.lit(19999)))
    last.write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = track_stream(stream, 0.05, "15 seconds").writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = {(r.video, r.idx, r.pos): r.face_id for r in spark.sql("SELECT * FROM tracked").collect()}
    finally:
        q.stop()
    assert got == want


def test_ordered_merge():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = 12
        centres, g = rng.integers(0, 220, (n, 2)), rng.random((n, 3))
        into = {}
        for i in range(n):
            cur = i
            while cur in into:
                cur = into[cur]
            for j in range(i + 1, n):
                o = j
                while o in into:
                    o = into[o]
                if o != cur and (abs(centres[cur] - centres[o]) <= 100).all() and 1 - g[cur] @ g[o] / np.linalg.norm(g[cur]) / np.linalg.norm(g[o]) < 0.1:
                    into[o] = cur

        def top(k):
            while k in into:
                k = into[k]
            return k

        tops = [top(k) for k in range(n)]
        assert T.merged_roots(centres, g, 0.05).tolist() == [tops.index(t) for t in tops]


def test_models(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 3, (4, 10))
    rows = [(int(i), int(i % 4), f"p{i % 4}", (np.abs(centres[i % 4] + rng.normal(0, 0.4, 10))).tolist()) for i in range(60)]
    s = spark.createDataFrame(rows, "sample_id bigint, label int, name string, vec array<double>").repartition(3)
    x = np.array([r[3] for r in rows])
    parts = M.pca(s, 10)
    assert np.allclose(parts.values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]) and np.allclose(parts.vectors.T @ parts.vectors, np.eye(10), atol=1e-8)
    assert np.allclose(parts.reconstruct(parts.project(x)), x)
    wide = M.pca_of(rng.random((6, 40)), 4)
    assert wide.vectors.shape == (40, 4) and np.allclose(wide.vectors.T @ wide.vectors, np.eye(4))
    found = M.scatter(s, "vec", "label")
    within, between = found.within, found.between
    assert found.classes == 4 and np.allclose(found.mean, x.mean(axis=0))
    assert np.allclose(within + between, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
    assert np.allclose(within, sum((x[c::4] - x[c::4].mean(axis=0)).T @ (x[c::4] - x[c::4].mean(axis=0)) for c in range(4)))
    for variant in ("generalised", "svd"):
        assert M.lda_of(found, 9, variant).vectors.shape == (10, 3)
    g = M.lda_of(found, 3)
    assert np.allclose(np.linalg.solve(within + 1e-8 * np.eye(10), between) @ g.vectors, g.vectors * g.values, atol=1e-6)
    with pytest.raises(ValueError):
        M.lda_of(M.scatter(s.where("label = 0"), "vec", "label"), 1)
    for algorithm in ("eigenfaces", "fisherfaces", "lbph"):
        model = M.train(s, algorithm, 3 if algorithm != "lbph" else None)
        before = {r.query_id: (r.label, r.name, round(r.confidence, 9)) for r in model.predict(s, leave_out_self=True).collect()}
        assert np.mean([v[0] == k % 4 for k, v in before.items()]) > 0.9
        model.save(str(tmp_path / algorithm))
        after = M.load(spark, str(tmp_path / algorithm))
        assert after.algorithm == algorithm and after.threshold == model.threshold
        assert {r.query_id: (r.label, r.name, round(r.confidence, 9)) for r in after.predict(s, leave_out_self=True).collect()} == before
    y = np.array([r[1] for r in rows])
    for margins in (M.train_margins(x, y, iterations=60), M.train_margin_all(s, rounds=30)):
        label, confidence = M.predict_margins(margins, x)
        assert (label == y).mean() > 0.9 and ((confidence >= 0.5) & (confidence <= 1)).all()


def test_components_of_whole_faces(spark):
    """At 92 x 112 dimensions, by the Gram matrix and by subspace iteration over all rows: numpy's eigenvalues and directions."""
    rng = np.random.default_rng(9)
    d, n, k = 92 * 112, 90, 6
    x = (rng.normal(size=(n, 12)) * np.geomspace(30, 1, 12)) @ rng.normal(size=(12, d)) / 10 + rng.normal(size=(n, d)) * 0.1
    s = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "sample_id bigint, vec array<double>").repartition(5)
    c = x - x.mean(axis=0)
    _, sizes, right = np.linalg.svd(c, full_matrices=False)
    for parts in (M.pca(s, k), M.subspace(s, k)):
        assert parts.vectors.shape == (d, k) and np.allclose(parts.mean, x.mean(axis=0))
        assert np.allclose(parts.values, sizes[:k] ** 2 / (n - 1), rtol=1e-6)
        assert np.allclose(np.abs((parts.vectors * right[:k].T).sum(axis=0)), 1, atol=1e-5)


def test_model_queries_by_numpy(spark):
    """The registered model queries over the whole table against plain numpy."""
    sf = "/root/testdata/sf0.01"
    rows = M_queries.samples(spark, sf).orderBy("sample_id").collect()
    x, y, ids = np.array([r.vec for r in rows]), np.array([r.label for r in rows]), np.array([r.sample_id for r in rows])
    got = [r.value for r in M_queries.pca_eigenvalues(spark, sf).orderBy("k").collect()]
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(got, values[::-1], atol=2e-6)
    means = np.array([x[y == c].mean(axis=0) for c in np.unique(y)])
    within = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(np.unique(y), means))
    off = means - x.mean(axis=0)
    between = (off.T * [np.count_nonzero(y == c) for c in np.unique(y)]) @ off
    ratio = np.linalg.solve(within + 1e-8 * np.eye(len(within)), between)
    told = {(r.variant, r.k): r.value for r in M_queries.lda_separation(spark, sf).collect()}
    of = {"generalised": np.sort(np.linalg.eigvals(ratio).real)[::-1][:9], "svd": np.linalg.svd(ratio)[1][:9] ** 2}
    assert all(np.isclose(told[v, k], of[v][k], rtol=1e-5, atol=2e-6) for v in of for k in range(9)) and len(told) == 18
    by = {r.algorithm: r for r in M_queries.recognize_components(spark, sf).collect()}
    z = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :20]
    unit = z / np.linalg.norm(z, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 20 == 0)
    far = (1 - np.clip(unit[asked] @ unit.T, -1, 1)) / 2
    far[np.arange(len(asked)), asked] = np.inf
    assert by["eigenfaces"].n == len(asked) and np.isclose(by["eigenfaces"].accuracy, (y[far.argmin(axis=1)] == y[asked]).mean(), atol=1e-6)
    best, second = np.sort(far, axis=1)[:, :2].T
    assert np.isclose(by["eigenfaces"].confidence, (1 - best / second).mean(), atol=2e-4)


def test_frame_selection(spark):
    face = lambda pos, fid, x, sharp, w=20: (pos, fid, (x, 0, w, 20), sharp)
    rows = [
        (0, 1, 0.0, []), (0, 2, 1.0, [face(0, 0, 0, 5.0)]), (0, 3, 2.0, [face(0, 0, 0, 9.0)]), (0, 4, 3.0, [face(0, 0, 90, 9.0), face(1, 1, 0, 1.0)]),
        (0, 6, 5.0, [face(0, 0, 90, 2.0), face(1, 1, 200, 1.0, w=2)]),
    ]
    df = spark.createDataFrame(rows, f"video bigint, idx bigint, ts double, faces array<struct<pos:int,face_id:int,box:{B.BOX},sharp:double>>")
    idx = lambda d: sorted(r.idx for r in d.collect())
    assert idx(FR.drop_repeats(df, 0.85)) == [2, 4, 6]
    assert idx(FR.key_frames(df)) == [3, 4]
    assert idx(FR.summary(df)) == [2] and idx(FR.summary(df, "largest")) == [2]
    assert idx(FR.sharp_enough(df, 9.0)) == [3, 4] and idx(FR.sharp_enough(df, 0)) == [1, 2, 3, 4, 6]
    assert idx(FR.select(df, FR.Selection(dedup_iou=0.85, key_frames=True, quality=1.0))) == [4]
    c = FR.counters(df, FR.select(df, FR.Selection(dedup_iou=0.85))).first()
    assert (c.frames_scanned, c.frames_with_faces, c.frames_written, c.images_written) == (5, 4, 3, 8)


def test_whole_run(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    for k in range(6):
        (folder / f"frame_{k + 1:06d}.pgm").write_bytes(codecs.write_pgm(scene(10 + k // 2, 10)))
    run = Run(detect=D.Options(min_size=12, max_size=16, step=1, min_neighbors=2), track=True, crops=True, select=FR.Selection(dedup_iou=0.9))
    frames, each = pipeline.detect_folder(spark, str(folder), DEMO, run)
    rows = {r.idx: r for r in frames.collect()}
    assert len(rows) == 6 and all(r.faces for r in rows.values()) and rows[3].ts == 2.0
    assert {f.face_id for r in rows.values() for f in r.faces} == {0}
    lines = pipeline.manifest(frames, run).orderBy("index").collect()
    assert len(lines) < 6 and lines[0].file_name == "0001_00h-00m-00s-000ms.png"
    pipeline.write_run(frames, run, str(tmp_path / "run"))
    assert records.read_manifest(spark, str(tmp_path / "run" / "manifest")).count() == len(lines)
    source = SI.read_frames(spark, str(folder))
    SI.write_files(pipeline.saved_files(source, frames, run), str(tmp_path / "out"))
    assert codecs.read_png_stored((tmp_path / "out" / lines[0].file_name).read_bytes()).shape == (40, 48)
    assert len(list((tmp_path / "out" / "crops").iterdir())) == len(lines)
    stats = T.stats(each.withColumn("face_id", F.col("face_id")))
    totals = T.report_totals(frames, stats)
    bars, times = T.timeline(stats, totals).withColumn("name", F.lit("<x>")), each.select("video", "face_id", "ts")
    (page,) = reports.track_pages(totals, bars, times)
    assert "6 frames" in page and "&lt;x&gt;" in page
    several = list(reports.track_pages(totals, bars.select(*[c for c in bars.columns if c != "face_id"], F.explode(F.sequence(F.lit(0), F.lit(6))).alias("face_id")), times, per_page=3))
    assert len(several) == 3 and sum(p.count("<section>") for p in several) == 7 and "Tracks 7 to 7, page 3 of 3" in several[2]
    shot = reports.thumbnails(source.withColumns({c: F.lit(v) for c, v in zip("xywh", (8, 8, 12, 12))}), ["idx"], "idx bigint").first()
    assert shot.thumb.startswith("data:image/png;base64,")
    t = spark.createDataFrame([(0, None, [(1, 0.0, [8, 8, 12, 12]), (2, 1.0, [8, 8, 12, 12]), (3, 2.0, [8, 8, 12, 12])]), (1, "a/b", [(5, 4.0, [0, 0, 9, 9]), (77, 9.0, [0, 0, 9, 9])])],
                              "face_id bigint, name string, frames array<struct<file_index:bigint,timestamp_secs:double,box:array<int>>>")
    names = sorted(r.name for r in pipeline.collect_dataset(t, source, 2).collect())
    assert names == ["a_b/001_face1.pgm", "unknown/001_face0.pgm", "unknown/002_face0.pgm"]


def test_benchmark(spark, tmp_path):
    rng = np.random.default_rng(6)
    for p in range(3):
        (tmp_path / f"s{p}").mkdir()
        base = rng.integers(0, 256, (14, 12), dtype=np.uint8)
        for k in range(5):
            noisy = np.clip(base.astype(int) + rng.integers(-12, 12, base.shape), 0, 255).astype(np.uint8)
            (tmp_path / f"s{p}" / f"{k}.pgm").write_bytes(codecs.write_pgm(I.resize_bilinear(noisy, 92, 112)))
    labelled = SI.read_labelled(spark, str(tmp_path))
    pixels = pipeline.face_vectors(labelled, texture=False).withColumn("vec", F.slice("vec", 1, 600))
    textures = pipeline.face_vectors(labelled, texture=True)
    got = pipeline.benchmark(pixels, textures, Benchmark(folds=2))
    assert [r["algorithm"] for r in got] == algorithms("all") == ["eigenfaces", "fisherfaces", "lbph"]
    assert all(r["top1"] >= 0.8 and r["top5_samples"] >= r["top1"] and r["auc"] > 0.8 for r in got)
    assert "| eigenfaces |" in reports.benchmark_page(got)
    assert algorithms("pca") == ["eigenfaces"]
    with pytest.raises(ValueError):
        algorithms("nope")
