"""Whole runs over folders of frames: detect, track, select, write; benchmark; collect a dataset."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import boxes as B
from sightline.functions import imaging as I
from sightline.functions import text as X
from sightline.functions import vectors as V
from sightline.operators import detect as D
from sightline.operators import evaluation as E
from sightline.operators import frames as FR
from sightline.operators import models as M
from sightline.operators import neighbours as N
from sightline.operators import tracks as T
from sightline.options import Benchmark, Run, algorithms
from sightline.scratch import written
from sightline.sources import images as SI
from sightline.sources import records
from sightline.sources.cascades import Cascade


def detect_folder(spark: SparkSession, folder: str, cascade: Cascade, run: Run, video: int = 0) -> tuple[DataFrame, DataFrame]:
    """frames (video, idx, path, frame_idx, ts, faces) and detections with track ids; pixels are read once."""
    source = SI.read_frames(spark, folder, run.fps)
    keep = ["idx", "path", "frame_idx", "ts"]
    found = D.detect(source.where("problem IS NULL"), cascade, run.detect, keep, "idx bigint, path string, frame_idx bigint, ts double")
    each = written(found.select(F.lit(video).cast("bigint").alias("video"), *keep, "pos", B.box("x", "y", "w", "h").alias("box"), "sharp", "descriptor"), "detections")
    if run.track:
        ids = T.track(each, run.track_threshold)
        each = each.join(ids.select("video", "idx", "pos", "face_id"), ["video", "idx", "pos"])
    else:
        each = each.withColumn("face_id", F.lit(None).cast("int"))
    faces = each.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("pos", "face_id", "box", "sharp"))).alias("faces"))  # one image's faces
    listed = source.select(F.lit(video).cast("bigint").alias("video"), *keep)
    none = F.array().cast(faces.schema["faces"].dataType)
    return listed.join(faces, "idx", "left").withColumn("faces", F.coalesce("faces", none)), each


def manifest(frames: DataFrame, run: Run) -> DataFrame:
    """The rows that a run writes: index, ts, frame_idx, file_name, boxes, face_ids, is_keyframe."""
    chosen = FR.select(frames, run.select)
    keys = FR.picks(FR.with_faces(frames)).select("video", "idx").distinct().withColumn("is_keyframe", F.lit(True))
    rows = chosen.join(keys, ["video", "idx"], "left")
    ids = F.filter(F.transform("faces", lambda f: f["face_id"]), lambda i: i.isNotNull())
    return rows.select(
        F.col("idx").alias("index"), "ts", "frame_idx", X.frame_name(F.col("idx"), F.col("ts")).alias("file_name"),
        F.transform("faces", lambda f: f["box"]).alias("boxes"), ids.alias("face_ids"), F.coalesce("is_keyframe", F.lit(False)).alias("is_keyframe"),
    )


def saved_files(source: DataFrame, frames: DataFrame, run: Run) -> DataFrame:
    """name, content: the annotated frame of each chosen row, and its crops if asked for."""
    chosen = FR.select(frames, run.select).select("idx", "ts", "faces")
    rows = source.where("problem IS NULL").drop("ts").join(chosen, "idx")
    stamp = X.time_stamp(F.col("ts"))
    rows = rows.withColumn("stem", F.concat(X.padded(F.col("idx"), 4), F.lit("_"), stamp))

    def draw(image, row):
        from sightline.sources.codecs import write_png

        shown, out = image, []
        for f in row["faces"]:
            b = f["box"]
            box = (b["x"], b["y"], b["w"], b["h"])
            shown = I.draw_box(shown, box, f["face_id"])
            if f["face_id"] is not None:
                shown = I.draw_text(shown, box[0], box[1] - 6, str(f["face_id"]))
            if run.crops:
                part = I.align(image, box, I.landmarks(box), I.FACE_W, I.FACE_H) if run.align else I.crop(image, *I._padded_box(image.shape, box, run.padding))
                if part.size:
                    out.append({"name": f"crops/{row['stem']}_face{f['pos'] + 1:02d}.png", "content": write_png(part)})
        return [{"name": f"{row['stem']}.png", "content": write_png(shown)}, *out]

    return I.per_image(rows, draw, "name string, content binary", ["stem", "faces"])


def collect_dataset(tracks: DataFrame, source: DataFrame, per_track: int, whole: bool = True) -> DataFrame:
    """name, content: the first frames of each track as face-sized PGM files under the person's name.

    tracks: face_id, name, frames (array of file_index, timestamp_secs, box). Unnamed tracks go to `unknown`;
    whole takes the frame, otherwise the face's box.
    """
    first = tracks.select("face_id", X.safe_name(F.coalesce("name", F.lit("unknown"))).alias("person"), F.posexplode(F.slice("frames", 1, per_track)).alias("k", "f"))
    rows = first.join(source.where("problem IS NULL"), F.col("f.file_index") == F.col("idx")).withColumn("box", F.col("f.box"))

    def cut(image, row):
        from sightline.sources.codecs import write_pgm

        part = I.gray(image) if whole else I.crop(I.gray(image), *(int(v) for v in row["box"]))
        if not part.size:
            return []
        return [{"name": f"{row['person']}/{row['k'] + 1:03d}_face{row['face_id']}.pgm", "content": write_pgm(I.resize_bilinear(part, I.FACE_W, I.FACE_H))}]

    return I.per_image(rows, cut, "name string, content binary", ["person", "k", "face_id", "box"])


def face_vectors(labelled: DataFrame, texture: bool) -> DataFrame:
    """sample_id, label, name, vec from read_labelled: standardised pixels, or their texture histogram."""

    def run(image, row):
        v = I.preprocess(image)
        if texture:
            v = I.texture_descriptor(v, I.FACE_W, I.FACE_H)
        return [{"path": row["path"], "label": row["label"], "name": row["name"], "vec": v.tolist()}]

    rows = I.per_image(labelled.where("problem IS NULL"), run, "path string, label int, name string, vec array<double>", ["path", "label", "name"])
    return rows.select(F.xxhash64("path").alias("sample_id"), "label", "name", "vec")


def benchmark(pixels: DataFrame, textures: DataFrame, how: Benchmark) -> list[dict]:
    """Per algorithm: k-fold identification (top-1, top-5 of samples) and resubstitution verification (ROC figures)."""
    report = []
    for algorithm in algorithms(how.algorithm):
        data = written(E.stratified_folds(textures if algorithm == "lbph" else pixels, how.folds, "sample_id", "label", how.seed), "folds")
        row: dict = {"algorithm": algorithm}
        if how.mode in ("identification", "all"):
            hits = None
            fit = ask = 0.0
            for fold in range(how.folds):
                began = time.perf_counter()
                model = M.train(E.train_of(data, fold, "sample_id"), algorithm, threshold=0.5 if algorithm == "eigenfaces" else None)
                fit += time.perf_counter() - began
                metric = V.METRIC_OF[algorithm]
                found = N.nearest(model.embed(data.where(F.col("fold") == fold)), model.gallery, 5, metric, "sample_id", "vec", "label")
                began = time.perf_counter()
                top = written(N.top_hits(found), "hits")
                ask += time.perf_counter() - began
                hits = top if hits is None else hits.unionByName(top)
            got = hits.agg(F.avg(F.col("top1").cast("double")), F.avg(F.col("topk").cast("double"))).first()
            row |= {"top1": got[0], "top5_samples": got[1], "train_s": fit / how.folds, "test_s": ask / how.folds}
        if how.mode in ("verification", "all"):
            model = M.train(data, algorithm, threshold=0.5 if algorithm == "eigenfaces" else None)
            row |= E.roc_summary(_scored(model.gallery, algorithm), "distance", "same").first().asDict()
        report.append(row)
    return report


def _scored(gallery: DataFrame, algorithm: str) -> DataFrame:
    measure = V.COLUMNS[V.METRIC_OF[algorithm]]
    same = E.adjacent_pairs(gallery, "sample_id", "label").select("i", "j", F.lit(True).alias("same"))
    pairs = same.unionByName(E.negative_pairs(gallery, "sample_id", "label").select("i", "j", F.lit(False).alias("same")))
    a = gallery.select(F.col("sample_id").alias("i"), F.col("vec").alias("a"))
    b = gallery.select(F.col("sample_id").alias("j"), F.col("vec").alias("b"))
    return pairs.join(a, "i").join(b, "j").select(measure(F.col("a"), F.col("b")).alias("distance"), "same")


def write_run(frames: DataFrame, run: Run, folder: str) -> None:
    """The manifest of a run as text."""
    records.write_manifest(manifest(frames, run), f"{folder}/manifest")
