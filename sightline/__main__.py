"""Commands over whole runs: python -m sightline COMMAND ...; --help tells each one's options."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import pipeline
from sightline.functions import imaging as I
from sightline.operators import models as M
from sightline.operators import tracks as T
from sightline.operators.detect import Options
from sightline.operators.frames import Selection
from sightline.options import Benchmark, Run, algorithms
from sightline.sources import cascades, records, reports
from sightline.sources import images as SI


def _run_of(a: argparse.Namespace) -> Run:
    asked = {"min_size": a.min_size, "max_size": a.max_size, "scale": a.scale, "step": a.step, "min_neighbors": a.min_neighbors}
    given = {k: v for k, v in asked.items() if v is not None} | {"flip": a.flip}
    how = Options.high_recall(**given) if a.high_recall else Options(**given)
    chosen = Selection(dedup_iou=a.dedup, summary=a.summary, key_frames=a.key_frames, quality=a.quality)
    return Run(detect=how, select=chosen, fps=a.fps, track=a.track, track_threshold=a.threshold, padding=a.padding, crops=a.crops, align=a.align)


def detect(spark: SparkSession, a: argparse.Namespace) -> None:
    run = _run_of(a)
    frames, each = pipeline.detect_folder(spark, a.frames, cascades.read_cascade(a.cascade), run)
    pipeline.write_run(frames, run, a.out)
    SI.write_files(pipeline.saved_files(SI.read_frames(spark, a.frames, run.fps), frames, run), a.out)
    if run.track:
        records.write_tracks(_tracks(each), os.path.join(a.out, "tracks"))
        stats = T.stats(each)
        totals = T.report_totals(frames, stats)
        for k, page in enumerate(reports.track_pages(totals, T.timeline(stats, totals), each.select("video", "face_id", "ts"))):
            with open(os.path.join(a.out, f"report{k or ''}.html"), "w", encoding="utf-8") as f:
                f.write(page)


def _tracks(each: DataFrame) -> DataFrame:
    """Entries of a track file, without galleries: a later run matches them by their boxes."""
    frame = F.struct(F.col("idx").alias("file_index"), F.col("ts").alias("timestamp_secs"), records.box_array(F.col("box")).alias("box"))
    return each.groupBy("face_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("frame_count"), F.lit(None).cast("string").alias("name"),
        F.min_by("box", F.struct("idx", "pos")).alias("box"), F.lit(None).cast("array<double>").alias("gallery"), F.sort_array(F.collect_list(frame)).alias("frames"),
    )


def _vectors(spark: SparkSession, folder: str, algorithm: str) -> DataFrame:
    return pipeline.face_vectors(SI.read_labelled(spark, folder), texture=algorithm == "lbph")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    for algorithm in algorithms(a.algorithm):
        M.train(_vectors(spark, a.faces, algorithm), algorithm, a.components, a.threshold).save(os.path.join(a.model, algorithm) if a.algorithm == "all" else a.model)


def recognise(spark: SparkSession, a: argparse.Namespace) -> None:
    model = M.load(spark, a.model)
    texture = model.algorithm == "lbph"

    def vector(image, row):
        v = I.preprocess(image)
        return [{"path": row["path"], "vec": (I.texture_descriptor(v, I.FACE_W, I.FACE_H) if texture else v).tolist()}]

    images = SI.read_frames(spark, a.images).where("problem IS NULL")
    asked = I.per_image(images, vector, "path string, vec array<double>", ["path"]).select(F.xxhash64("path").alias("sample_id"), "path", F.lit(None).cast("int").alias("label"), "vec")
    found = model.predict(asked).join(asked.select(F.col("sample_id").alias("query_id"), "path"), "query_id")
    line = F.concat_ws("\t", "path", F.coalesce("name", F.lit("unknown")), F.format_number("confidence", 4))
    found.select(line.alias("value")).sort("value").write.text(a.out)


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    labelled = SI.read_labelled(spark, a.faces)
    how = Benchmark(algorithm=a.algorithm, mode=a.mode, folds=a.folds, seed=a.seed)
    print(reports.benchmark_page(pipeline.benchmark(pipeline.face_vectors(labelled, False), pipeline.face_vectors(labelled, True), how)), end="")


def name(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = spark.read.text(a.labels).select("value", F.monotonically_increasing_id().alias("line_no"))
    tracks = records.read_track_lines(spark, a.tracks)
    named = T.name_tracks(tracks.drop("name"), records.parse_labels(lines))
    named.select(*tracks.columns).write.json(a.out, ignoreNullFields=True)


def collect(spark: SparkSession, a: argparse.Namespace) -> None:
    SI.write_files(pipeline.collect_dataset(records.read_track_lines(spark, a.tracks), SI.read_frames(spark, a.frames), a.per_track, not a.faces_only), a.out)


def info(spark: SparkSession, a: argparse.Namespace) -> None:
    model = M.load(spark, a.model)
    n, classes = model.gallery.agg(F.count("*"), F.count_distinct("label")).first()
    shape = "texture histograms" if model.parts is None else f"{model.parts.vectors.shape[1]} components of {model.parts.vectors.shape[0]} dimensions"
    print(f"{model.algorithm}: {shape}, {n} samples of {classes} classes, threshold {model.threshold:g}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sightline")
    commands = out.add_subparsers(dest="command", required=True)

    def command(run, *places: str) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__)
        p.set_defaults(run=run)
        for place in places:
            p.add_argument(place)
        return p

    d = command(detect, "frames", "out")
    d.add_argument("--cascade", required=True)
    for option, kind in (("min-size", int), ("max-size", int), ("scale", float), ("step", int), ("min-neighbors", int)):
        d.add_argument(f"--{option}", type=kind)
    for option, default in (("fps", 1.0), ("threshold", 0.3), ("padding", 0.2), ("dedup", 0.0), ("quality", 0.0)):
        d.add_argument(f"--{option}", type=float, default=default)
    for option in ("flip", "high-recall", "track", "crops", "align", "key-frames"):
        d.add_argument(f"--{option}", action="store_true")
    d.add_argument("--summary", choices=("first", "largest"))
    t = command(train, "faces", "model")
    t.add_argument("--algorithm", default="eigenfaces")
    t.add_argument("--components", type=int)
    t.add_argument("--threshold", type=float)
    command(recognise, "model", "images", "out")
    b = command(benchmark, "faces")
    b.add_argument("--algorithm", default="all")
    b.add_argument("--mode", default="all")
    b.add_argument("--folds", type=int, default=5)
    b.add_argument("--seed", type=int, default=42)
    command(name, "tracks", "labels", "out")
    c = command(collect, "tracks", "frames", "out")
    c.add_argument("--per-track", type=int, default=10)
    c.add_argument("--faces-only", action="store_true")
    command(info, "model")
    return out


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName(f"sightline {a.command}").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
