"""Which frames are written: deduplication, summary, key frames and sharpness, in that order.

A frame is a row of video, idx (unique and rising within the video), ts and faces, an array of structs with
pos, face_id, box and sharp.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.boxes import iou

from .ordered import with_previous


@dataclass(frozen=True)
class Selection:
    """dedup_iou 0: no deduplication. summary: None, "first" (frame) or "largest" (face). quality 0: no filter."""

    dedup_iou: float = 0.0
    summary: str | None = None
    key_frames: bool = False
    quality: float = 0.0


def with_faces(frames: DataFrame) -> DataFrame:
    return frames.where(F.size("faces") > 0)


def _repeats(before: Column, faces: Column, above: float) -> Column:
    alike = F.forall(F.zip_with(before, faces, lambda a, b: iou(a["box"], b["box"]) > above), lambda x: x)
    return before.isNotNull() & (F.size(before) == F.size(faces)) & alike


def drop_repeats(frames: DataFrame, above: float) -> DataFrame:
    """Without frames whose boxes all overlap, place by place, those of the face-bearing frame before."""
    marked = with_previous(with_faces(frames), ["video"], "idx", ["faces"])
    again = F.coalesce(_repeats(F.col("previous.faces"), F.col("faces"), above), F.lit(False))
    return marked.where(~again).drop("previous")


def picks(frames: DataFrame) -> DataFrame:
    """video, face_id, idx, pos: each track's sharpest face, then the largest, then the earliest."""
    each = frames.select("video", "idx", F.explode("faces").alias("f"))
    size = F.col("f.box.w") * F.col("f.box.h")
    best = F.max(F.struct(F.col("f.sharp").alias("sharp"), size.alias("size"), (-F.col("idx")).alias("idx"), (-F.col("f.pos")).alias("pos")))
    return each.groupBy("video", F.col("f.face_id").alias("face_id")).agg(best.alias("b")).select(
        "video", "face_id", (-F.col("b.idx")).alias("idx"), (-F.col("b.pos")).alias("pos")
    )


def key_frames(frames: DataFrame, all_frames: DataFrame | None = None) -> DataFrame:
    """Frames that hold some track's pick; picks are made over all_frames."""
    chosen = picks(frames if all_frames is None else all_frames).select("video", "idx").distinct()
    return frames.join(chosen, ["video", "idx"], "left_semi")


def summary(frames: DataFrame, how: str = "first") -> DataFrame:
    """One frame per video: the first with a face, or that of the largest face."""
    row = F.struct(*frames.columns)
    if how == "first":
        best = F.min_by(row, F.col("idx"))
    else:
        largest = F.array_max(F.transform("faces", lambda f: f["box"]["w"] * f["box"]["h"]))
        best = F.max_by(row, F.struct(largest, -F.col("idx")))
    return with_faces(frames).groupBy("video").agg(best.alias("best")).select("best.*")


def sharp_enough(frames: DataFrame, least: float) -> DataFrame:
    """Frames with a face of at least 3 x 3 pixels that is sharp enough; 0 or less lets all pass."""
    if least <= 0:
        return frames
    return frames.where(F.exists("faces", lambda f: (f["box"]["w"] >= 3) & (f["box"]["h"] >= 3) & (f["sharp"] >= least)))


def select(frames: DataFrame, how: Selection) -> DataFrame:
    found = drop_repeats(frames, how.dedup_iou) if how.dedup_iou > 0 else with_faces(frames)
    if how.summary:
        found = summary(found, how.summary)
    elif how.key_frames:
        found = key_frames(found, with_faces(frames))
    return sharp_enough(found, how.quality)


def counters(frames: DataFrame, written: DataFrame) -> DataFrame:
    """frames_scanned, frames_with_faces, frames_written, images_written (each face and the frame itself)."""
    scanned = frames.agg(F.count("*").alias("frames_scanned"), F.sum((F.size("faces") > 0).cast("bigint")).alias("frames_with_faces"))
    wrote = written.agg(F.count("*").alias("frames_written"), F.coalesce(F.sum(F.size("faces") + 1), F.lit(0)).alias("images_written"))
    return scanned.crossJoin(wrote)  # one row each
