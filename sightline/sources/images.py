"""Frames and labelled faces from folders of image files, and image files out.

Files are read by Spark's binary source, so any file system that Spark knows will do. A file that can't be
decoded is a row with `problem` set and a null image, not a failed run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import imaging as I
from sightline.functions.text import frame_number, is_frame_file, seconds_of
from sightline.operators.ordered import numbered_whole

from . import codecs

_DECODED = "width int, height int, channels int, data binary, problem string"


def decoded(files: DataFrame, keep: dict[str, str], size: tuple[int, int] | None = None) -> DataFrame:
    """files' columns in keep (name to type) with the image that `content` holds, resized if a size is given."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for content in pdf["content"]:
                try:
                    image = codecs.read_image(bytes(content))
                    if size is not None:
                        image = I.resize_bilinear(image, *size)
                    out.append((image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, image.tobytes(), None))
                except (codecs.BadImage, ValueError) as e:
                    out.append((None, None, None, None, str(e)))
            found = pd.DataFrame(out, columns=["width", "height", "channels", "data", "problem"], index=pdf.index).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})
            yield pd.concat([pdf[list(keep)], found], axis=1)

    schema = ", ".join(f"{n} {t}" for n, t in keep.items()) + ", " + _DECODED
    return files.select(*keep, "content").mapInPandas(go, schema)


def read_frames(spark: SparkSession, folder: str, fps: float = 1.0) -> DataFrame:
    """idx (place among the folder's files by path, from 1), path, frame_idx, ts and the image."""
    files = spark.read.format("binaryFile").load(folder)
    # the list of paths is numbered before any content is read
    names = numbered_whole(files.select("path"), ["path"], "idx")
    rows = files.where(is_frame_file(F.col("path"))).join(names, "path")
    number = F.coalesce(frame_number(F.col("path")), F.col("idx"))
    return decoded(
        rows.select("idx", "path", number.alias("frame_idx"), seconds_of(number, fps).alias("ts"), "content"), {"idx": "bigint", "path": "string", "frame_idx": "bigint", "ts": "double"}
    )


def read_labelled(spark: SparkSession, folder: str, size: tuple[int, int] = (I.FACE_W, I.FACE_H)) -> DataFrame:
    """path, name, label (dense, by name) and the image: a class per sub-folder, or per prefix before _ at the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/").rsplit("/", 1)[-1])
    parent = F.element_at(F.split("path", "/"), -2)
    own = F.element_at(F.split("path", "/"), -1)
    name = F.when(parent == root, F.regexp_extract(own, r"^([^_.]+)", 1)).otherwise(parent)
    rows = files.where(is_frame_file(F.col("path"))).withColumn("name", name)
    classes = rows.select("name").distinct().withColumn("label", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))
    return decoded(rows.join(classes, "name").select("path", "name", "label", "content"), {"path": "string", "name": "string", "label": "int"}, size)


def encoded(images: DataFrame, keep: dict[str, str], form: str = "png") -> DataFrame:
    """keep's columns and `content`: the file's bytes. form: png, pgm or ppm."""
    write = {"png": codecs.write_png, "pgm": codecs.write_pgm, "ppm": codecs.write_ppm}[form]
    schema = ", ".join(f"{n} {t}" for n, t in keep.items()) + ", content binary"
    return I.per_image(images, lambda image, row: [{**{k: row[k] for k in keep}, "content": write(image)}], schema, list(keep))


def write_files(files: DataFrame, folder: str, name_col: str = "name") -> None:
    """One file per row into a folder that all executors reach through their own file system."""

    def put(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            whole = os.path.join(folder, row[name_col])
            os.makedirs(os.path.dirname(whole), exist_ok=True)
            part = f"{whole}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, whole)  # a task that runs twice leaves one whole file

    files.select(name_col, "content").foreachPartition(put)
