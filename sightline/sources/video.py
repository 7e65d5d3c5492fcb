"""Frames of video files, by the ffmpeg program where the executors have it."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import codecs

SCHEMA = "path string, frame_idx bigint, ts double, width int, height int, channels int, data binary, problem string"


def read_videos(spark: SparkSession, folder: str, fps: float = 1.0) -> DataFrame:
    """One row per sampled gray frame of each file in the folder; a file that can't be decoded is one row with
    `problem`. A task decodes one video at a time into its own scratch space and passes frames on one by one."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield from _one(path, bytes(content))

    def _one(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        bad = lambda why: pd.DataFrame([(path, None, None, None, None, None, None, why)], columns=columns)
        if shutil.which("ffmpeg") is None:
            yield bad("ffmpeg is not installed")
            return
        with tempfile.TemporaryDirectory() as own:
            (Path(own) / "video").write_bytes(content)
            done = subprocess.run(
                ["ffmpeg", "-v", "error", "-i", f"{own}/video", "-vf", f"fps={fps}", "-pix_fmt", "gray", f"{own}/frame_%06d.pgm"], capture_output=True, text=True
            )
            found = sorted(Path(own).glob("frame_*.pgm"))
            if done.returncode and not found:
                yield bad(done.stderr[-500:])
            for k, file in enumerate(found, start=1):
                image = codecs.read_pgm(file.read_bytes())
                yield pd.DataFrame([(path, k, (k - 1) / fps, image.shape[1], image.shape[0], 1, image.tobytes(), None)], columns=columns)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(decode, SCHEMA)
