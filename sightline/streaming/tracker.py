"""The tracker over a stream of detections.

Detections arrive in any order within the watermark's delay. Each video's rows wait in state until the watermark
has passed their time, are then registered in order of (idx, pos), and come out once with their track's id. Rows
that arrive later than the watermark allows are dropped by Spark before they reach the state, as for any
watermarked operator. State per video: its open tracks (last centre and mean descriptor) and the rows that wait.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.tracks import Tracker

OUT = "video bigint, idx bigint, pos int, at bigint, face_id int, distance double"
STATE = "tracks binary, waiting binary"
_WAIT = ["at", "idx", "pos", "x", "y", "w", "h", "descriptor"]  # at: milliseconds since 1970


def _step(threshold: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, waiting = Tracker(threshold), []
        if state.exists:
            tracks, held = state.get
            tracker.resume(*pickle.loads(tracks))
            waiting = pickle.loads(held)
        for pdf in frames:
            waiting += list(pdf[_WAIT].itertuples(index=False, name=None))
        mark = state.getCurrentWatermarkMs()
        ready = sorted((r for r in waiting if r[0] <= mark), key=lambda r: (r[1], r[2]))
        waiting = [r for r in waiting if r[0] > mark]
        out = []
        for at, idx, pos, x, y, w, h, descriptor in ready:
            face, distance = tracker.register((x, y, w, h), np.asarray(descriptor))
            out.append((key[0], idx, pos, at, face, np.nan if distance is None else distance))
        state.update((pickle.dumps(tracker.state()), pickle.dumps(waiting)))
        if waiting:  # come back when the earliest of them is due, even without new rows
            state.setTimeoutTimestamp(max(int(min(r[0] for r in waiting)), mark + 1))
        yield pd.DataFrame(out, columns=["video", "idx", "pos", "at", "face_id", "distance"])

    return step


def track_stream(detections: DataFrame, threshold: float = 0.3, delay: str = "10 seconds") -> DataFrame:
    """detections: a stream of video, idx, pos, ts, box, descriptor; idx rises with ts within a video."""
    flat = detections.withWatermark("ts", delay).select("video", "idx", "pos", "ts", F.unix_millis("ts").alias("at"), *(F.col("box")[c].alias(c) for c in "xywh"), "descriptor")
    return flat.groupBy("video").applyInPandasWithState(_step(threshold), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
