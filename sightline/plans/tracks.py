"""Frames, tracks and reports over detections derived from `events`, and tracks derived from `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import boxes as B
from sightline.functions.vectors import as_doubles
from sightline.operators import frames as FR
from sightline.operators import tracks as T
from sightline.operators.ordered import numbered
from sightline.tables import table

from .registry import query

_D = """
WITH RECURSIVE e AS (SELECT user_id AS video, event_id AS idx, round(epoch(ts) % 100000, 3) AS ts, round(value, 3) AS sharp FROM events),
d AS (
  SELECT video, idx, ts, 0 AS pos, ((idx // 3) % 4)::INT AS face_id, sharp,
    (video % 7 * 40 + idx % 4 * 3)::INT AS x, (video % 5 * 30 + idx % 3)::INT AS y, (40 + idx % 2)::INT AS w, (40 + video % 20)::INT AS h FROM e WHERE idx % 11 <> 0
  UNION ALL
  SELECT video, idx, ts, 1, 4, sharp + idx % 7, 300, 200, 50, (50 + idx % 2)::INT FROM e WHERE idx % 11 <> 0 AND idx % 3 = 0
), f AS (SELECT e.video, e.idx, e.ts, count(d.pos) AS faces FROM e LEFT JOIN d ON d.video = e.video AND d.idx = e.idx GROUP BY ALL)
"""
_IOU = "(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0))"
_DEDUP = f""", prev AS (SELECT video, idx, lag(idx) OVER (PARTITION BY video ORDER BY idx) AS p, faces, lag(faces) OVER (PARTITION BY video ORDER BY idx) AS pf FROM f WHERE faces > 0),
same AS (SELECT q.video, q.idx FROM prev q JOIN d a ON a.video = q.video AND a.idx = q.idx JOIN d b ON b.video = q.video AND b.idx = q.p AND b.pos = a.pos
  WHERE q.faces = q.pf GROUP BY q.video, q.idx
  HAVING min({_IOU}::DOUBLE / (a.w * a.h + b.w * b.h - {_IOU})) > 0.85),
kept AS (SELECT f.* FROM f WHERE faces > 0 AND NOT EXISTS (SELECT 1 FROM same s WHERE s.video = f.video AND s.idx = f.idx))
"""
_PICKS = ", pick AS (SELECT video, face_id, idx, pos, row_number() OVER (PARTITION BY video, face_id ORDER BY sharp DESC, w * h DESC, idx, pos) AS k FROM d)"


def frames(spark, sf_dir: str):
    """video, idx, ts, faces."""
    e = table(spark, sf_dir, "events")
    i, v = F.col("idx"), F.col("video")
    rows = e.select(
        F.col("user_id").alias("video"), F.col("event_id").alias("idx"), F.round(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6 % 100000, 3).alias("ts"), F.round("value", 3).alias("sharp")
    )

    def face(pos, face_id, box, sharp):
        return F.struct(F.lit(pos).alias("pos"), face_id.cast("int").alias("face_id"), box.alias("box"), sharp.alias("sharp"))

    one = face(0, F.floor(i / 3) % 4, B.box(v % 7 * 40 + i % 4 * 3, v % 5 * 30 + i % 3, 40 + i % 2, 40 + v % 20), F.col("sharp"))
    two = face(1, F.lit(4), B.box(F.lit(300), F.lit(200), F.lit(50), 50 + i % 2), F.col("sharp") + i % 7)
    none = F.array().cast("array<struct<pos:int,face_id:int,box:struct<x:int,y:int,w:int,h:int>,sharp:double>>")
    faces = F.when(i % 11 == 0, none).when(i % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    return rows.select("video", "idx", "ts", faces.alias("faces"))


def detections(spark, sf_dir: str):
    return frames(spark, sf_dir).select("video", "idx", "ts", F.explode("faces").alias("f")).select("video", "idx", "ts", "f.*")


@query("dedup_adjacent", _D + _DEDUP + "SELECT video, idx, faces FROM kept")
def dedup_adjacent(spark, sf_dir):
    return FR.drop_repeats(frames(spark, sf_dir), 0.85).select("video", "idx", F.size("faces").cast("bigint").alias("faces"))


@query("key_frame_picks", _D + _PICKS + "SELECT video, face_id, idx, pos FROM pick WHERE k = 1")
def key_frame_picks(spark, sf_dir):
    return FR.picks(frames(spark, sf_dir))


@query("key_frames", _D + _PICKS + "SELECT DISTINCT video, idx FROM pick WHERE k = 1")
def key_frames(spark, sf_dir):
    return FR.key_frames(frames(spark, sf_dir)).select("video", "idx")


@query("video_summary", _D + "SELECT video, min(idx) AS idx FROM f WHERE faces > 0 GROUP BY video")
def video_summary(spark, sf_dir):
    return FR.summary(frames(spark, sf_dir), "first").select("video", "idx")


@query("video_summary_largest", _D + "SELECT video, arg_max(idx, (w * h, -idx)) AS idx FROM d GROUP BY video")
def video_summary_largest(spark, sf_dir):
    return FR.summary(frames(spark, sf_dir), "largest").select("video", "idx")


@query("quality_filter", _D + "SELECT video, idx FROM d GROUP BY video, idx HAVING max(CASE WHEN w >= 3 AND h >= 3 THEN sharp END) >= 50")
def quality_filter(spark, sf_dir):
    return FR.sharp_enough(frames(spark, sf_dir), 50.0).select("video", "idx")


_WRITTEN = _DEDUP + _PICKS + """, wrote AS (SELECT k.* FROM kept k WHERE EXISTS (SELECT 1 FROM pick p WHERE p.k = 1 AND p.video = k.video AND p.idx = k.idx)
  AND EXISTS (SELECT 1 FROM d WHERE d.video = k.video AND d.idx = k.idx AND sharp >= 20))
"""


@query("frame_selection", _D + _WRITTEN + "SELECT video, idx, faces FROM wrote")
def frame_selection(spark, sf_dir):
    """All frame filters in their order: repeats, key frames, sharpness."""
    found = FR.select(frames(spark, sf_dir), FR.Selection(dedup_iou=0.85, key_frames=True, quality=20.0))
    return found.select("video", "idx", F.size("faces").cast("bigint").alias("faces"))


@query(
    "detect_counters",
    _D + _WRITTEN + "SELECT (SELECT count(*) FROM f) AS frames_scanned, (SELECT count(*) FROM f WHERE faces > 0) AS frames_with_faces, count(*) AS frames_written, sum(faces + 1)::BIGINT AS images_written FROM wrote",
)
def detect_counters(spark, sf_dir):
    all_frames = frames(spark, sf_dir)
    return FR.counters(all_frames, FR.select(all_frames, FR.Selection(dedup_iou=0.85, key_frames=True, quality=20.0)))


_STATS = ", st AS (SELECT video, face_id, min(ts) AS first_ts, max(ts) AS last_ts, round(max(ts) - min(ts), 6) AS duration_secs, count(*) AS frame_count FROM d GROUP BY ALL)"


@query("track_stats", _D + _STATS + "SELECT * FROM st")
def track_stats(spark, sf_dir):
    return T.stats(detections(spark, sf_dir))


def _numbered(spark, sf_dir):
    return numbered(detections(spark, sf_dir), ["video", "face_id"], ["idx", "pos"], "number", 1 << 16)


_NUMBER = ", nu AS (SELECT *, row_number() OVER (PARTITION BY video, face_id ORDER BY idx, pos) AS number, count(*) OVER (PARTITION BY video, face_id) AS n FROM d)"


@query("track_ema", _D + _NUMBER + "SELECT video, face_id, round(sum(CASE WHEN number = 1 THEN 0.8::DOUBLE ** (n - 1) ELSE 0.2::DOUBLE * 0.8::DOUBLE ** (n - number) END * sharp), 5) AS ema FROM nu GROUP BY ALL")
def track_ema(spark, sf_dir):
    found = T.moving_average(_numbered(spark, sf_dir), ["video", "face_id"], "number", "sharp")
    return found.withColumn("ema", F.round("ema", 5))


@query("collect_samples", _D + _NUMBER + "SELECT video, face_id, number, idx, ts FROM nu WHERE number <= 5")
def collect_samples(spark, sf_dir):
    """The first five frames of each track, for a labelled dataset."""
    return _numbered(spark, sf_dir).where("number <= 5").select("video", "face_id", "number", "idx", "ts")


@query("sample_timestamps", _D + _NUMBER + "SELECT video, face_id, ts FROM nu WHERE (number - 1) % greatest(n // 5, 1) = 0 AND (number - 1) // greatest(n // 5, 1) < 5")
def sample_timestamps(spark, sf_dir):
    return T.sample_timestamps(_numbered(spark, sf_dir), T.stats(detections(spark, sf_dir)), ["video", "face_id"]).select("video", "face_id", "ts")


@query("report_totals", _D + _STATS + "SELECT count(*) AS frames, sum(faces)::BIGINT AS faces, max(ts) AS duration, (SELECT count(*) FROM st) AS tracks FROM f")
def report_totals(spark, sf_dir):
    return T.report_totals(frames(spark, sf_dir), T.stats(detections(spark, sf_dir)))


@query("timeline_pct", _D + _STATS + ", t AS (SELECT greatest(max(ts), 0.001) AS w FROM f) SELECT video, face_id, round(first_ts / w * 100, 4) AS left_pct, round(duration_secs / w * 100, 4) AS width_pct, (face_id % 7)::INT AS colour FROM st, t")
def timeline_pct(spark, sf_dir):
    found = T.stats(detections(spark, sf_dir))
    return T.timeline(found, T.report_totals(frames(spark, sf_dir), found))


@query("recognition_stats", _D + "SELECT count(*) AS faces, sum((sharp >= 50)::INT)::BIGINT AS matched, round(avg(sharp), 4) AS mean_confidence FROM d")
def recognition_stats(spark, sf_dir):
    return detections(spark, sf_dir).agg(F.count("*").alias("faces"), F.sum((F.col("sharp") >= 50).cast("bigint")).alias("matched"), F.round(F.avg("sharp"), 4).alias("mean_confidence"))


_T = """
WITH RECURSIVE t AS (
  SELECT vec_id // 20 AS video, vec_id AS id, ((vec_id * 37) % 301)::INT AS x, ((vec_id * 53) % 211)::INT AS y, (40 + vec_id % 9)::INT AS w, 50 AS h,
    embedding::DOUBLE[] AS g, (vec_id % 97)::DOUBLE AS first_ts, (vec_id % 97 + vec_id % 13)::DOUBLE AS last_ts, 1 + vec_id % 7 AS frame_count FROM embeddings
), n AS (SELECT *, sqrt(list_sum(list_transform(g, lambda v: v * v))) AS norm FROM t)
"""
_FULL = "round(1 - greatest(-1.0, least(1.0, list_dot_product(a.g, b.g) / (a.norm * b.norm))), 9)"


def tracks(spark, sf_dir: str):
    """video, id, box, gallery, first_ts, last_ts, frame_count: twenty tracks to a video."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(i / 20).alias("video"),
        i.alias("id"),
        B.box((i * 37) % 301, (i * 53) % 211, 40 + i % 9, F.lit(50)).alias("box"),
        as_doubles(F.col("embedding")).alias("gallery"),
        (i % 97).cast("double").alias("first_ts"),
        (i % 97 + i % 13).cast("double").alias("last_ts"),
        (1 + i % 7).alias("frame_count"),
    )


@query(
    "track_merge",
    _T
    + f""", edge AS (SELECT a.video, a.id AS a, b.id AS b FROM n a JOIN n b ON a.video = b.video AND a.id <> b.id
  AND abs(a.x + a.w // 2 - b.x - b.w // 2) <= 100 AND abs(a.y + a.h // 2 - b.y - b.h // 2) <= 100 AND {_FULL} < 0.85 + 0.05),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
root AS (SELECT n.id, least(n.id, coalesce(min(r.b), n.id)) AS root FROM n LEFT JOIN reach r ON r.a = n.id GROUP BY n.id)
SELECT t.video, root, min(first_ts) AS first_ts, max(last_ts) AS last_ts, sum(frame_count)::BIGINT AS frame_count, count(*) AS members,
  arg_min(x, t.id) AS x, arg_min(y, t.id) AS y, (row_number() OVER (PARTITION BY t.video ORDER BY root) - 1)::INT AS new_id
FROM t JOIN root USING (id) GROUP BY t.video, root""",
)
def track_merge(spark, sf_dir):
    found = T.merge_closure(tracks(spark, sf_dir), 0.85)
    return found.select("video", "root", "first_ts", "last_ts", "frame_count", "members", "box.x", "box.y", "new_id")


#: One step per pair of places (i, j) in a video: `rep` has each place's representative by then, `ok` the pairs that may merge.
_ORDERED = f""", place AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY id) AS k FROM n),
pair AS (SELECT a.video, list(a.k * 100000 + b.k) AS ok FROM place a JOIN place b ON a.video = b.video AND a.id <> b.id
  AND abs(a.x + a.w // 2 - b.x - b.w // 2) <= 100 AND abs(a.y + a.h // 2 - b.y - b.h // 2) <= 100 AND {_FULL} < 0.85 + 0.05 GROUP BY a.video),
start AS (SELECT video, count(*) AS m, list(id ORDER BY id) AS ids, coalesce(any_value(ok), []) AS ok FROM place LEFT JOIN pair USING (video) GROUP BY video),
walk AS (
  SELECT video, m, ids, ok, 1::BIGINT AS i, 2::BIGINT AS j, range(1, m + 1) AS rep FROM start
  UNION ALL
  SELECT video, m, ids, ok, CASE WHEN j < m THEN i ELSE i + 1 END, CASE WHEN j < m THEN j + 1 ELSE i + 2 END,
    CASE WHEN rep[i] <> rep[j] AND list_contains(ok, rep[i] * 100000 + rep[j]) THEN [CASE WHEN r = rep[j] THEN rep[i] ELSE r END for r in rep] ELSE rep END
  FROM walk WHERE i < m
), done AS (SELECT video, ids, rep FROM walk WHERE i >= m),
flat AS (SELECT video, unnest(ids) AS id, unnest(rep) AS r FROM done)
SELECT video, id, min(id) OVER (PARTITION BY video, r) AS root FROM flat"""


@query("track_merge_ordered", _T + _ORDERED)
def track_merge_ordered(spark, sf_dir):
    """The merge in order of (i, j) through representatives."""
    return T.merge_ordered(tracks(spark, sf_dir), 0.85)


_PRIOR = """, m AS (SELECT a.video, a.id, b.id AS prior_id, 'n' || (b.id % 5) AS name, {d} AS d FROM n a JOIN n b ON a.video = b.video AND a.id % 2 = 0 AND b.id % 2 = 1
  AND abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 150),
best AS (SELECT video, id, arg_min(prior_id, (d, prior_id)) AS prior_id, arg_min(name, (d, prior_id)) AS name FROM m WHERE {where} GROUP BY ALL),
top AS (SELECT video, max(id) AS top FROM n WHERE id % 2 = 1 GROUP BY video)
SELECT n.video, n.id, prior_id, coalesce(prior_id, coalesce(top, -1) + row_number() OVER (PARTITION BY n.video, prior_id IS NULL ORDER BY n.id))::BIGINT AS final_id, name
FROM n LEFT JOIN best ON best.video = n.video AND best.id = n.id LEFT JOIN top ON top.video = n.video WHERE n.id % 2 = 0"""


def _prior(spark, sf_dir, use_gallery: bool):
    t = tracks(spark, sf_dir)
    prior = t.where("id % 2 = 1").withColumn("name", F.concat(F.lit("n"), (F.col("id") % 5).cast("string")))
    return T.merge_prior(t.where("id % 2 = 0"), prior, 0.8, use_gallery)


@query("prior_merge", _T + _PRIOR.format(d=_FULL, where="d < 0.8"))
def prior_merge(spark, sf_dir):
    return _prior(spark, sf_dir, True)


@query("prior_merge_boxes", _T + _PRIOR.format(d="round((abs(a.x - b.x) + abs(a.y - b.y)) / 200.0 + abs(a.w * a.h - b.w * b.h) / (a.w * a.h + b.w * b.h), 9)", where="true"))
def prior_merge_boxes(spark, sf_dir):
    """Without galleries: boxes alone."""
    return _prior(spark, sf_dir, False)


def tracker_input(spark, sf_dir: str):
    """Detections with an eight-number descriptor."""
    i = F.col("idx")
    descriptor = F.array(*(((((i % 5 + 1) * (k + 1) + F.col("pos")) % 7) + 0.5).cast("double") for k in range(8)))
    return detections(spark, sf_dir).select("video", "idx", "pos", "box", descriptor.alias("descriptor"))


#: One step per detection of a video, all videos side by side; `pts` and `g` are the tracks' centres and descriptors by then.
_ONLINE = """, seq AS (
  SELECT video, idx, pos, x + w // 2 AS cx, y + h // 2 AS cy, [(((idx % 5 + 1) * (k + 1) + pos) % 7 + 0.5)::DOUBLE for k in range(8)] AS d,
    row_number() OVER (PARTITION BY video ORDER BY idx, pos) AS k FROM d
), walk AS (
  SELECT video, 0::BIGINT AS k, 0::BIGINT AS idx, 0 AS pos, 0 AS face_id, NULL::DOUBLE AS distance, []::INT[][] AS pts, []::DOUBLE[][] AS g FROM (SELECT DISTINCT video FROM seq)
  UNION ALL
  SELECT video, k, idx, pos, coalesce(best, len(pts) + 1)::INT - 1, CASE WHEN best IS NOT NULL THEN dist[best] END,
    CASE WHEN best IS NULL THEN list_append(pts, [cx, cy]) ELSE [CASE WHEN i = best THEN [cx, cy] ELSE pts[i] END for i in range(1, len(pts) + 1)] END,
    CASE WHEN best IS NULL THEN list_append(g, d)
      ELSE [CASE WHEN i = best THEN [0.8::DOUBLE * g[i][c] + (1 - 0.8::DOUBLE) * d[c] for c in range(1, 9)] ELSE g[i] END for i in range(1, len(g) + 1)] END
  FROM (
    SELECT *, CASE WHEN list_min(dist) < 0.3 THEN list_position(dist, list_min(dist)) END AS best FROM (
      SELECT s.*, w.pts, w.g, [CASE WHEN abs(w.pts[i][1] - s.cx) <= 100 AND abs(w.pts[i][2] - s.cy) <= 100
        THEN 1 - greatest(-1.0, least(1.0, list_dot_product(w.g[i], s.d) / sqrt(list_dot_product(w.g[i], w.g[i]) * list_dot_product(s.d, s.d)))) ELSE 9 END
        for i in range(1, len(w.pts) + 1)] AS dist
      FROM walk w JOIN seq s ON s.video = w.video AND s.k = w.k + 1))
)
SELECT video, idx, pos, face_id, round(distance, 6) + 0.0 AS distance FROM walk WHERE k > 0"""


@query("online_tracker", _D + _ONLINE)
def online_tracker(spark, sf_dir):
    """Ordered and stateful: in SQL a step per detection."""
    return T.track(tracker_input(spark, sf_dir)).withColumn("distance", F.round("distance", 6))
