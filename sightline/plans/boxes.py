"""Box operators over boxes derived from `events`: eight to an image."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import boxes as B
from sightline.operators import boxes as O
from sightline.tables import table

from .registry import ORACLES, query

_V = """
WITH RECURSIVE v AS (
  SELECT event_id // 8 AS image, event_id AS id, ((event_id * 37) % 61)::INT AS x, ((event_id * 53) % 59)::INT AS y,
         (30 + event_id % 20)::INT AS w, (30 + event_id % 17)::INT AS h, round(value, 3) AS score FROM events
), p AS (
  SELECT a.image, a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh,
    (greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0)::BIGINT * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0))::DOUBLE AS common
  FROM v a JOIN v b ON a.image = b.image AND a.id < b.id
), o AS (SELECT *, CASE WHEN common <= 0 THEN 0 ELSE common / (aw * ah + bw * bh - common) END AS iou FROM p)
"""


def boxes(spark, sf_dir: str):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.floor(i / 8).alias("image"), i.alias("id"), B.box((i * 37) % 61, (i * 53) % 59, 30 + i % 20, 30 + i % 17).alias("box"), F.round("value", 3).alias("score")
    )




def _flat(df, *cols):
    return df.select(*cols, *(F.col("box")[c].alias(c) for c in "xywh"))


@query("iou_self_join", _V + "SELECT image, a, b, round(iou, 6) AS iou FROM o WHERE iou > 0.2")
def iou_self_join(spark, sf_dir):
    return O.overlaps(boxes(spark, sf_dir), "image", "id", "box", 0.2).withColumn("iou", F.round("iou", 6))


@query(
    "gate_join_binned",
    """WITH v AS (SELECT user_id, event_id // 256 AS clip, event_id AS id, ((event_id * 37) % 640)::INT AS x, ((event_id * 53) % 480)::INT AS y FROM events)
SELECT l.id AS a, r.id AS b FROM v l JOIN v r ON l.user_id = r.user_id AND l.clip = r.clip AND l.id < r.id
 AND abs((l.x + 20) - (r.x + 20)) <= 100 AND abs((l.y + 15) - (r.y + 15)) <= 100""",
)
def gate_join_binned(spark, sf_dir):
    """Pairs of boxes of one user and clip (256 frames) whose centres lie within the tracker's gate, by an equi-join on grid cells."""
    i = F.col("event_id")
    v = table(spark, sf_dir, "events").select("user_id", F.floor(i / 256).alias("clip"), i.alias("id"), B.box((i * 37) % 640, (i * 53) % 480, F.lit(40), F.lit(30)).alias("box"))
    return O.gated_pairs(v, v, ["user_id", "clip"], 100).where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


@query(
    "group_boxes",
    _V
    + """, edge AS (SELECT image, a, b FROM o WHERE iou > 0.1 UNION ALL SELECT image, b, a FROM o WHERE iou > 0.1),
reach AS (SELECT image, a, b FROM edge UNION SELECT r.image, r.a, e.b FROM reach r JOIN edge e ON r.image = e.image AND r.b = e.a),
root AS (SELECT v.image, v.id, least(v.id, coalesce(min(r.b), v.id)) AS root, x, y, w, h FROM v LEFT JOIN reach r ON r.image = v.image AND r.a = v.id GROUP BY ALL)
SELECT image, root, count(*) AS size, trunc(sum(x) / count(*))::INT AS x, trunc(sum(y) / count(*))::INT AS y,
  trunc(sum(w) / count(*))::INT AS w, trunc(sum(h) / count(*))::INT AS h FROM root GROUP BY image, root HAVING count(*) >= 3""".replace(
        "least(v.id, coalesce(min(r.b), v.id)) AS root, x, y, w, h FROM v LEFT JOIN reach r ON r.image = v.image AND r.a = v.id GROUP BY ALL",
        "least(v.id, coalesce(min(r.b), v.id)) AS root, x, y, w, h FROM v LEFT JOIN reach r ON r.image = v.image AND r.a = v.id GROUP BY v.image, v.id, x, y, w, h",
    ),
)
def group_boxes(spark, sf_dir):
    return _flat(O.group_boxes(boxes(spark, sf_dir), "image", "id", "box", 3), "image", "root", "size")


@query("group_boxes_joined")
def group_boxes_joined(spark, sf_dir):
    """The same groups by joins and star rounds."""
    return _flat(O.group_boxes_joined(boxes(spark, sf_dir), "image", "id", "box", 3), "image", "root", "size")


ORACLES["group_boxes_joined"] = ORACLES["group_boxes"]


@query("group_boxes_passthrough", _V + "SELECT image, id AS root, 1::BIGINT AS size, x, y, w, h FROM v")
def group_boxes_passthrough(spark, sf_dir):
    """min_neighbors of 1 groups nothing."""
    return _flat(O.group_boxes(boxes(spark, sf_dir), "image", "id", "box", 1), "image", "root", "size")


_NMS = """, k AS (SELECT image, id, row_number() OVER (PARTITION BY image ORDER BY {order}) AS place FROM {rows}),
both_ AS (SELECT image, a, b, iou FROM o UNION ALL SELECT image, b, a, iou FROM o),
walk AS (
  SELECT image, 1 AS place, [id] AS stay FROM k WHERE place = 1
  UNION ALL
  SELECT w.image, w.place + 1, CASE WHEN EXISTS (SELECT 1 FROM both_ t WHERE t.image = w.image AND t.a = k.id AND list_contains(w.stay, t.b) AND t.iou > {above})
      THEN w.stay ELSE list_append(w.stay, k.id) END
  FROM walk w JOIN k ON k.image = w.image AND k.place = w.place + 1
), last AS (SELECT image, arg_max(stay, place) AS stay FROM walk GROUP BY image),
kept AS (SELECT image, unnest(stay) AS id, generate_subscripts(stay, 1)::INT AS place FROM last)
"""


@query("nms_top", _V + _NMS.format(order="score DESC, id", rows="v", above=0.3) + "SELECT image, id, v.x, v.y, v.w, v.h, v.score, place FROM kept JOIN v USING (image, id)")
def nms_top(spark, sf_dir):
    found = O.suppress(boxes(spark, sf_dir), "image", "id", "box", "score", 0.3)
    return _flat(found, "image", "id", "score", "place")


@query(
    "merge_detections",
    _V + _NMS.format(order="id % 2, id", rows="v", above=0.3) + "SELECT image, id, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS score, place FROM kept",
)
def merge_detections(spark, sf_dir):
    """Boxes of even ids as one detector's, of odd ids as the other's."""
    v = boxes(spark, sf_dir)
    half = lambda k: v.where(F.col("id") % 2 == k).withColumn("id", F.floor(F.col("id") / 2))
    return O.merge_detections(half(0), half(1), "image", "id", "box").select("image", "id", "score", "place")


@query("flip_union", _V + "SELECT image, id, x, y, w, h FROM v UNION ALL SELECT image, id, greatest(100 - x - w, 0), y, w, h FROM v")
def flip_union(spark, sf_dir):
    """Boxes found in an image and in its mirror image of width 100."""
    v = boxes(spark, sf_dir)
    back = v.withColumn("box", B.mirrored(F.col("box"), F.lit(100)))
    return _flat(v.unionByName(back), "image", "id")


@query(
    "prior_score",
    _V + "SELECT a, b, round((abs(ax - bx) + abs(ay - by_)) / 200.0 + abs(aw * ah - bw * bh) / (aw * ah + bw * bh), 6) AS score, abs(ax - bx) <= 20 AND abs(ay - by_) <= 20 AS near FROM p",
)
def prior_score(spark, sf_dir):
    """The fallback score between boxes without descriptors, and the corner gate."""
    v = boxes(spark, sf_dir)
    a = v.select("image", F.col("id").alias("a"), F.col("box").alias("box_a"))
    b = v.select("image", F.col("id").alias("b"), F.col("box").alias("box_b"))
    x, y = F.col("box_a"), F.col("box_b")
    return a.join(b, "image").where("a < b").select("a", "b", F.round(B.fallback_score(x, y), 6).alias("score"), B.corners_near(x, y, 20).alias("near"))
