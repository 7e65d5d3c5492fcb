"""Image functions over 16 x 16 images that `part` keys generate. Results are rows of pixels as text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sightline.functions import imaging as I
from sightline.tables import table

from .registry import query

SIDE = 16
_PIX = f"""
WITH px AS (
  SELECT p_partkey AS img, y, x, ((p_partkey * 31 + y * 17 + x * x * 7 + x * y * 3) % 256)::INT AS v
  FROM part, (SELECT unnest(range({SIDE})) AS y), (SELECT unnest(range({SIDE})) AS x)
)
"""
_ROWS = " SELECT img, y, string_agg(v::VARCHAR, ',' ORDER BY x) AS vals FROM r GROUP BY img, y"


def images(spark, sf_dir: str):
    """img, width, height, channels, data."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[0:SIDE, 0:SIDE]
        base = y * 17 + x * x * 7 + x * y * 3
        for pdf in frames:
            data = [((int(k) * 31 + base) % 256).astype(np.uint8).tobytes() for k in pdf["p_partkey"]]
            yield pd.DataFrame({"img": pdf["p_partkey"], "width": SIDE, "height": SIDE, "channels": 1, "data": data})

    # keys are dealt to all cores before any pixel exists: one small file would be one task
    keys = table(spark, sf_dir, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism)
    return keys.mapInPandas(make, "img bigint, width int, height int, channels int, data binary")


def _pixel_rows(spark, sf_dir, f):
    """f's result per image, a text of comma-joined values per row of pixels."""

    def run(image, row):
        out = f(image)
        return [{"img": row["img"], "y": y, "vals": ",".join(map(str, line.tolist()))} for y, line in enumerate(out)]

    return I.per_image(images(spark, sf_dir), run, "img bigint, y bigint, vals string", ["img"])


def _numbers(spark, sf_dir, f, schema: str):
    return I.per_image(images(spark, sf_dir), lambda image, row: [{"img": row["img"], **x} for x in f(image, row)], f"img bigint, {schema}", ["img"])


@query("px_gray", _PIX + ", r AS (SELECT img, y, x, (77 * v + 150 * ((v * 3) % 256) + 29 * (255 - v)) >> 8 AS v FROM px)" + _ROWS)
def px_gray(spark, sf_dir):
    """RGB images with channels v, 3 v modulo 256 and 255 - v."""

    def rgb(image):
        v = image.astype(np.int64)
        return I.gray(np.stack([v, v * 3 % 256, 255 - v], axis=2).astype(np.uint8))

    return _pixel_rows(spark, sf_dir, rgb)


@query("px_crop", _PIX + ", r AS (SELECT img, y - 4 AS y, x, v FROM px WHERE x >= 10 AND y >= 4 AND y < 12)" + _ROWS)
def px_crop(spark, sf_dir):
    return _pixel_rows(spark, sf_dir, lambda p: I.crop(p, 10, 4, 20, 8))


@query("px_flip", _PIX + f", r AS (SELECT img, y, {SIDE - 1} - x AS x, v FROM px)" + _ROWS)
def px_flip(spark, sf_dir):
    return _pixel_rows(spark, sf_dir, I.flip)


@query("px_resize_nearest", _PIX + ", g AS (SELECT unnest(range(9)) AS j), h AS (SELECT unnest(range(7)) AS i), r AS (SELECT img, j AS y, i AS x, v FROM g, h JOIN px ON px.y = j * 16 // 9 AND px.x = i * 16 // 7)" + _ROWS)
def px_resize_nearest(spark, sf_dir):
    return _pixel_rows(spark, sf_dir, lambda p: I.resize_nearest(p, 7, 9))


_BILINEAR = """, g AS (SELECT j, least(j * (16::DOUBLE / 10), 15) AS sy FROM (SELECT unnest(range(10)) AS j)),
h AS (SELECT i, least(i * (16::DOUBLE / 11), 15) AS sx FROM (SELECT unnest(range(11)) AS i)),
t AS (SELECT j, i, floor(sy)::INT * 16 AS y0, least(floor(sy)::INT + 1, 15) * 16 AS y1, floor(sx)::INT + 1 AS x0, least(floor(sx)::INT + 1, 15) + 1 AS x1,
  sx - floor(sx) AS dx, sy - floor(sy) AS dy FROM g, h),
p AS (SELECT img, list(v::DOUBLE ORDER BY y, x) AS a FROM px GROUP BY img),
r AS (SELECT img, j AS y, i AS x, round((a[y0 + x0] * (1 - dx) + a[y0 + x1] * dx) * (1 - dy) + (a[y1 + x0] * (1 - dx) + a[y1 + x1] * dx) * dy)::INT AS v FROM p, t)
"""


@query("px_resize_bilinear", _PIX + _BILINEAR + _ROWS)
def px_resize_bilinear(spark, sf_dir):
    return _pixel_rows(spark, sf_dir, lambda p: I.resize_bilinear(p, 11, 10))


@query("px_center_square", _PIX + ", r AS (SELECT img, y, x - 3 AS x, v FROM px WHERE y < 9 AND x >= 3 AND x < 12)" + _ROWS)
def px_center_square(spark, sf_dir):
    """Of the upper nine rows."""
    return _pixel_rows(spark, sf_dir, lambda p: I.centre_square(p[:9]))


_EQUAL = f""", hist AS (SELECT img, v, count(*) AS n FROM px GROUP BY ALL),
lut AS (SELECT img, v, round(sum(n) OVER (PARTITION BY img ORDER BY v) / {SIDE * SIDE}::DOUBLE * 255)::INT AS e FROM hist)
"""


@query("px_hist_equalize", _PIX + _EQUAL + ", r AS (SELECT img, y, x, e AS v FROM px JOIN lut USING (img, v))" + _ROWS)
def px_hist_equalize(spark, sf_dir):
    return _pixel_rows(spark, sf_dir, I.equalise)


@query("px_zscore", _PIX + ", s AS (SELECT img, avg(v) AS m, greatest(stddev_pop(v), 1.0) AS d FROM px GROUP BY img) SELECT img, y, round(sum((x + 1) * (v - m) / d), 5) AS weighted FROM px JOIN s USING (img) GROUP BY img, y")
def px_zscore(spark, sf_dir):
    """Per row of pixels, the sum of standardised values weighted by column."""

    def f(image, row):
        z = I.standardise(image) @ np.arange(1, SIDE + 1)
        return [{"y": y, "weighted": float(I.half_up(s * 1e5) / 1e5)} for y, s in enumerate(z)]

    return _numbers(spark, sf_dir, f, "y bigint, weighted double")


@query("px_integral", _PIX + ", rows_ AS (SELECT img, y, x, sum(v) OVER (PARTITION BY img, y ORDER BY x) AS s FROM px), r AS (SELECT img, y, x, sum(s) OVER (PARTITION BY img, x ORDER BY y)::BIGINT AS v FROM rows_)" + _ROWS)
def px_integral(spark, sf_dir):
    return _pixel_rows(spark, sf_dir, lambda p: I.integral(p)[1:, 1:])


_BOXES = [(0, 0, 16, 16), (3, 2, 5, 7), (-2, -3, 6, 6), (12, 12, 9, 9), (4, 4, 0, 3), (15, 15, 1, 1)]
_BOX_SQL = f", b(k, bx, by_, bw, bh) AS (VALUES {', '.join(str((k, *b)) for k, b in enumerate(_BOXES))})"
_IN_BOX = "x >= greatest(bx, 0) AND x < greatest(bx, 0) + bw AND y >= greatest(by_, 0) AND y < greatest(by_, 0) + bh"


@query("px_box_sum", _PIX + _BOX_SQL + f" SELECT img, k, coalesce(sum(v) FILTER ({_IN_BOX}), 0)::BIGINT AS total FROM px, b GROUP BY img, k")
def px_box_sum(spark, sf_dir):
    b = np.array(_BOXES).T

    def f(image, row):
        return [{"k": k, "total": int(s)} for k, s in enumerate(I.box_sum(I.integral(image), *b))]

    return _numbers(spark, sf_dir, f, "k int, total bigint")


@query(
    "px_window_stats",
    _PIX + _BOX_SQL + f""", s AS (SELECT img, k, greatest(bw, 0) * greatest(bh, 0) AS area, coalesce(sum(v) FILTER ({_IN_BOX}), 0) AS t, coalesce(sum(v * v) FILTER ({_IN_BOX}), 0) AS q
  FROM px, b GROUP BY img, k, bw, bh)
SELECT img, k, CASE WHEN area > 0 THEN round(t / area, 6) ELSE 0 END AS mean,
  CASE WHEN area > 0 THEN round(sqrt(greatest(q / area - (t / area) * (t / area), 0)), 6) ELSE 0 END AS deviation FROM s""",
)
def px_window_stats(spark, sf_dir):
    b = np.array(_BOXES).T

    def f(image, row):
        mean, dev = I.window_stats(I.integral(image), I.integral(image.astype(np.int64) ** 2), *b)
        return [{"k": k, "mean": round(float(m), 6), "deviation": round(float(d), 6)} for k, (m, d) in enumerate(zip(mean, dev))]

    return _numbers(spark, sf_dir, f, "k int, mean double, deviation double")


_LAPLACE = """, n AS (SELECT img, y, x, v, lag(v) OVER w + v + lead(v) OVER w AS s FROM px WINDOW w AS (PARTITION BY img, y ORDER BY x)),
l AS (SELECT img, y, x, 9 * v - (lag(s) OVER w + s + lead(s) OVER w) AS lap FROM n WINDOW w AS (PARTITION BY img, x ORDER BY y))
"""


@query("px_laplacian_var", _PIX + _LAPLACE + "SELECT img, round(avg(lap * lap) - avg(lap) * avg(lap), 4) AS variance FROM l WHERE lap IS NOT NULL AND x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14 GROUP BY img")
def px_laplacian_var(spark, sf_dir):
    return _numbers(spark, sf_dir, lambda p, row: [{"variance": round(I.laplacian_variance(p), 4)}], "variance double")


@query("px_sharpness", _PIX.replace("(SELECT unnest(range(16)) AS y)", "(SELECT unnest(range(1, 12)) AS y)").replace("(SELECT unnest(range(16)) AS x)", "(SELECT unnest(range(3, 14)) AS x)")
       + _LAPLACE + "SELECT img, round(avg(lap * lap) - avg(lap) * avg(lap), 4) AS sharpness FROM l WHERE lap IS NOT NULL AND x BETWEEN 4 AND 12 AND y BETWEEN 2 AND 10 GROUP BY img")
def px_sharpness(spark, sf_dir):
    """Of the box (4, 2, 9, 9), which 15 % widen by one pixel on each side."""
    return _numbers(spark, sf_dir, lambda p, row: [{"sharpness": round(I.sharpness(p, (4, 2, 9, 9)), 4)}], "sharpness double")


@query("px_landmarks", """WITH b AS (SELECT p_partkey AS img, p_partkey % 50 AS x, p_partkey % 30 AS y, 20 + p_partkey % 17 AS w, 24 + p_partkey % 13 AS h FROM part)
SELECT img, 0 AS k, x + w // 4 AS x, y + h // 3 AS y FROM b UNION ALL SELECT img, 1, x + w * 3 // 4, y + h // 3 FROM b UNION ALL SELECT img, 2, x + w // 2, y + h // 2 FROM b
UNION ALL SELECT img, 3, x + w // 4, y + h * 5 // 6 FROM b UNION ALL SELECT img, 4, x + w * 3 // 4, y + h * 5 // 6 FROM b""")  # fmt: skip
def px_landmarks(spark, sf_dir):
    """Plain column arithmetic: five points per box."""
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select(k.alias("img"), (k % 50).alias("x"), (k % 30).alias("y"), (20 + k % 17).alias("w"), (24 + k % 13).alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    part = lambda a, n, d: a + F.floor((n * d[0]) / d[1])
    shares = [((1, 4), (1, 3)), ((3, 4), (1, 3)), ((1, 2), (1, 2)), ((1, 4), (5, 6)), ((3, 4), (5, 6))]
    points = F.array(*(F.struct(F.lit(i).alias("k"), part(x, w, sx).alias("x"), part(y, h, sy).alias("y")) for i, (sx, sy) in enumerate(shares)))
    return b.select("img", F.explode(points).alias("p")).select("img", "p.*")


_CODES = """, n AS (SELECT img, y, x, v, lag(v) OVER w AS l, lead(v) OVER w AS r FROM px WINDOW w AS (PARTITION BY img, y ORDER BY x)),
m AS (SELECT *, lag(v) OVER w AS u, lag(l) OVER w AS ul, lag(r) OVER w AS ur, lead(v) OVER w AS d, lead(l) OVER w AS dl, lead(r) OVER w AS dr FROM n WINDOW w AS (PARTITION BY img, x ORDER BY y)),
c AS (SELECT img, y, x, CASE WHEN x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14 THEN
  (l >= v)::INT + 2 * (ul >= v)::INT + 4 * (u >= v)::INT + 8 * (ur >= v)::INT + 16 * (r >= v)::INT + 32 * (dr >= v)::INT + 64 * (d >= v)::INT + 128 * (dl >= v)::INT
  ELSE 0 END AS v FROM m)
"""


@query("px_lbp", _PIX + _CODES + ", r AS (SELECT * FROM c)" + _ROWS)
def px_lbp(spark, sf_dir):
    return _pixel_rows(spark, sf_dir, I.texture_codes)


@query("px_lbph", _PIX + _CODES + "SELECT img, ((y // 2) * 8 + x // 2)::INT AS cell, v AS code, round(count(*) / 4, 6) AS share FROM c GROUP BY ALL")
def px_lbph(spark, sf_dir):
    """The texture histogram's cells that aren't empty."""

    def f(image, row):
        h = I.texture_histogram(I.texture_codes(image)).reshape(64, 256)
        return [{"cell": int(c), "code": int(b), "share": round(float(h[c, b]), 6)} for c, b in zip(*np.nonzero(h))]

    return _numbers(spark, sf_dir, f, "cell int, code int, share double")


_HOG = """, n AS (SELECT img, y, x, coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v) AS gx, v FROM px WINDOW w AS (PARTITION BY img, y ORDER BY x)),
g AS (SELECT img, y, x, gx, coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v) AS gy FROM n WINDOW w AS (PARTITION BY img, x ORDER BY y)),
o AS (SELECT img, y // 8 * 2 + x // 8 AS cell, sqrt((gx * gx + gy * gy)::DOUBLE) AS m, (CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END) / pi() * 9 AS p FROM g),
b AS (SELECT img, cell, floor(p)::INT % 9 AS bin, m * (1 - (p - floor(p))) AS s FROM o UNION ALL SELECT img, cell, (floor(p)::INT % 9 + 1) % 9, m * (p - floor(p)) FROM o)
SELECT img, cell::INT AS cell, bin, round(sum(s), 4) AS strength FROM b GROUP BY img, cell, bin HAVING round(sum(s), 4) > 0
"""


@query("px_hog_cells", _PIX + _HOG)
def px_hog_cells(spark, sf_dir):
    def f(image, row):
        cells = I.gradient_cells(image).reshape(4, 9)
        cells = I.half_up(cells * 1e4) / 1e4
        return [{"cell": int(c), "bin": int(b), "strength": float(cells[c, b])} for c, b in zip(*np.nonzero(cells))]

    return _numbers(spark, sf_dir, f, "cell int, bin int, strength double")


@query("px_descriptors")
def px_descriptors(spark, sf_dir):
    """Digests of the long descriptors, the aligned face and the padded crop; tests hold them against plain loops."""

    def f(image, row):
        box = (2, 1, 11, 12)
        texture, gradient = I.tracker_descriptor(image, box), I.gradient_of_box(image, box)
        face = I.align(image, box, I.landmarks(box), 23, 28)
        vector = I.preprocess(image, box, (23, 28))
        return [
            {
                "texture_dims": len(texture), "texture_norm": round(float(np.linalg.norm(texture)), 6),
                "gradient_dims": len(gradient), "gradient_norm": round(float(np.linalg.norm(gradient)), 6),
                "aligned_sum": int(face.astype(np.int64).sum()), "vector_norm": round(float(np.linalg.norm(vector)), 6),
            }
        ]

    return _numbers(spark, sf_dir, f, "texture_dims int, texture_norm double, gradient_dims int, gradient_norm double, aligned_sum bigint, vector_norm double")
