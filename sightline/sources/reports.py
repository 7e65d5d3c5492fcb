"""Report texts from small result tables."""

from __future__ import annotations

import base64
import html
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import imaging as I
from sightline.operators.ordered import numbered_whole
from sightline.scratch import written

from . import codecs

#: Tracks on one page of a report.
PAGE_TRACKS = 2000
THUMB_W, THUMB_H = 180, 135


def thumbnail(image: np.ndarray, box) -> str:
    """The box as a data url of a small PNG."""
    part = I.crop(image, *box)
    if not part.size:
        return ""
    return "data:image/png;base64," + base64.b64encode(codecs.write_png(I.resize_bilinear(part, THUMB_W, THUMB_H))).decode()


def thumbnails(images: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """keep's columns and `thumb`; images has x, y, w, h of the face beside the pixels."""
    box = ["x", "y", "w", "h"]

    def run(image, row):
        return [{**{k: row[k] for k in keep}, "thumb": thumbnail(image, tuple(int(row[c]) for c in box))}]

    return I.per_image(images, run, schema + ", thumb string", [*keep, *box])


def track_pages(totals: DataFrame, tracks: DataFrame, times: DataFrame, title: str = "Tracks", per_page: int = PAGE_TRACKS) -> Iterator[str]:
    """HTML pages that together show every track: totals, and per track its bar on the timeline, its name, thumbnail and a few times.

    totals: one row of frames, faces, duration, tracks. tracks: video, face_id, left_pct, width_pct, colour, and
    optionally name and thumb. times: video, face_id, ts. The driver holds one page's tracks.
    """
    t = totals.first()
    keys = ["video", "face_id"]
    sampled = tracks.select(*keys).join(times, keys, "left").groupBy(*keys).agg(F.sort_array(F.collect_list("ts")).alias("times"))
    rows = written(numbered_whole(tracks.join(sampled, keys, "left"), keys, "place"), "report")
    n = rows.count()
    for page in range(max(1, -(-n // per_page))):
        first, last = page * per_page + 1, min(n, (page + 1) * per_page)
        out = [
            f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>",
            f"<p>{t.frames} frames, {t.faces} faces, {t.tracks} tracks, {t.duration or 0.0:.1f} s</p>",
        ]
        if n > per_page:
            out.append(f"<p>Tracks {first} to {last}, page {page + 1} of {-(-n // per_page)}</p>")
        for r in rows.where(F.col("place").between(first, last)).orderBy("place").collect():
            d = r.asDict()
            colour = "#%02x%02x%02x" % I.PALETTE[d["colour"]]
            name = html.escape(d.get("name") or f"track {d['face_id']}")
            picture = f"<img src='{d['thumb']}'>" if d.get("thumb") else ""
            at = ", ".join(f"{x:.1f}" for x in d["times"] or [])
            bar = f"<div style='margin-left:{d['left_pct']:.2f}%;width:{max(d['width_pct'], 0.2):.2f}%;background:{colour};height:8px'></div>"
            out.append(f"<section><h2>{d['video']} / {name}</h2>{picture}{bar}<p>{at}</p></section>")
        yield "\n".join([*out, "</body></html>"])


def benchmark_page(overview: list[dict], classes: DataFrame | None = None, failures: DataFrame | None = None) -> str:
    """A Markdown report: a table of algorithms; the ten worst classes (label, n, accuracy) and the first ten failures."""
    if not overview:
        return "# Recognition benchmark\n"
    heads = list(overview[0])
    out = ["# Recognition benchmark", "", "| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
    out += ["| " + " | ".join(f"{r[h]:.4f}" if isinstance(r[h], float) else str(r[h]) for h in heads) + " |" for r in overview]
    if classes is not None:
        out += ["", "## Worst classes", ""]
        out += [f"- {r.label}: {r.accuracy:.4f} of {r.n}" for r in classes.orderBy("accuracy", "label").limit(10).collect()]
    if failures is not None:
        out += ["", "## First failures", ""]
        out += [f"- {r.query_id}: {r.query_label} taken for {r.label}" for r in failures.orderBy("query_id").limit(10).collect()]
    return "\n".join(out) + "\n"
