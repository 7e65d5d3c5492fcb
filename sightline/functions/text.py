"""Names, times, urls and tables of a run, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_stamp(seconds: Column) -> Column:
    """HHh-MMm-SSs-mmmms, milliseconds rounded half up."""
    ms = F.round(seconds * 1000).cast("bigint")
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    hours = F.floor(ms / 3600000)
    # hours may need more than two digits
    return F.concat(
        F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string")), F.lit("h-"), part(F.floor(ms / 60000) % 60, 2), F.lit("m-"),
        part(F.floor(ms / 1000) % 60, 2), F.lit("s-"), part(ms % 1000, 3), F.lit("ms"),
    )


def padded(number: Column, width: int) -> Column:
    """Zero-padded; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def frame_name(index: Column, seconds: Column) -> Column:
    return F.concat(padded(index, 4), F.lit("_"), time_stamp(seconds), F.lit(".png"))


def crop_name(index: Column, seconds: Column, face: Column) -> Column:
    return F.concat(padded(index, 4), F.lit("_"), time_stamp(seconds), F.lit("_face"), padded(face, 2), F.lit(".png"))


def frame_number(path: Column) -> Column:
    """Digits after the last underscore of the file's stem; null where there are none."""
    return F.regexp_extract(path, r"_([0-9]{1,18})\.[^./]*$", 1).try_cast("bigint")


def written_seconds(path: Column) -> Column:
    """Seconds from a name that frame_name made; null for others."""
    found = lambda k: F.regexp_extract(path, r"([0-9]+)h-([0-9]{2})m-([0-9]{2})s-([0-9]{3})ms", k).try_cast("bigint")
    return (found(1) * 3600000 + found(2) * 60000 + found(3) * 1000 + found(4)) / 1000.0


def seconds_of(number: Column, fps: float = 1.0) -> Column:
    """Frames are numbered from 1."""
    return (number - 1) / F.lit(float(fps))


def safe_name(name: Column) -> Column:
    """Characters that file systems refuse become underscores."""
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "_")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_frame_file(path: Column) -> Column:
    return extension(path).isin("pgm", "ppm", "png")


def url_parts(url: Column) -> dict[str, Column]:
    """host, port (80, or 443 for https, where none is given) and path of an http or https url; null for others."""
    pattern = r"^(https?)://([^/:]*)(?::([^/]*))?(/.*)?$"
    part = lambda k: F.regexp_extract(url, pattern, k)
    ok = url.rlike(pattern)
    default = F.when(part(1) == "https", 443).otherwise(80)
    port = part(3).try_cast("int")
    return {
        "host": F.when(ok, part(2)),
        "port": F.when(ok, F.when((port >= 0) & (port <= 65535), port).otherwise(default)),
        "path": F.when(ok, F.when(part(4) == "", "/").otherwise(part(4))),
    }


def url_file_name(url: Column) -> Column:
    """The last part of the path, up to ? or &; `download` where it is empty."""
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"/([^/]*)$", 1)
    name = F.regexp_extract(last, r"^([^?&]*)", 1)
    return F.when(last == "", "download").otherwise(name)


def label_line(line: Column) -> dict[str, Column]:
    """face_id and name of `id: name` or `id = name`; null for blank lines, comments and others."""
    pattern = r"^\s*([0-9]+)\s*[:=]\s*(.*?)\s*$"
    ok = line.rlike(pattern) & ~line.rlike(r"^\s*#")
    return {"face_id": F.when(ok, F.regexp_extract(line, pattern, 1).try_cast("bigint")), "name": F.when(ok, F.regexp_extract(line, pattern, 2))}


def fixed(number: Column, places: int) -> Column:
    """Decimal text with so many places."""
    return number.cast(f"decimal(30,{places})").cast("string")


def boxes_text(boxes: Column) -> Column:
    """x,y,w,h;x,y,w,h;..."""
    return F.array_join(F.transform(boxes, lambda b: F.concat_ws(",", *(b[c].cast("string") for c in "xywh"))), ";")


def manifest_line(index: Column, seconds: Column, number: Column, name: Column, boxes: Column, face_ids: Column) -> Column:
    """Tab-separated: index, seconds, frame number, file, faces, face ids (or -), boxes."""
    ids = F.when(F.size(face_ids) == 0, "-").otherwise(F.array_join(face_ids.cast("array<string>"), ","))
    return F.concat_ws("\t", index.cast("string"), fixed(seconds, 3), number.cast("string"), name, F.size(boxes).cast("string"), ids, boxes_text(boxes))


def recognition_line(index: Column, seconds: Column, name: Column, person: Column, confidence: Column, box: Column) -> Column:
    return F.concat_ws("\t", index.cast("string"), fixed(seconds, 3), name, person, fixed(confidence, 3), boxes_text(F.array(box)))


def civil_time(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DD HH:MM:SS UTC, without the session's time zone.

    Years from 10000 on have all their digits and no sign; those before year 0 have a minus and no zeros in front.
    """
    whole = F.floor(seconds).cast("bigint")
    rest = F.pmod(whole, F.lit(86400))  # of the day
    day = F.date_from_unix_date(((whole - rest) / 86400).cast("int"))
    two = lambda v: F.lpad(v.cast("int").cast("string"), 2, "0")
    year = F.year(day)
    year = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    date = F.concat_ws("-", year, two(F.month(day)), two(F.day(day)))
    at = F.concat_ws(":", two(rest / 3600), two(rest % 3600 / 60), two(rest % 60))
    return F.when(whole.isNotNull(), F.concat_ws(" ", date, at))
