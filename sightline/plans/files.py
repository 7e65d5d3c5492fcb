"""Names, times, manifests, track files, labels and checksums."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from sightline.functions import text as T
from sightline.operators.tracks import name_tracks as name_them
from sightline.sources import codecs, records
from sightline.tables import table

from .images import SIDE, images
from .registry import query
from .tracks import _D, _NUMBER, _STATS, _numbered, detections, frames, track_stats


def _seconds(spark, sf_dir):
    """event_id and seconds with many digits."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1234567 % 400000000 / 1000.0).alias("s"))


_S = "SELECT event_id, (event_id * 1234567 % 400000000) / 1000.0 AS s, (event_id * 1234567 % 400000000) AS ms FROM events"
_STAMP = """(CASE WHEN ms // 3600000 < 100 THEN lpad((ms // 3600000)::VARCHAR, 2, '0') ELSE (ms // 3600000)::VARCHAR END) || 'h-' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0')
 || 'm-' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's-' || lpad((ms % 1000)::VARCHAR, 3, '0') || 'ms'"""
_PAD4 = "CASE WHEN length(event_id::VARCHAR) >= 4 THEN event_id::VARCHAR ELSE lpad(event_id::VARCHAR, 4, '0') END"


@query("ts_format", f"SELECT event_id, {_STAMP} AS stamp FROM ({_S})")
def ts_format(spark, sf_dir):
    return _seconds(spark, sf_dir).select("event_id", T.time_stamp(F.col("s")).alias("stamp"))


@query("file_name_build", f"SELECT event_id, {_PAD4} || '_' || {_STAMP} || '.png' AS frame, {_PAD4} || '_' || {_STAMP} || '_face' || lpad((event_id % 7)::VARCHAR, 2, '0') || '.png' AS crop FROM ({_S})")
def file_name_build(spark, sf_dir):
    i, s = F.col("event_id"), F.col("s")
    return _seconds(spark, sf_dir).select(i, T.frame_name(i, s).alias("frame"), T.crop_name(i, s, i % 7).alias("crop"))


@query("file_name_parse", f"SELECT event_id, round(ms / 1000.0, 3)::DOUBLE AS seconds, event_id AS number, ((event_id - 1) / 2.0)::DOUBLE AS at FROM ({_S})")
def file_name_parse(spark, sf_dir):
    """Names that were built, read again; frame numbers at two frames a second."""
    i, s = F.col("event_id"), F.col("s")
    named = _seconds(spark, sf_dir).select(i, T.frame_name(i, s).alias("out"), F.concat(F.lit("/v/frame_"), T.padded(i, 6), F.lit(".pgm")).alias("path"))
    number = T.frame_number(F.col("path"))
    return named.select(i, F.round(T.written_seconds(F.col("out")), 3).alias("seconds"), number.alias("number"), T.seconds_of(number, 2.0).alias("at"))


@query("extension_filter", "SELECT event_id FROM events WHERE event_id % 5 IN (0, 1, 3)")
def extension_filter(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("a.pgm", "a.b.PPM", "a.jpg", "x/y.png", "pgm"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").where(T.is_frame_file(names)).select("event_id")


@query("sanitize_names", r"""SELECT p_partkey, regexp_replace(p_name || '/' || p_type || ':*?"<>|\', '[/\\:*?"<>|]', '_', 'g') AS name FROM part""")
def sanitize_names(spark, sf_dir):
    raw = F.concat(F.col("p_name"), F.lit("/"), F.col("p_type"), F.lit(':*?"<>|\\'))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_name(raw).alias("name"))


_U = r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^(https?://[^/]*)/', '\1:8080/') WHEN 2 THEN regexp_extract(url, '^https?://[^/]*') ELSE replace(url, 'http', 'ftp') END AS u FROM pages),
p AS (SELECT page_id, u, regexp_matches(u, '^(https?)://([^/:]*)(?::([^/]*))?(/.*)?$') AS ok, regexp_extract(u, '^(https?)://([^/:]*)(?::([^/]*))?(/.*)?$', ['scheme', 'host', 'port', 'path']) AS m FROM u)
"""


@query(
    "url_parts",
    _U + """SELECT page_id, CASE WHEN ok THEN m.host END AS host, CASE WHEN ok THEN coalesce(try_cast(m.port AS INT), CASE WHEN m.scheme = 'https' THEN 443 ELSE 80 END) END AS port,
  CASE WHEN ok THEN CASE WHEN m.path = '' THEN '/' ELSE m.path END END AS path,
  CASE WHEN regexp_extract(regexp_replace(u, '/+$', ''), '/([^/]*)$', 1) = '' THEN 'download' ELSE regexp_extract(regexp_extract(regexp_replace(u, '/+$', ''), '/([^/]*)$', 1), '^([^?&]*)', 1) END AS file FROM p""",
)
def url_parts(spark, sf_dir):
    k, url = F.col("page_id") % 4, F.col("url")
    u = F.when(k == 0, url).when(k == 1, F.regexp_replace(url, "^(https?://[^/]*)/", "$1:8080/")).when(k == 2, F.regexp_extract(url, "^https?://[^/]*", 0)).otherwise(F.replace(url, F.lit("http"), F.lit("ftp")))
    rows = table(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    return rows.select("page_id", *(c.alias(n) for n, c in T.url_parts(F.col("u")).items()), T.url_file_name(F.col("u")).alias("file"))


@query("http_heads", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE (200 + page_id % 7)::INT END AS status, CASE WHEN page_id % 2 = 0 THEN length(html) END AS length FROM pages")
def http_heads(spark, sf_dir):
    i = F.col("page_id")
    first = F.when(i % 3 == 0, F.lit("garbage")).otherwise(F.concat(F.lit("HTTP/1.1 "), (200 + i % 7).cast("string"), F.lit(" OK")))
    more = F.when(i % 2 == 0, F.concat(F.lit("\r\ncontent-LENGTH: "), F.length("html").cast("string"))).otherwise("\r\nX-Content-Length: 9")
    heads = table(spark, sf_dir, "pages").select(i, F.concat(first, more, F.lit("\r\n\r\n")).alias("head"))
    parsed = records.http_head(F.col("head"))
    return heads.select(i, parsed["status"].alias("status"), parsed["length"].alias("length"))


@query("civil_time", "SELECT event_id, strftime(TIMESTAMP '1970-01-01' + to_seconds(event_id * 86413), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def civil_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.civil_time(F.col("event_id") * 86413).alias("at"))


@query("base64_crc", "SELECT p_partkey, to_base64((p_name || p_type)::BLOB) AS b64 FROM part")
def base64_of(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.base64(F.concat("p_name", "p_type").cast("binary")).alias("b64"))


#: Both sums bit by bit, and byte by byte, over the text's UTF-8 bytes.
_CHECKSUMS = """
WITH n AS (SELECT p_partkey, [('0x' || substr(hex(encode(p_name)), 2 * i - 1, 2))::BIGINT for i in range(1, octet_length(encode(p_name)) + 1)] AS bytes FROM part)
SELECT p_partkey,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc,
  (len(bytes) + list_sum([bytes[i] * (len(bytes) - i + 1) for i in range(1, len(bytes) + 1)])::BIGINT) % 65521 * 65536 + (1 + list_sum(bytes)::BIGINT) % 65521 AS adler
FROM n
"""


@query("checksums", _CHECKSUMS)
def checksums(spark, sf_dir):
    """CRC-32 beside Adler-32."""

    @F.pandas_udf("bigint")
    def adler(values: pd.Series) -> pd.Series:
        return values.map(lambda v: zlib.adler32(v.encode()))

    return table(spark, sf_dir, "part").select("p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("crc"), adler(F.col("p_name")).alias("adler"))


@query("labels_parse", """SELECT c_custkey // 2 * 2 AS face_id, arg_max(trim(c_name) || ' x', c_custkey) AS name FROM customer WHERE c_custkey % 3 <> 1 GROUP BY 1""")
def labels_parse(spark, sf_dir):
    """Lines `id: name` and `id = name`, with comments and blank lines between; a later line of an id wins."""
    i = F.col("c_custkey")
    even = (F.floor(i / 2) * 2).cast("string")
    line = F.when(i % 3 == 1, F.concat(F.lit("# "), even, F.lit(": no"))).when(i % 3 == 0, F.concat(F.lit("  "), even, F.lit(": "), "c_name", F.lit(" x  "))).otherwise(F.concat(even, F.lit(" ="), "c_name", F.lit(" x")))
    lines = table(spark, sf_dir, "customer").select(i.alias("line_no"), line.alias("value"))
    return records.parse_labels(lines)


@query("name_tracks", _D + _STATS + "SELECT st.video, face_id, frame_count, c_name AS name FROM st LEFT JOIN (SELECT c_custkey AS face_id, c_name FROM customer WHERE c_custkey % 2 = 0) USING (face_id)")
def name_tracks(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("face_id"), F.col("c_name").alias("name"))
    return name_them(track_stats(spark, sf_dir), labels).select("video", "face_id", "frame_count", "name")


_MANIFEST = _D + """, b AS (SELECT video, idx, string_agg(x || ',' || y || ',' || w || ',' || h, ';' ORDER BY pos) AS boxes, string_agg(face_id::VARCHAR, ',' ORDER BY pos) AS ids FROM d GROUP BY ALL)
SELECT f.video, f.idx, f.idx || chr(9) || (f.ts::DECIMAL(30,3))::VARCHAR || chr(9) || (f.idx + 7) || chr(9) || 'frame_' || f.idx || '.png' || chr(9) || f.faces || chr(9) || coalesce(ids, '-') || chr(9) || coalesce(boxes, '') AS line
FROM f LEFT JOIN b USING (video, idx)"""


def _manifest(spark, sf_dir):
    name = F.concat(F.lit("frame_"), F.col("idx").cast("string"), F.lit(".png"))
    boxes, ids = F.transform("faces", lambda f: f["box"]), F.transform("faces", lambda f: f["face_id"])
    line = T.manifest_line(F.col("idx"), F.col("ts"), F.col("idx") + 7, name, boxes, ids)
    return frames(spark, sf_dir).select("video", "idx", line.alias("line"))


@query("manifest_rows", _MANIFEST)
def manifest_rows(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query("manifest_parse", _D + "SELECT f.idx, f.ts, f.idx + 7 AS frame_index, f.faces::INT AS faces, coalesce(sum(x), 0)::BIGINT AS sum_x, coalesce(sum(face_id), 0)::BIGINT AS sum_ids FROM f LEFT JOIN d USING (video, idx) GROUP BY ALL".replace("f.ts,", "any_value(f.ts) AS ts,").replace("GROUP BY ALL", "GROUP BY f.video, f.idx, f.faces"))
def manifest_parse(spark, sf_dir):
    """Manifest lines read back into typed rows."""
    rows = records.parse_manifest(_manifest(spark, sf_dir), "line")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return rows.select("index", F.col("timestamp_secs").alias("ts"), "frame_index", "faces", total(F.transform("boxes", lambda b: b["x"])).alias("sum_x"), total("face_ids").alias("sum_ids")).withColumnRenamed("index", "idx")


@query("recognition_manifest", _D + "SELECT video, idx, pos, idx || chr(9) || (ts::DECIMAL(30,3))::VARCHAR || chr(9) || 'f.pgm' || chr(9) || 'p' || face_id || chr(9) || (((idx % 1000) / 1000.0)::DECIMAL(30,3))::VARCHAR || chr(9) || x || ',' || y || ',' || w || ',' || h AS line FROM d")
def recognition_manifest(spark, sf_dir):
    line = T.recognition_line(F.col("idx"), F.col("ts"), F.lit("f.pgm"), F.concat(F.lit("p"), F.col("face_id").cast("string")), F.col("idx") % 1000 / 1000.0, F.col("box"))
    return detections(spark, sf_dir).select("video", "idx", "pos", line.alias("line"))


_JSON = _D + _NUMBER + """SELECT video, face_id, (number - 1) // 1000 AS part, '{"face_id":' || face_id || ',"frame_count":' || max(n) || ',"frames":[' || string_agg('{"file_index":' || idx || ',"box":[' || x || ',' || y || ',' || w || ',' || h || ']}', ',' ORDER BY idx, pos) || ']}' AS json
FROM nu GROUP BY video, face_id, part"""


def _tracks_json(spark, sf_dir):
    """Tracks as JSON, an entry for each thousand frames, so that no row grows with its track."""
    n = track_stats(spark, sf_dir).select("video", "face_id", "frame_count")
    rows = _numbered(spark, sf_dir).withColumn("part", F.floor((F.col("number") - 1) / 1000)).join(n, ["video", "face_id"])
    frame = F.struct("number", F.col("idx").alias("file_index"), records.box_array(F.col("box")).alias("box"))
    per = rows.groupBy("video", "face_id", "part", "frame_count").agg(F.array_sort(F.collect_list(frame)).alias("f"))
    entry = F.struct("face_id", "frame_count", F.transform("f", lambda f: F.struct(f["file_index"].alias("file_index"), f["box"].alias("box"))).alias("frames"))
    return per.select("video", "face_id", "part", F.to_json(entry).alias("json"))


@query("tracks_json", _JSON)
def tracks_json(spark, sf_dir):
    return _tracks_json(spark, sf_dir)


@query("tracks_json_read", _D + _NUMBER + "SELECT video, face_id, n AS frame_count, idx AS file_index, x, h FROM nu")
def tracks_json_read(spark, sf_dir):
    """Track JSON parsed with an explicit schema and taken apart again."""
    parsed = _tracks_json(spark, sf_dir).select("video", F.from_json("json", records.TRACK).alias("t"))
    return parsed.select("video", "t.face_id", "t.frame_count", F.explode("t.frames").alias("f")).select(
        "video", F.col("face_id").cast("int").alias("face_id"), "frame_count", "f.file_index", F.col("f.box")[0].alias("x"), F.col("f.box")[3].alias("h")
    )


@query("image_codecs", f"SELECT p_partkey AS img, {SIDE * SIDE + 13}::INT AS pgm_bytes, true AS pgm_same, true AS png_same FROM part")
def image_codecs(spark, sf_dir):
    """Each generated image written as PGM and PNG, read again, and compared."""
    from sightline.functions.imaging import per_image

    def run(image, row):
        pgm = codecs.write_pgm(image)
        same = bool((codecs.read_pgm(pgm) == image).all())
        return [{"img": row["img"], "pgm_bytes": len(pgm), "pgm_same": same, "png_same": bool((codecs.read_png_stored(codecs.write_png(image)) == image).all())}]

    return per_image(images(spark, sf_dir), run, "img bigint, pgm_bytes int, pgm_same boolean, png_same boolean", ["img"])
