"""Manifests, track files and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.functions import text as T

TRACK = (
    "struct<face_id:bigint,first_ts:double,last_ts:double,duration_secs:double,frame_count:bigint,name:string,sample_box:array<int>,"
    "gallery:array<double>,frames:array<struct<file_index:bigint,timestamp_secs:double,box:array<int>>>>"
)
TRACK_FILE = f"summary struct<total_unique_faces:bigint,merge_threshold:double,feature:string,face_size:array<int>,grid:array<int>>, tracks array<{TRACK}>"
MANIFEST = "index bigint, timestamp_secs double, frame_index bigint, file_name string, faces int, face_ids array<int>, boxes array<struct<x:int,y:int,w:int,h:int>>"
MANIFEST_HEAD = ("# manifest", "# format: index, timestamp_secs, frame_index, file_name, faces, face_ids, boxes (x,y,w,h;...), tab-separated")


def box_array(box: Column) -> Column:
    return F.array(*(box[c] for c in "xywh"))


def parse_manifest(lines: DataFrame, col: str = "value") -> DataFrame:
    """Rows of MANIFEST from lines of text; comment lines and blank lines are left out."""
    f = F.split(F.col(col), "\t")
    number = lambda c, k: F.split(c, ",")[k].try_cast("int").alias("xywh"[k])
    rows = lines.where(~F.col(col).startswith("#") & (F.trim(F.col(col)) != ""))
    ids = F.when(f[5] == "-", F.array().cast("array<int>")).otherwise(F.split(f[5], ",").cast("array<int>"))
    boxes = F.when(F.get(f, F.lit(6)) == "", F.array().cast("array<struct<x:int,y:int,w:int,h:int>>")).otherwise(
        F.transform(F.split(f[6], ";"), lambda b: F.struct(*(number(b, k) for k in range(4))))
    )
    return rows.select(
        f[0].try_cast("bigint").alias("index"), f[1].try_cast("double").alias("timestamp_secs"), f[2].try_cast("bigint").alias("frame_index"),
        f[3].alias("file_name"), f[4].try_cast("int").alias("faces"), ids.alias("face_ids"), boxes.alias("boxes"),
    )


def write_manifest(records: DataFrame, path: str) -> None:
    """records: index, ts, frame_idx, file_name, boxes, face_ids. A folder of text parts in order of index; the two
    comment lines lead the first part."""
    line = T.manifest_line(F.col("index"), F.col("ts"), F.col("frame_idx"), F.col("file_name"), F.col("boxes"), F.col("face_ids"))
    body = records.select(F.col("index").alias("at"), line.alias("value"))
    head = records.sparkSession.createDataFrame([(k - len(MANIFEST_HEAD), h) for k, h in enumerate(MANIFEST_HEAD)], "at bigint, value string")
    head.unionByName(body).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row per track of track files, with an explicit schema: an unnamed track has a null name."""
    return spark.read.schema(TRACK_FILE).json(path, multiLine=True).select(F.explode("tracks").alias("t")).select("t.*")


def track_rows(tracks: DataFrame) -> Column:
    """The struct of a track file's entry from face_id, first_ts, last_ts, frame_count, name, box, gallery, frames."""
    return F.struct(
        F.col("face_id").cast("bigint").alias("face_id"), "first_ts", "last_ts", (F.col("last_ts") - F.col("first_ts")).alias("duration_secs"),
        F.col("frame_count").cast("bigint").alias("frame_count"), "name", box_array(F.col("box")).alias("sample_box"), "gallery", "frames",
    )


def write_tracks(tracks: DataFrame, path: str) -> None:
    """One JSON object per line and track: a file that any number of tasks write and read."""
    tracks.select(track_rows(tracks).alias("t")).select("t.*").write.json(path, ignoreNullFields=True)


def read_track_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=StructType.fromDDL(TRACK_FILE)["tracks"].dataType.elementType)


def parse_labels(lines: DataFrame, col: str = "value", order: str = "line_no") -> DataFrame:
    """face_id, name from label lines; of lines with the same id the last one counts."""
    parts = T.label_line(F.col(col))
    rows = lines.select(parts["face_id"].alias("face_id"), parts["name"].alias("name"), F.col(order).alias("at")).where("face_id IS NOT NULL")
    return rows.groupBy("face_id").agg(F.max_by("name", "at").alias("name"))


def http_head(head: Column) -> dict[str, Column]:
    """Status (0 if unreadable) and Content-Length (null if absent) of a response's header."""
    return {
        "status": F.coalesce(F.regexp_extract(head, r"^[^ \r\n]* +([0-9]+)", 1).try_cast("int"), F.lit(0)),
        "length": F.regexp_extract(head, r"(?im)^content-length:[ \t]*([0-9]+)", 1).try_cast("bigint"),
    }
