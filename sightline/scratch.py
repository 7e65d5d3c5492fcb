"""Tables that cut lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, one is made under the temporary folder, for a local master only: a cluster's
    machines would not see each other's files there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sightline-")
    spark.conf.set("spark.checkpoint.dir", made)
    _remove_at_exit(spark, made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass

    atexit.register(remove)


#: By application: the folder of its written tables.
_FOLDERS: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/sightline-{app}-{uuid.uuid4().hex[:8]}"
        _remove_at_exit(spark, _FOLDERS[app])
    return _FOLDERS[app]


def written_at(df: DataFrame, tag: str = "table") -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again, and where it lies: for tables that are `removed` before the end."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors.

    Tables stay until the application ends or `clear` is called: results are lazy and may still read them.
    """
    return written_at(df, tag)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of written_at that nothing will read again."""
    _remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Removes the application's written tables; results that weren't written yet can't be read after it."""
    path = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if path is not None:
        _remove(spark, path)
