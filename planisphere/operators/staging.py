"""Tables written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; in a local session that names none, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="planisphere-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/staged/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder. `discard` deletes it. rows_per_file: at most, if any."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables that `stage` returned and nothing will read again."""
    for df in staged:
        path = _paths.pop(df, None)
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(conf).delete(at, True)
