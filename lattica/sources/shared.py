"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set a temporary folder serves a local master, whose executor is
    the driver; any other master is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="lattica-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted at exit."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialised(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes what materialised() and scratch() name, once no DataFrame built on it is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended already; its folder goes with it
            return


atexit.register(release)
