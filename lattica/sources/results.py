"""The table of results of profiling runs.

A run is a row; APPEND adds it, OVERWRITE moves the old table aside under a time stamp first. It is a
Spark table in Parquet or CSV, in any file system that Spark writes.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The columns of the results file, in its order.
SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.StringType()),
        T.StructField("Dataset", T.StringType()),
        T.StructField("Columns", T.IntegerType()),
        T.StructField("Rows", T.LongType()),
        T.StructField("ConfigName", T.StringType()),
        T.StructField("Algorithm", T.StringType()),
        T.StructField("FD_Count", T.IntegerType()),
        T.StructField("Validation_Count", T.LongType()),
        T.StructField("ExecutionTime_ms", T.LongType()),
        T.StructField("PeakMemory_MB", T.LongType()),
        T.StructField("PLI_Stats", T.StringType()),
        T.StructField("Status", T.StringType()),
        T.StructField("ErrorMessage", T.StringType()),
    ]
)
STAMP = "%Y-%m-%d %H:%M:%S"


@dataclass
class RunResult:
    dataset: str
    config: str
    algorithm: str
    status: str = "SUCCESS"
    columns: int | None = None
    rows: int | None = None
    fd_count: int | None = None
    validations: int | None = None
    execution_ms: int | None = None
    memory_mb: int | None = None
    stats: str = "N/A"
    message: str = ""
    finished: str = ""

    def row(self) -> tuple:
        """In the order of SCHEMA. Commas in texts become semicolons, as spreadsheets expect."""
        plain = lambda s: s.replace(",", ";").replace("\n", " ")
        return (self.finished or dt.datetime.now().strftime(STAMP), plain(self.dataset), self.columns, self.rows, self.config, self.algorithm, self.fd_count, self.validations, self.execution_ms, self.memory_mb, plain(self.stats), self.status, plain(self.message))


class ResultsTable:
    def __init__(self, spark: SparkSession, path: str, mode: str = "APPEND", fmt: str = "csv"):
        if mode not in ("APPEND", "OVERWRITE"):
            raise ValueError("the mode is APPEND or OVERWRITE")
        if fmt not in ("csv", "parquet"):
            raise ValueError("the format is csv or parquet")
        self.spark, self.path, self.fmt = spark, path, fmt
        if mode == "OVERWRITE":
            self.backup = self._set_aside()

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        at, fs = self._fs()
        return fs.exists(at)

    def _set_aside(self) -> str | None:
        if not self.exists():
            return None
        at, fs = self._fs()
        to = f"{self.path}.{dt.datetime.now():%Y%m%d-%H%M%S-%f}"
        fs.rename(at, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to))
        return to

    def write(self, result: RunResult) -> None:
        df = self.spark.createDataFrame([result.row()], SCHEMA).coalesce(1)
        writer = df.write.mode("append")
        writer.option("header", True).csv(self.path) if self.fmt == "csv" else writer.parquet(self.path)

    def write_error(self, dataset: str, config: str, algorithm: str, message: str) -> None:
        self.write(RunResult(dataset, config, algorithm, "FAILURE", message=message))

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], SCHEMA)
        reader = self.spark.read.schema(SCHEMA)
        return reader.option("header", True).csv(self.path) if self.fmt == "csv" else reader.parquet(self.path)

    def has(self, dataset: str, config: str, algorithm: str) -> bool:
        done = self.read().filter("Status = 'SUCCESS'")
        key = RunResult(dataset, config, algorithm).row()
        return bool(done.filter((done.Dataset == key[1]) & (done.ConfigName == config) & (done.Algorithm == algorithm)).take(1))

    def pending(self, runs: DataFrame) -> DataFrame:
        """The runs (Dataset, ConfigName, Algorithm) that have no successful row yet."""
        return runs.join(self.read().filter("Status = 'SUCCESS'"), ["Dataset", "ConfigName", "Algorithm"], "left_anti")
