"""What the corpus operators share: the shared folder, tokens, and small checked collections."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Paths that stored() has written and nobody has discarded, with their sessions.
_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where none is set a temporary one
    serves a local master, whose executor is the driver; any other master is an error."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None) or (jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def _shuffles_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors. The
    shuffle files of the job go when it ends, the table with discard() or at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    with _shuffles_end_with_the_job(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def built_on(table: DataFrame, out: DataFrame) -> DataFrame:
    """out, for which discard() deletes the table of stored() that it reads."""
    out._lattica_path = getattr(table, "_lattica_path", None)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of stored() that no later job reads."""
    for t in tables:
        path = getattr(t, "_lattica_path", None)
        spark = _written.pop(path, None) if path else None
        if spark is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Delete what stored() has written, once no DataFrame built on it is needed any more."""
    while _written:
        path, spark = _written.popitem()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended already; its folder goes with it
            return


atexit.register(release)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_in(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of UTF-8 texts, A-Z lower-cased: numbers of the words of all texts in turn, where each
    text's words begin (and, last, end), and the distinct words by number. Nulls have no words."""
    whole = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    whole = whole.fill_null(b"")
    kind = pa.large_string() if pa.types.is_large_binary(whole.type) else pa.string()
    plain = pa.Array.from_buffers(kind, len(whole), whole.buffers(), offset=whole.offset)  # bytes are not checked
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(plain))  # with an empty one at either end of white space
    found = pieces.flatten()
    full = pc.greater(pc.binary_length(found), 0)
    starts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
    words = found.filter(full).dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, words.dictionary.cast(pa.large_binary() if kind == pa.large_string() else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads them evenly (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """collect() of a table that must be small: more than limit rows are an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows
