"""Documents in blocks, and questions from blocks to shards of a corpus-wide table.

Some operators need corpus-wide counts of the n-grams of each document. Joining every n-gram occurrence would move
many times the input. Instead documents are dealt by hash into blocks of some megabytes; a block asks each shard of the
key space once for all of its distinct keys, in one packed row, and the shard answers in the order of the keys. So the
rows moved are blocks x shards, the bytes some for each distinct key of a block, and no task holds more than a block or
a shard. Both numbers grow with the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 10 << 20
#: A packing task holds so much text before it writes its rows.
FLUSH_BYTES = 16 << 20


def trim() -> None:
    """Give freed memory back to the system, for workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def block_count(size: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, math.ceil(size / block_bytes))


def packed(df: DataFrame, by: Column, n_blocks: int, one_each: str | None = None, copies: str | None = None) -> DataFrame:
    """df as rows (block, blob): a blob holds the rows of one task that belong to a block, as compressed Arrow.

    one_each: a binary column; of rows that are equal in it each task sends one. So many copies never meet in a block.
    copies: the name of a column that says for how many rows that one stands; without it they are dropped."""
    names = df.columns
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        seen: dict[bytes, int] = {}

        def dealt() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            if copies:
                t = t.append_column(copies, pa.array(list(seen.values()), pa.int64()))
                seen.clear()
            return _dealt(t, [*names, copies] if copies else names)

        for batch in batches:
            if one_each:
                new = []
                for i, k in enumerate(batch.column(names.index(one_each)).to_pylist()):
                    if k not in seen:
                        new.append(i)
                    seen[k] = seen.get(k, 0) + 1
                batch = batch.take(pa.array(new, pa.int64()))
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()
        held = []
        trim()

    return df.select(*names, F.pmod(by, F.lit(n_blocks)).cast("int").alias("__block")).mapInArrow(run, schema)


def _dealt(t: pa.Table, names: list[str]) -> pa.RecordBatch:
    block = t.column("__block").to_numpy()
    t = t.select(names)
    order = np.argsort(block, kind="stable")
    ids, starts = np.unique(block[order], return_index=True)
    ends = [*starts[1:], len(order)]
    blobs = [_frozen(t.take(pa.array(order[a:b]))) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])


def _frozen(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for batch in t.combine_chunks().to_batches():
            w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(t: pa.Table) -> pa.Table:
    """The rows of a block."""
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in t.column("blob")])


def write_ints(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each as the bytes of one place after those of another, compressed."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if width else b""
        data = zstandard.ZstdCompressor(level=1).compress(planes)
        out += [len(a).to_bytes(8, "little"), width.to_bytes(1, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def read_ints(blob: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for _ in range(n):
        length, width, size = int.from_bytes(blob[at : at + 8], "little"), blob[at + 8], int.from_bytes(blob[at + 9 : at + 17], "little")
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 17 : at + 17 + size], max_output_size=max(1, length * width)), np.uint8) if width else None
        a = np.zeros((length, 8), np.uint8)
        if width:
            a[:, :width] = planes.reshape(width, length).T
        out.append(a.reshape(-1).view(np.uint64))
        at += 17 + size
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def undeltas(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the 64-bit hashes: grows with the hash, so that sorted hashes lie in runs of shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
