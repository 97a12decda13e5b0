"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each segment of the rows posts its vectors, with the pivot's
rank, to one inverted file a pivot; a query reads the files of its own nearest pivots and so gets Spearman's footrule
between the truncated permutations (a pivot that one side lacks has the rank after the last). The share of a segment
with the smallest footrule, ties included, and every row whose permutation agrees with the query's by NEAR or more (so
that a large group of near-equal vectors is searched whole) are then ranked by the exact cosine in double precision.

Pivots are fitted on a bounded sample (SAMPLE rows by hash) for the FITTED most frequent vector lengths, and drawn at random
for others; every row is indexed. Segments have at most about segment_rows rows and meet queries in blocks of at most about
query_rows, so a task holds one of each, and a row is copied once for so many queries. Work grows as queries x rows, as the
question does, but for the largest part in small-integer additions: lists of the nearest pivots alone, which would let a
query leave segments out, need 39 % of all rows to find nine of ten neighbours in vectors without clusters (256 pivots, each
row in 8 lists, each query reading 16), so they save less than shipping them costs.

Cases: vectors that are null, zero, or hold nulls, NaN or infinities take no part, nor do rows without an id; very large and
very small components are scaled by a power of two first, so no square over- or underflows; vectors of different lengths
never meet, and long ones only make a task's rows longer; rows with the same id and vector count once, and a query's own id
is no candidate; ties go to the smaller id; with fewer than k candidates all are returned; empty tables give empty results;
other columns are not read, so none can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX, SAMPLE = 256, 64, 1024
#: So many vector lengths, the most frequent, have pivots from the sample.
FITTED = 16
SEGMENT_ROWS = QUERY_ROWS = 32768
#: Small tables are cut to segments of so many rows, if there are cores for them.
FEW_ROWS = 4096
SHARE = 0.12
#: Of the agreement of equal permutations.
NEAR = 0.5
#: A segment's candidates are so many at least.
LEAST = 256


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows with their largest components between a half and one; no other bit changes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def random_pivots(dim: int, m: int) -> np.ndarray:
    x = np.random.default_rng(dim).normal(size=(m, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(sample: np.ndarray, m: int, alike: float = 0.9) -> np.ndarray:
    """Up to m directions of the sample, in its order; those alike one that is taken already only if too few are left."""
    if not len(sample):
        return sample
    unit = scaled(sample)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    taken: list[int] = []
    rest: list[int] = []
    for i, v in enumerate(unit):
        if len(taken) == m:
            break
        near = (unit[taken] @ v).max() if taken else -1.0
        if near < alike:
            taken.append(i)
        elif near < 1 - 1e-9:
            rest.append(i)
    return unit[taken + rest[: m - len(taken)]]


class Index:
    """The inverted files of a segment."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.pivots, self.prefix, self.n = pivots, min(prefix, len(pivots)), len(vectors)
        near = self.nearest(vectors)
        pivot, row = near.ravel(), np.repeat(np.arange(self.n, dtype=np.int32), self.prefix)
        rank = np.tile(np.arange(self.prefix, dtype=np.int16), self.n)
        order = np.argsort(pivot, kind="stable")
        self.rows, self.ranks = row[order], rank[order]
        self.cut = np.searchsorted(pivot[order], np.arange(len(pivots) + 1))

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Row by row, the pivots with the largest cosine, nearest first."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.argsort(-(unit @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]

    def agreement(self, near: np.ndarray) -> np.ndarray:
        """How much less than the largest footrule the distance of each row is: 2 (prefix - the later rank) a shared pivot."""
        out = np.zeros(self.n, np.int32)
        for rank, pivot in enumerate(near):
            a, b = self.cut[pivot], self.cut[pivot + 1]
            out[self.rows[a:b]] += 2 * (self.prefix - np.maximum(self.ranks[a:b], rank))
        return out


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of one vector with rows: sums row by row, so that equal rows have equal values wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def _search(pivots: dict[int, np.ndarray], n_pivots: int, prefix: int, share: float, least: int, k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            dim = key[0].as_py()

            def matrix(t: pa.Table, ids: str, name: str):
                x = np.concatenate([c.flatten().to_numpy() for c in t.column(name).chunks]).astype(np.float64).reshape(-1, dim)
                return t.column(ids).to_numpy(), scaled(x)

            ids, x = matrix(rows, "id", "x")
            order = np.lexsort((*x.T[:1], ids))
            ids, x = ids[order], x[order]
            again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(axis=1)])
            ids, x = ids[~again], x[~again]
            q_ids, q = matrix(queries, "q", "qx")
            index = Index(x, pivots[dim] if dim in pivots else random_pivots(dim, n_pivots), prefix)
            want = max(least, math.ceil(share * len(ids)))
            near_cut = NEAR * index.prefix * (index.prefix + 1)
            for i, near in enumerate(index.nearest(q)):
                agree = index.agreement(near)
                cut = min(np.partition(agree, -want)[-want], near_cut) if want < len(ids) else 0
                at = np.flatnonzero((agree >= cut) & (ids != q_ids[i]))
                score = cosine(q[i], x[at])
                if len(at) > k:
                    some = score >= np.partition(score, -k)[-k]
                    at, score = at[some], score[some]
                best = np.lexsort((ids[at], -score))[:k]
                out += [(int(q_ids[i]), int(ids[at[j]]), float(score[j])) for j in best]
        a, b, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, segment_rows: int = SEGMENT_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest rows found for each row that is_query."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.size(x).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    counts = lengths.orderBy(F.desc("n"), "dim").limit(FITTED).collect()
    pivots = {}
    for c in counts:
        sample = rows.filter(F.col("dim") == c["dim"]).orderBy(F.xxhash64("id", "x"), "id").limit(SAMPLE).select("x").collect()
        pivots[c["dim"]] = pivots_of(np.array([r["x"] for r in sample], np.float64), n_pivots)
    most = lengths.agg(F.max("n").alias("n"), F.max("q").alias("q")).first()
    largest, asked = most["n"] or 1, most["q"] or 1
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    segments, blocks = max(math.ceil(largest / segment_rows), min(cores, math.ceil(largest / FEW_ROWS))), math.ceil(asked / query_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # equal ids share a segment; a segment meets each block of queries
    left = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int").alias("segment"), every(blocks).alias("part"), "id", "x")
    right = rows.filter("asks").select(F.col("dim").alias("qdim"), every(segments).alias("qsegment"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("qpart"), F.col("id").alias("q"), F.col("x").alias("qx"))
    found = left.groupBy("dim", "segment", "part").cogroup(right.groupBy("qdim", "qsegment", "qpart")).applyInArrow(_search(pivots, n_pivots, prefix, share, LEAST, k), "query_id long, vec_id long, score double")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
