"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import built_on, discard, stored


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges, stored, and what tells one state of them from another, counted as they are written."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "components")
    found = seen.get
    return out, (found["n"], found["h"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and label (its component's smallest node) of every node with a link in edges. Neighbourhoods are only ever
    aggregated to their minimum, so no group is gathered; each round is written to the shared folder."""
    now, before = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = now
        now, after = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return built_on(now, now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots))
