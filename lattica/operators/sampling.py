"""Row samples: simple random, focused on clusters, and Neyman-allocated; and errors estimated from them.

Draws are by the MD5 of seed and row id, so a sample is a function of the data and the seed, whatever the partitioning,
and any SQL engine draws the same. No draw ranks the whole table in one task: the smallest m are top-m of each task, and
quotas rank inside a cluster, after each task has dropped what is beyond the largest quota.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import materialised
from .measures import Measure, conflict_variance, measure_named
from .partitions import check_columns, partition

SEED = 114514


def sample_size(n: int, param: float) -> int:
    """Under 1 a share, else a number of rows; never more than n."""
    if param <= 0:
        raise ValueError("a sample needs a positive size")
    return math.floor(n * param) if param < 1 else min(int(param), n)


def draw_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


@dataclass
class Sample:
    """rows: the sampled rows of the table. size: how many were asked for, by which estimates are scaled."""

    rows: DataFrame
    size: int
    total_rows: int
    info: dict = field(default_factory=dict)


#: A sampling plug-in: (table, id column, X, A, size parameter, seed) -> Sample.
Strategy = Callable[..., Sample]


def sample_random(df: DataFrame, id_col: str, lhs: Sequence[str] = (), rhs: str | None = None, param: float = 200, seed: int = SEED, total_rows: int | None = None) -> Sample:
    """m rows without replacement. Top-m per task, then of those: no global sort."""
    n = df.count() if total_rows is None else total_rows
    m = sample_size(n, param)
    return Sample(df.orderBy(draw_key(id_col, seed), id_col).limit(m), m, n, {"strategy": "random", "asked": m})


def _with_clusters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of clusters of two and more, with the cluster's rows as __size."""
    sizes = partition(df, columns).filter("cluster_size > 1").select(*[F.col(c).alias(f"__{c}") for c in columns], F.col("cluster_size").alias("__size"))
    return df.join(sizes, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]).drop(*[f"__{c}" for c in columns])


def _first(df: DataFrame, columns: Sequence[str], id_col: str, seed: int, quota: Column, most: int) -> DataFrame:
    """The first `quota` rows of each cluster by draw, `most` at most: that bound is a constant, so Spark applies it before
    the shuffle, too (WindowGroupLimit), and a hot cluster moves at most so many rows from each task."""
    order = F.row_number().over(Window.partitionBy(*columns).orderBy(draw_key(id_col, seed), id_col))
    return df.withColumn("__quota", quota).filter("__quota > 0").withColumn("__at", order).filter(F.col("__at") <= most).filter("__at <= __quota").drop("__at", "__quota")


def focused_quota(size: Column, total: int, m: int) -> Column:
    """All if the clusters hold no more than m rows; else a proportional share, rounded half up, one at least."""
    if total <= m:
        return size
    return F.least(F.greatest(F.floor(size / F.lit(float(total)) * F.lit(float(m)) + 0.5), F.lit(1)), size)


def sample_focused(df: DataFrame, id_col: str, lhs: Sequence[str], rhs: str | None = None, param: float = 200, seed: int = SEED, total_rows: int | None = None) -> Sample:
    """Stratified by the clusters of lhs; rows alone are left out."""
    check_columns(df, lhs)
    n = df.count() if total_rows is None else total_rows
    m = sample_size(n, param)
    total = partition(df, lhs).filter("cluster_size > 1").agg(F.coalesce(F.sum("cluster_size"), F.lit(0))).first()[0]
    rows = _with_clusters(df, lhs)
    rows = rows if total <= m else _first(rows, lhs, id_col, seed, focused_quota(F.col("__size"), total, m), max(1, m))
    return Sample(rows.drop("__size"), m, n, {"strategy": "focused", "asked": m, "clustered_rows": total})


def pilot(df: DataFrame, id_col: str, columns: Sequence[str], seed: int = SEED, most: int = 20) -> DataFrame:
    """min(most, floor(sqrt(size))) rows of each cluster."""
    rows = _with_clusters(df, columns)
    quota = F.least(F.lit(most), F.floor(F.sqrt(F.col("__size").cast("double"))))
    return _first(rows, columns, id_col, seed, quota, most)


def pilot_variances(df: DataFrame, id_col: str, columns: Sequence[str], rhs: str, seed: int = SEED) -> DataFrame:
    """Each cluster with its size and the pilot's variance of the indicator "A differs from the majority"."""
    drawn = pilot(df, id_col, columns, seed)
    pairs = drawn.groupBy(*columns, "__size", rhs).agg(F.count("*").alias("__c"))
    per = pairs.groupBy(*columns, "__size").agg(F.sum("__c").alias("__n"), F.max("__c").alias("__top"))
    return per.select(*columns, F.col("__size").alias("cluster_size"), F.col("__n").cast("long").alias("pilot_rows"), conflict_variance(F.col("__n"), F.col("__top")).alias("variance"))


def all_pilot_variances(df: DataFrame, id_col: str, rhs: str, columns: Sequence[str], seed: int = SEED) -> DataFrame:
    """pilot_variances() of every single column but rhs, once for a right-hand side: column, value (as text), and the
    figures of its clusters."""
    out: DataFrame | None = None
    for c in columns:
        if c != rhs:
            v = pilot_variances(df, id_col, [c], rhs, seed)
            v = v.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "cluster_size", "pilot_rows", "variance")
            out = v if out is None else out.unionByName(v)
    if out is None:
        raise ValueError("no column besides the right-hand side")
    return out


def base_column(df: DataFrame, lhs: Sequence[str]) -> str:
    """The column of lhs whose clusters hold the fewest rows; ties to the first."""
    from .partitions import statistics

    sizes = {r["columns"]: r["partition_size"] for r in statistics(df, [[c] for c in lhs]).collect()}
    return min(lhs, key=lambda c: (sizes.get(c, 0), lhs.index(c)))


def neyman_allocation(variances: DataFrame, columns: Sequence[str], m: int) -> DataFrame:
    """Each cluster with its allocation: m N s / sum(N s), rounded by largest remainder (ties by cluster), N at most.

    If no cluster varies, an even split in the order of the clusters: min(N, what is left / clusters left). Weights are
    scaled to DECIMAL so that their sum does not depend on the partitioning."""
    weight = F.round(F.col("cluster_size") * F.sqrt("variance"), 6).cast("decimal(28,6)")
    w = variances.withColumn("weight", weight)
    total = w.agg(F.coalesce(F.sum("weight").cast("double"), F.lit(0.0)).alias("w"), F.count("*").alias("k")).first()
    if not total["w"]:
        return _even(w, columns, m, total["k"])
    share = F.col("weight").cast("double") * F.lit(float(m)) / F.lit(float(total["w"]))
    parts = w.withColumn("__share", share).withColumn("__floor", F.floor("__share").cast("long")).withColumn("__rest", F.round(F.col("__share") - F.col("__floor"), 9))
    left = m - (parts.agg(F.coalesce(F.sum("__floor"), F.lit(0))).first()[0])
    # the `left` largest remainders: at most one more a cluster
    top = parts.orderBy(F.desc("__rest"), *columns).limit(max(0, left)).select(*[F.col(c).alias(f"__{c}") for c in columns], F.lit(1).alias("__one"))
    out = parts.join(top, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns], "left")
    return out.withColumn("allocation", F.least(F.col("cluster_size"), F.col("__floor") + F.coalesce("__one", F.lit(0))).cast("long")).select(*columns, "cluster_size", "variance", "allocation")


def _split(sizes: Iterable[int], left: int, clusters: int) -> tuple[list[int], int]:
    """Of `left` rows each cluster in turn gets min(N, what is left / clusters left): the shares, and what is left then."""
    out = []
    for size in sizes:
        got = min(size, left // clusters)
        left, clusters = left - got, clusters - 1
        out.append(got)
    return out, left


def _even(w: DataFrame, columns: Sequence[str], m: int, k: int, block_rows: int = 100_000) -> DataFrame:
    """The sequential split depends on the sizes in order, through running remainders. Clusters are dealt to blocks by
    range; the driver walks the sizes of one block at a time for what is left before each, and the blocks are then split
    side by side."""
    if k == 0:
        return w.select(*columns, "cluster_size", "variance", F.lit(0).cast("long").alias("allocation"))
    w = w.select(*columns, "cluster_size", "variance")
    schema = StructType([*w.schema.fields, StructField("allocation", LongType())])
    if k <= block_rows:  # the order is a list on the driver
        rows = w.orderBy(*columns).collect()
        given, _ = _split([r["cluster_size"] for r in rows], m, k)
        return w.sparkSession.createDataFrame([(*r, got) for r, got in zip(rows, given, strict=True)], schema)
    ranged = w.repartitionByRange(-(-k // block_rows), *columns).withColumn("__block", F.spark_partition_id())
    placed = materialised(ranged.sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id()), "clusters")
    starts, left, clusters = {}, m, k
    for block in sorted(r[0] for r in placed.select("__block").distinct().collect()):
        sizes = placed.filter(F.col("__block") == block).orderBy("__at").select("cluster_size").toArrow().column(0).to_pylist()
        starts[block] = (left, clusters)
        _, left = _split(sizes, left, clusters)
        clusters -= len(sizes)

    def split(block: pa.Table) -> pa.Table:
        block = block.sort_by("__at")
        given, _ = _split(block.column("cluster_size").to_pylist(), *starts[block.column("__block")[0].as_py()])
        return block.drop_columns(["__block", "__at"]).append_column("allocation", pa.array(given, pa.int64()))

    return placed.groupBy("__block").applyInArrow(split, schema)


def sample_neyman(df: DataFrame, id_col: str, lhs: Sequence[str], rhs: str, param: float = 200, seed: int = SEED, total_rows: int | None = None, base: str | None = None) -> Sample:
    """Allocated to the clusters of the base column by size and pilot variance. base: that column, if it is known."""
    check_columns(df, [*lhs, rhs])
    n = df.count() if total_rows is None else total_rows
    m = sample_size(n, param)
    base = base or base_column(df, list(lhs))
    total = partition(df, [base]).filter("cluster_size > 1").agg(F.coalesce(F.sum("cluster_size"), F.lit(0))).first()[0]
    rows = _with_clusters(df, [base])
    info = {"strategy": "neyman", "asked": m, "base": base, "clustered_rows": total}
    if total <= m:
        return Sample(rows.drop("__size"), m, n, info)
    allocation = neyman_allocation(pilot_variances(df, id_col, [base], rhs, seed), [base], m)
    quota = allocation.select(F.col(base).alias("__base"), F.col("allocation").alias("__given"))
    given = rows.join(quota, F.col(base).eqNullSafe(F.col("__base")))
    return Sample(_first(given, [base], id_col, seed, F.col("__given"), max(1, m)).drop("__size", "__base", "__given"), m, n, info)


STRATEGIES: dict[str, Strategy | None] = {"none": None, "random": sample_random, "focused": sample_focused, "neyman": sample_neyman}


def without_lone_values(sample: DataFrame, df: DataFrame, lhs: Sequence[str]) -> DataFrame:
    """Sampled rows whose value of every single column of lhs stands more than once in the table."""
    for c in lhs:
        common = df.groupBy(c).agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col(c).alias("__v"))
        sample = sample.join(common, F.col(c).eqNullSafe(F.col("__v")), "left_semi")
    return sample


def estimated_violations(rows: DataFrame, lhs: Sequence[str], rhs: str, measure: str | Measure = "g3") -> DataFrame:
    """One row: violations among the rows given."""
    s, m, q, c = F.col("__s"), F.col("__m"), F.col("__q"), F.col("__c")
    per = rows.groupBy(*lhs, rhs).agg(F.count("*").alias("__c")).groupBy(*lhs).agg(F.sum(c).alias("__s"), F.max(c).alias("__m"), F.sum(c * (c - 1)).alias("__q"))
    return per.agg(F.coalesce(F.sum(measure_named(measure).group(s, m, q)), F.lit(0)).cast("long").alias("violations"), F.coalesce(F.sum(s), F.lit(0)).cast("long").alias("rows_used"))


def _scaled(violations: float, n: int, m: int, measure: Measure) -> float:
    """Violations in a sample of m of n rows, as an error of the table."""
    base = measure.base(n)
    return violations * (n / m) / base if m and base else 0.0


def estimate_error(df: DataFrame, id_col: str, lhs: Sequence[str], rhs: str, strategy: str | Strategy = "focused", param: float = 200, seed: int = SEED) -> DataFrame:
    """One row: violations in the sample, rows_used, sample_size and g3, the violations scaled by n / m over n - 1 (0 for
    an empty sample). Strategy "none" is exact. For an empty left-hand side all rows are one cluster, so every named
    strategy draws at random, and the estimate is the share of sampled rows that don't have the most frequent value."""
    from .measures import errors

    draw = drawn_by(strategy)
    if draw is None:
        exact = errors(df, lhs, rhs)
        return exact.select(F.col("removals").alias("violations"), F.col("total_rows").alias("rows_used"), F.col("total_rows").alias("sample_size"), "g3")
    if not lhs:
        draw = sample_random if strategy in STRATEGIES else draw
    sample = draw(df, id_col, lhs, rhs, param, seed)
    rows = without_lone_values(sample.rows, df, lhs)
    found = estimated_violations(rows, lhs, rhs)
    n, m = sample.total_rows, sample.size
    scaled = F.col("violations").cast("double") * F.lit(float(n)) / F.lit(float(max(1, m))) / F.lit(float(n - 1)) if n > 1 and m else F.lit(0.0)
    return found.select("violations", "rows_used", F.lit(m).cast("long").alias("sample_size"), scaled.alias("g3"))


def drawn_by(strategy: str | Strategy) -> Strategy | None:
    if callable(strategy):
        return strategy
    if strategy not in STRATEGIES:
        raise ValueError(f"no sampling named {strategy}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy]


class Estimator:
    """Estimated errors of many candidates of one table by a sampling strategy, other than "none".

    A sample is drawn once for what it depends on: the random one for the table, the focused one for a left-hand side, the
    Neyman one for its base column and the right-hand side, a strategy of one's own for the candidate. Candidates are
    estimated side by side, MOST in one job."""

    MOST = 8

    def __init__(self, rows: DataFrame, id_col: str, columns: Sequence[str], strategy: str | Strategy, param: float, seed: int, measure: Measure, total_rows: int):
        self.rows, self.id_col, self.columns, self.name = rows, id_col, list(columns), strategy
        self.draw, self.param, self.seed, self.measure, self.n = drawn_by(strategy), param, seed, measure, total_rows
        self.samples: dict[tuple, Sample] = {}
        self.common: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] | None = None

    def _base(self, x: frozenset) -> str:
        if self.sizes is None:
            from .partitions import statistics

            self.sizes = {r["columns"]: r["partition_size"] for r in statistics(self.rows, [[c] for c in self.columns]).collect()}
        return min(sorted(x, key=self.columns.index), key=self.sizes.__getitem__)

    def _sample(self, x: frozenset, a: str) -> Sample:
        """With a column __lone_<c> for each column c: whether the row's value stands once in the table."""
        base = self._base(x) if self.name == "neyman" else None
        key = () if self.name == "random" else (x,) if self.name == "focused" else (base, a) if base else (x, a)
        if key not in self.samples:
            more = {"base": base} if base else {}
            drawn = self.draw(self.rows, self.id_col, sorted(x, key=self.columns.index), a, self.param, self.seed, self.n, **more)
            rows = drawn.rows
            for c in self.columns:
                if c not in self.common:
                    values = self.rows.groupBy(f"`{c}`").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col(f"`{c}`").alias("__v"), F.lit(False).alias("__lone"))
                    self.common[c] = values.persist()
                rows = rows.join(self.common[c], F.col(f"`{c}`").eqNullSafe(F.col("__v")), "left").withColumn(f"__lone_{c}", F.coalesce("__lone", F.lit(True))).drop("__v", "__lone")
            self.samples[key] = Sample(rows.persist(), drawn.size, drawn.total_rows, drawn.info)
        return self.samples[key]

    def errors(self, asked: Iterable[tuple[frozenset, str]]) -> dict[tuple[frozenset, str], float]:
        asked = list(asked)
        out = {}
        for at in range(0, len(asked), self.MOST):
            part, union = asked[at : at + self.MOST], None
            for i, (x, a) in enumerate(part):
                rows = self._sample(x, a).rows
                for c in x:
                    rows = rows.filter(~F.col(f"`__lone_{c}`"))
                one = estimated_violations(rows, sorted(x), a, self.measure).select(F.lit(i).alias("i"), F.col("violations").cast("double").alias("v"))
                union = one if union is None else union.unionByName(one)
            for r in union.collect():
                x, a = part[r["i"]]
                out[x, a] = _scaled(r["v"], self.n, self._sample(x, a).size, self.measure)
        return out

    def close(self) -> None:
        for df in (*(s.rows for s in self.samples.values()), *self.common.values()):
            df.unpersist()


class SmallEstimator:
    """The same for a random sample that is small enough for the driver (MOST_ROWS): counted here, without jobs."""

    MOST_ROWS = 2000

    def __init__(self, rows: DataFrame, id_col: str, columns: Sequence[str], param: float, seed: int, measure: Measure, total_rows: int):
        self.columns, self.measure, self.n = list(columns), measure, total_rows
        sample = sample_random(rows, id_col, param=param, seed=seed, total_rows=total_rows)
        self.size = sample.size
        hashes = [F.xxhash64(F.col(f"`{c}`")) for c in columns]
        drawn = [tuple(r) for r in sample.rows.select(*[F.col(f"`{c}`") for c in columns], *hashes).collect()]
        k = len(self.columns)
        self.sample = [r[:k] for r in drawn]
        # whether a sampled value stands once in the table: one scan, for all columns, which values pass by their hash
        held = [h.isin(sorted({r[k + i] for r in drawn})) for i, h in enumerate(hashes)]
        tally = F.filter(F.array(*[F.when(x, F.struct(F.lit(i).alias("i"), h.alias("h"))) for i, (h, x) in enumerate(zip(hashes, held, strict=True))]), lambda x: x.isNotNull())
        counted = rows.select(F.inline(tally)).groupBy("i", "h").agg(F.count("*").alias("n")).filter("n = 1")
        lone = {(r["i"], r["h"]) for r in counted.collect()} if drawn else set()
        self.lone = [tuple((i, r[k + i]) in lone for i in range(k)) for r in drawn]

    def errors(self, asked: Iterable[tuple[frozenset, str]]) -> dict[tuple[frozenset, str], float]:
        return {(x, a): self._error(x, a) for x, a in asked}

    def _error(self, x: frozenset, a: str) -> float:
        key, at = [self.columns.index(c) for c in sorted(x)], self.columns.index(a)
        counts: dict[tuple, dict] = {}
        for r, lone in zip(self.sample, self.lone, strict=True):
            if not any(lone[i] for i in key):
                group = counts.setdefault(tuple(repr(r[i]) for i in key), {})
                group[repr(r[at])] = group.get(repr(r[at]), 0) + 1
        total = sum(self.measure.group(sum(g.values()), max(g.values()), sum(c * (c - 1) for c in g.values())) for g in counts.values())
        return _scaled(total, self.n, self.size, self.measure)

    def close(self) -> None:
        pass
