"""Error measures of X -> A from grouped counts.

With c(x, a) the rows of X = x and A = a, and c(x) their sum over a:

g3  sum over x of c(x) - max c(x, a), over n - 1 (0 for n <= 1)
g1  sum over x of c(x)(c(x) - 1) - sum over a of c(x, a)(c(x, a) - 1), over n (n - 1) (0 if that is 0)

For the empty X both are measures of A's duplication instead: sum of c(a) - 1 over n - 1, and the agreeing pairs
sum of c(a)(c(a) - 1) over n (n - 1). Numerators are BIGINT and divided once.

A measure is a plug-in: its numerator is a Column over the sums of a group (see Measure), so all run in one job, the
search's included.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .partitions import check_columns


@dataclass(frozen=True)
class Measure:
    """group: the violations of an X group, from s (its rows), m (its most frequent A) and q (sum of c(c - 1) over A).
    alone: the same for the groups of A when X is empty, from s. base: the denominator for n rows.

    A search needs a group with one A (m = s) to have no violations, and groups that are split to have no more than
    before. grows: whether rows that are added never take violations away, so that a part of a table can reject.
    sampled: whether estimates come from samples; if not, they are exact."""

    name: str
    group: Callable[[Column, Column, Column], Column]
    alone: Callable[[Column], Column]
    base: Callable[[int], int]
    grows: bool = False
    sampled: bool = True


G3 = Measure("g3", lambda s, m, q: s - m, lambda s: s - 1, lambda n: max(0, n - 1), grows=True)
G1 = Measure("g1", lambda s, m, q: s * (s - 1) - q, lambda s: s * (s - 1), lambda n: n * (n - 1), grows=True, sampled=False)
MEASURES: dict[str, Measure] = {"g3": G3, "g1": G1}


def measure_named(name: str | Measure) -> Measure:
    if isinstance(name, Measure):
        return name
    if name not in MEASURES:
        raise ValueError(f"no measure named {name}; there are {', '.join(MEASURES)}")
    return MEASURES[name]


def ratio(numerator: Column, base: Column) -> Column:
    return F.when(base > 0, numerator.cast("double") / base).otherwise(F.lit(0.0))


def row_count(df: DataFrame, weight: str | None = None) -> int:
    return df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long")).first()[0]


def by_value(df: DataFrame, lhs: Sequence[str], rhs: str, weight: str | None = None) -> DataFrame:
    """A row for each X: __s, __m and __q (see Measure) of its groups of A."""
    if rhs in lhs:
        raise ValueError("the right-hand side stands on the left, too")
    check_columns(df, [*lhs, rhs])
    n = F.sum(weight) if weight else F.count("*")
    c = F.col("__c")
    pairs = df.groupBy(*lhs, rhs).agg(n.cast("long").alias("__c"))
    return pairs.groupBy(*lhs).agg(F.sum(c).alias("__s"), F.max(c).alias("__m"), F.sum(c * (c - 1)).alias("__q"))


def errors(df: DataFrame, lhs: Sequence[str], rhs: str, weight: str | None = None) -> DataFrame:
    """One row: total_rows, removals and violating_pairs (the numerators of g3 and g1), g3 and g1."""
    if not lhs:
        check_columns(df, [rhs])
        n = F.sum(weight) if weight else F.count("*")
        groups = df.groupBy(rhs).agg(n.cast("long").alias("__s"))
        s = F.col("__s")
        sums = groups.agg(F.coalesce(F.sum(s), F.lit(0)).alias("n"), F.sum(G3.alone(s)).alias("r"), F.sum(G1.alone(s)).alias("p"))
    else:
        s, m, q = F.col("__s"), F.col("__m"), F.col("__q")
        groups = by_value(df, lhs, rhs, weight)
        sums = groups.agg(F.coalesce(F.sum(s), F.lit(0)).alias("n"), F.sum(G3.group(s, m, q)).alias("r"), F.sum(G1.group(s, m, q)).alias("p"))
    n, r, p = F.col("n"), F.coalesce("r", F.lit(0)), F.coalesce("p", F.lit(0))
    return sums.select(n.cast("long").alias("total_rows"), r.cast("long").alias("removals"), p.cast("long").alias("violating_pairs"), ratio(r, n - 1).alias("g3"), ratio(p, n * (n - 1)).alias("g1"))


def error(df: DataFrame, lhs: Sequence[str], rhs: str, measure: str | Measure = "g3") -> float:
    of = measure_named(measure)
    s, m, q = F.col("__s"), F.col("__m"), F.col("__q")
    if lhs:
        groups, violations = by_value(df, lhs, rhs), of.group(s, m, q)
    else:
        check_columns(df, [rhs])
        groups, violations = df.groupBy(rhs).agg(F.count("*").alias("__s")), of.alone(s)
    r = groups.agg(F.sum(violations).alias("v"), F.coalesce(F.sum(s), F.lit(0)).alias("n")).first()
    base = of.base(r["n"])
    return float(r["v"] or 0) / base if base else 0.0


def simple_measure(lhs: Sequence[str], n_columns: int) -> float:
    """A stand-in for tests of search: 1 - |X| / columns."""
    return 1.0 - len(lhs) / n_columns


def majority(df: DataFrame, lhs: Sequence[str], rhs: str) -> DataFrame:
    """Each X with its most frequent A (ties: the smallest), how often that stands, and the rows of X."""
    check_columns(df, [*lhs, rhs])
    pairs = df.groupBy(*lhs, rhs).agg(F.count("*").alias("__c"))
    # the smallest of the most frequent: order by -c, then the value, nulls last
    best = F.min(F.struct((-F.col("__c")).alias("n"), F.isnull(rhs).alias("none"), F.col(rhs).alias("v")))
    return pairs.groupBy(*lhs).agg(best.alias("__b"), F.sum("__c").alias("group_rows")).select(*lhs, F.col("__b.v").alias("majority_value"), (-F.col("__b.n")).alias("majority_rows"), "group_rows")


def rows_to_remove(df: DataFrame, lhs: Sequence[str], rhs: str) -> DataFrame:
    """The rows that violate X -> A: those whose A is not the majority of their X. Their number is g3's numerator."""
    best = majority(df, lhs, rhs).select(*[F.col(c).alias(f"__{c}") for c in lhs], "majority_value")
    joined = df.join(best, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in lhs])
    return joined.filter(~F.col(rhs).eqNullSafe(F.col("majority_value"))).select(*df.columns)


def conflict_variance(rows: Column, majority_rows: Column) -> Column:
    """Sample variance of the indicator "differs from the majority" among rows."""
    q = (rows - majority_rows).cast("double")
    return F.when(rows > 1, (q - rows * (q / rows) * (q / rows)) / (rows - 1)).otherwise(F.lit(0.0))


def dynamic_threshold(columns: Sequence[str], rates: Mapping[str, float]) -> float:
    """The sum of the columns' error rates, each column once."""
    bad = {c: r for c, r in rates.items() if not 0 <= r <= 1}
    if bad:
        raise ValueError(f"error rates outside 0 to 1: {bad}")
    return sum(rates.get(c, 0.0) for c in sorted(set(columns)))
