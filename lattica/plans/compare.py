"""Ranking and comparison of dependency sets: DataFrames with lhs, rhs and error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["lhs", "rhs"]


def top_by_error(fds: DataFrame, n: int = 10) -> DataFrame:
    """The n lowest errors, ties by lhs and rhs: a top-n of each task, then of those."""
    return fds.orderBy("error", *KEY).limit(n)


def ranked(fds: DataFrame) -> DataFrame:
    return fds.orderBy("error", *KEY)


def merged(*sets: DataFrame) -> DataFrame:
    """The union; of several records of one dependency the lowest error."""
    out = sets[0].select(*KEY, "error")
    for s in sets[1:]:
        out = out.unionByName(s.select(*KEY, "error"))
    return out.groupBy(*KEY).agg(F.min("error").alias("error"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """In both, with both errors."""
    return a.select(*KEY, F.col("error").alias("error_left")).join(b.select(*KEY, F.col("error").alias("error_right")), KEY)


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """In a but not in b."""
    return a.join(b.select(*KEY), KEY, "left_anti")


def minimal(fds: DataFrame) -> DataFrame:
    """Without dependencies of which a proper subset of the left-hand side is there for the same rhs. By masks of the
    left-hand side's columns when lhs_mask is given, else by the arrays lhs_cols."""
    a, b = fds.alias("a"), fds.alias("b")
    if "lhs_mask" in fds.columns:
        inside = (F.col("b.lhs_mask").bitwiseAND(F.col("a.lhs_mask")) == F.col("b.lhs_mask")) & (F.col("b.lhs_mask") != F.col("a.lhs_mask"))
    else:
        inside = (F.size("b.lhs_cols") < F.size("a.lhs_cols")) & (F.size(F.array_except("b.lhs_cols", "a.lhs_cols")) == 0)
    return a.join(b, (F.col("a.rhs") == F.col("b.rhs")) & inside, "left_anti").select(*[f"a.{c}" for c in fds.columns])
