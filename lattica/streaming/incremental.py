"""Errors of X -> A over a stream.

The state is the grouped counts c(x, a), kept by Structured Streaming; each trigger gives the figures over all rows so
far. Counts of groups merge by addition, so tables that hold batches of counts give the same figures.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measures import errors
from ..operators.partitions import check_columns


def group_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of the groups, for a batch or a stream."""
    return rows.groupBy(*check_columns(rows, columns)).agg(F.count("*").alias("rows"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several batches as one."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    cols = [c for c in out.columns if c != "rows"]
    return out.groupBy(*cols).agg(F.sum("rows").cast("long").alias("rows"))


def errors_of_counts(counts: DataFrame, lhs: Sequence[str], rhs: str) -> DataFrame:
    return errors(counts, list(lhs), rhs, weight="rows")


def watch(rows: DataFrame, lhs: Sequence[str], rhs: str, report: Callable[[int, dict], None], **options):
    """Starts a query that reports (batch, figures) after each trigger. options: of writeStream (checkpointLocation)."""

    def each(counts: DataFrame, batch: int) -> None:
        report(batch, errors_of_counts(counts, lhs, rhs).first().asDict())

    return group_counts(rows, [*lhs, rhs]).writeStream.outputMode("complete").options(**options).foreachBatch(each).start()
