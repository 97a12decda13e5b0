"""Columns as small integers, so that the key of a set of columns is one BIGINT.

Whole-number and date columns of a narrow range are offset by their least value; others get a dictionary of their
distinct values. One job finds all dictionaries: it counts (column, value) pairs, values as text that keeps them apart,
and numbers the values of each column in ranges. A dictionary is broadcast if it is small (its size is known: it was
counted); if not, it is joined by value, but for its frequent values, which are broadcast, and nulls. 0 is null. Grouping
by the codes equals grouping by the values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialised
from .partitions import cluster_ids_of

#: Distinct values of a dictionary that is broadcast.
BROADCAST_VALUES = 100_000
#: Of a larger one, values are frequent that stand in one of so many rows; so there are as many at most.
FREQUENT = 1000
#: Rows that need no join are dealt to so many keys.
SPREAD = 1024
#: Whole numbers of a wider range get a dictionary.
OFFSET_BITS = 24
KEY_BITS = 63
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Encoded:
    """data: the columns as codes, and what else it had. bits: of each column's codes."""

    data: DataFrame
    bits: dict[str, int]

    def fits(self, columns: Sequence[str]) -> bool:
        return sum(self.bits[c] for c in columns) <= KEY_BITS

    def key(self, columns: Sequence[str]) -> tuple[Column, dict[str, int]]:
        """The columns' codes side by side in a BIGINT, and the mask of all but each column's bits."""
        at, out, masks = 0, None, {}
        for c in columns:
            part = F.shiftleft(F.col(f"`{c}`").cast("long"), at)
            out = part if out is None else out.bitwiseOR(part)
            masks[c] = ~(((1 << self.bits[c]) - 1) << at)
            at += self.bits[c]
        return out, masks


def _number(c: str, kind: T.DataType) -> Column:
    return F.unix_date(F.col(f"`{c}`")) if isinstance(kind, T.DateType) else F.col(f"`{c}`")


def span_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Aggregates that encoded() needs: the least and greatest of each column of whole numbers or dates."""
    kinds = {f.name: f.dataType for f in df.schema}
    return [f(_number(c, kinds[c])).cast("long").alias(f"{n}{c}") for c in columns if isinstance(kinds[c], (*_WHOLE, T.DateType)) for n, f in (("low ", F.min), ("high ", F.max))]


def encoded(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), spans: Row | None = None) -> Encoded:
    """spans: a row of span_columns(), if it is known already."""
    kinds = {f.name: f.dataType for f in df.schema}
    whole = [c for c in columns if isinstance(kinds[c], (*_WHOLE, T.DateType))]
    if whole and spans is None:
        spans = df.agg(*span_columns(df, columns)).first()
    bits: dict[str, int] = {}
    out = df.select(*[F.col(f"`{c}`") for c in (*columns, *keep)])
    for c in whole:
        low, high = spans[f"low {c}"], spans[f"high {c}"]
        span = 0 if low is None else high - low + 1
        if span.bit_length() <= OFFSET_BITS:
            bits[c] = max(1, span.bit_length())
            out = out.withColumn(c, F.coalesce((_number(c, kinds[c]).cast("long") - F.lit(low or 0) + 1).cast("int"), F.lit(0)))
    rest = [c for c in columns if c not in bits]
    for c, codes, n in _dictionaries(df, rest, {c: kinds[c] for c in rest}):
        bits[c] = max(1, n.bit_length())
        names = out.columns
        if n <= BROADCAST_VALUES:
            out = out.join(F.broadcast(codes.select("__v", "__code")), F.col(f"`{c}`") == F.col("__v"), "left")
        else:
            out = _joined(out, c, codes)
        code = F.coalesce("__code", F.lit(0)).cast("long" if n >= 1 << 31 else "int")
        out = out.select(*[code.alias(x) if x == c else F.col(f"`{x}`") for x in names])
    return Encoded(out, bits)


def _as_text(c: str, kind: T.DataType) -> tuple[Column, Column] | None:
    """A value as text that no other value of its type has, and back; None for types without."""
    v, t = F.col(f"`{c}`"), F.col("__t")
    if isinstance(kind, T.StringType) and kind == T.StringType():
        return v, t
    if isinstance(kind, (*_WHOLE, T.DecimalType, T.DateType, T.BooleanType)):
        return v.cast("string"), t.cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (v + F.lit(0).cast(kind)).cast("string"), t.cast(kind)  # one zero
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(v).cast("string"), F.timestamp_micros(t.cast("long"))
    if isinstance(kind, T.BinaryType):
        return F.base64(v), F.unbase64(t)
    return None


def _dictionaries(df: DataFrame, columns: Sequence[str], kinds: dict[str, T.DataType]) -> list[tuple[str, DataFrame, int]]:
    """For each column (column, codes, how many): codes has the values as __v, from 1 as __code, and __rows of each."""
    texts = {c: _as_text(c, kinds[c]) for c in columns}
    known = [c for c in columns if texts[c]]
    out = []
    if known:
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), texts[c][0].alias("__t")) for i, c in enumerate(known)]))).filter("__t IS NOT NULL")
        counted = pairs.groupBy("__i", "__t").agg(F.count("*").alias("__rows"))
        dealt = materialised(counted.repartitionByRange("__i", "__t").withColumn("__part", F.spark_partition_id()), "dictionaries")
        sizes = sorted((r["__i"], r["__part"], r["n"]) for r in dealt.groupBy("__i", "__part").agg(F.count("*").alias("n")).collect())  # a row for each range and column
        starts, total = [], dict.fromkeys(range(len(known)), 0)
        for i, part, n in sizes:
            starts.append((i, part, total[i]))
            total[i] += n
        spark = df.sparkSession
        first = F.broadcast(spark.createDataFrame(starts, "__i int, __part int, __start long"))
        inside = F.row_number().over(Window.partitionBy("__i", "__part").orderBy("__t"))
        for i, c in enumerate(known):
            mine = dealt.filter(F.col("__i") == i).join(first, ["__i", "__part"])
            out.append((c, mine.select(texts[c][1].alias("__v"), (F.col("__start") + inside).cast("long").alias("__code"), "__rows"), total[i]))
    for c in columns:
        if not texts[c]:  # nested values: their own distinct values
            values = df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("__v")).agg(F.count("*").alias("__rows"))
            codes, n = cluster_ids_of(values, ["__v"], "__code")
            out.append((c, codes, n))
    return out


def _joined(out: DataFrame, c: str, codes: DataFrame) -> DataFrame:
    """out with __code, where the dictionary is too large to be sent. Nulls and frequent values never meet in one task."""
    n = codes.agg(F.sum("__rows")).first()[0]
    hot = F.col("__rows") * FREQUENT >= n
    few = codes.filter(hot).select(F.col("__v").alias("__hv"), F.col("__code").alias("__hot"))
    out = out.join(F.broadcast(few), F.col(f"`{c}`") == F.col("__hv"), "left").drop("__hv")
    done = F.col(f"`{c}`").isNull() | F.col("__hot").isNotNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in out.columns]), F.lit(SPREAD)).cast("int")
    out = out.withColumn("__done", done).withColumn("__z", F.when(done, spread + 1).otherwise(F.lit(0)))
    rare = codes.filter(~hot).select(F.col("__v"), F.col("__code").alias("__rare"), F.lit(0).alias("__zero"))
    key = F.when(~F.col("__done"), F.col(f"`{c}`"))
    out = out.withColumn("__k", key).join(rare, (F.col("__z") == F.col("__zero")) & (F.col("__k") == F.col("__v")), "left")
    return out.withColumn("__code", F.coalesce("__hot", "__rare"))
