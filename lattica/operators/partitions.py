"""Partitions of a table by a set of columns: grouped counts, on request with members.

Grouping equality is Spark's: nulls are one group, values are typed. No key is ever joined to a string, so values that
hold a separator cannot collide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised

COUNT = "cluster_size"


def check_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    if len(set(columns)) != len(columns):
        raise ValueError("a column is named twice")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    bad = [c for c in columns if kinds[c].startswith(("map<", "variant"))]
    if bad:
        raise ValueError(f"columns that cannot be grouped: {', '.join(bad)}")
    return list(columns)


def partition(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """A row for each distinct value of the columns with its number of rows (or the sum of weight)."""
    n = F.sum(weight) if weight else F.count("*")
    return df.groupBy(*check_columns(df, columns)).agg(n.cast("long").alias(COUNT))


def stripped(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """The partition without clusters of one row."""
    return partition(df, columns, weight).filter(F.col(COUNT) > 1)


def clusters(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """Clusters of two and more rows with their members' ids in order. A cluster's members meet in one row: for
    inspection of small clusters. cluster_members() gives the same a row for each member."""
    return df.groupBy(*check_columns(df, columns)).agg(F.sort_array(F.collect_list(id_col)).alias("members"), F.count("*").alias(COUNT)).filter(F.col(COUNT) > 1)


def product(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """The stripped partition by both sets of columns; the refinement of two partitions is the grouping by their union."""
    return stripped(df, list(dict.fromkeys([*left, *right])))


def product_encoded(df: DataFrame, left: str, right: str) -> DataFrame:
    """The product of two partitions that are given as cluster-id columns (0: alone). Rows alone on a side drop out."""
    return stripped(df.filter((F.col(left) > 0) & (F.col(right) > 0)), [left, right])


def cluster_ids_of(groups: DataFrame, columns: Sequence[str], name: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """Rows of distinct groups numbered from 1 in the order of the columns (nulls first), as column `name`; and how many
    there are. The numbers are a global rank without a global window: groups are dealt in ranges, ranked inside each, and
    each range starts after those before."""
    spark = groups.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(groups.repartitionByRange(n, *columns).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, at = [], 0
    for part, size in sizes:
        starts.append((part, at))
        at += size
    start = F.element_at(F.create_map(*[F.lit(x) for s in starts for x in s]), F.col("__part")) if 0 < len(starts) <= 200 else None
    if start is None:
        table = spark.createDataFrame(starts, "__part int, __start long")
        dealt, start = dealt.join(F.broadcast(table), "__part"), F.col("__start")
    inside = Window.partitionBy("__part").orderBy(*columns)
    return dealt.withColumn(name, (F.row_number().over(inside) + start).cast("long")).select(*groups.columns, name), at


def cluster_ids(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """The clusters of two and more rows, numbered from 1 in the order of the columns (nulls first), as cluster_id."""
    return cluster_ids_of(stripped(df, check_columns(df, columns)), list(columns), "cluster_id", parts)[0]


def attribute_vector(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """id_col and cluster_id of each row: 0 for rows whose value stands alone, else the number of the cluster."""
    cols = check_columns(df, columns)
    ids = cluster_ids(df, cols).select(*[F.col(c).alias(f"__{c}") for c in cols], "cluster_id")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]
    return df.join(ids, same, "left").select(id_col, F.coalesce("cluster_id", F.lit(0)).cast("long").alias("cluster_id"))


def cluster_members(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """The members of the clusters of two and more rows, a row each: cluster_id, position (from 1, by id) and id_col. No
    cluster meets in one task: members are ranked by ranges, as clusters are numbered."""
    cols = check_columns(df, columns)
    ids = cluster_ids(df, cols).select(*[F.col(c).alias(f"__{c}") for c in cols], "cluster_id")
    rows = df.join(ids.hint("merge"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]).select("cluster_id", id_col)
    ranked, _ = cluster_ids_of(rows, ["cluster_id", id_col], "__at")
    first = ranked.groupBy("cluster_id").agg(F.min("__at").alias("__first"))
    return ranked.hint("merge").join(first, "cluster_id").select("cluster_id", (F.col("__at") - F.col("__first") + 1).alias("position"), id_col)


def statistics(df: DataFrame, column_sets: Sequence[Sequence[str]]) -> DataFrame:
    """For each set of columns: clusters (of two and more rows), partition_size (rows in them), distinct_groups and
    total_rows, all sets in one grouping-sets job."""
    sets = [check_columns(df, s) for s in column_sets]
    names = [",".join(sorted(s)) for s in sets]
    per = grouped(df, sets)
    n = F.col("__c")
    out = per.groupBy("__node").agg(
        F.count_if(n > 1).alias("clusters"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).cast("long").alias("partition_size"),
        F.count("*").alias("distinct_groups"),
        F.sum(n).cast("long").alias("total_rows"),
    )
    return out.withColumn("columns", F.element_at(F.array(*map(F.lit, names)), F.col("__node") + 1)).drop("__node")


def is_superkey(df: DataFrame, columns: Sequence[str]) -> bool:
    """No two rows agree on the columns."""
    return not stripped(df, columns).take(1)


def grouped(df: DataFrame, sets: Sequence[Sequence[str]], weight: str | None = None) -> DataFrame:
    """__node (position in sets), the columns of all sets (null where a set lacks them) and __c, the rows of each group of
    each set: one Expand and one shuffle of partial counts. Nodes are told apart by grouping_id, so nulls in the data
    are values like others."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    distinct = list(dict.fromkeys(tuple(sorted(s, key=every.index)) for s in sets))
    n = F.sum(weight) if weight else F.count("*")
    # grouping_id: a bit for each column, the first the highest, set where the column is not grouped
    gid = {s: sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s) for s in distinct}
    out = df.groupingSets([[F.col(f"`{c}`") for c in s] for s in distinct], *[F.col(f"`{c}`") for c in every]).agg(n.cast("long").alias("__c"), F.grouping_id().alias("__gid"))
    node = {s: i for i, s in reversed(list(enumerate(tuple(sorted(x, key=every.index)) for x in sets)))}
    number = F.lit(None).cast("int")
    pairs = [(gid[s], node[s]) for s in distinct]
    number = F.element_at(F.create_map(*[F.lit(x) for g, i in pairs for x in (g, i)]), F.col("__gid")) if len(pairs) <= 8 else _lookup(pairs, F.col("__gid"))
    return out.select(number.cast("int").alias("__node"), *[F.col(f"`{c}`") for c in every], "__c")


def _lookup(pairs: list[tuple[int, int]], gid: Column) -> Column:
    """The position of a grouping id among the sorted ones gives the node."""
    ordered = sorted(pairs)
    at = F.array_position(F.lit([g for g, _ in ordered]), gid)
    return F.element_at(F.lit([i for _, i in ordered]), at.cast("int"))
