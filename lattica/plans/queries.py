"""The profiling queries over the driver's tables, each with SQL of the same rows.

Every query gives scalars; counts are BIGINT and divided once, so that both engines' doubles agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columnsets import children, mask_of, minimal_hitting_sets, parents, to_text
from ..operators import levels, measures, partitions, sampling
from ..streaming import incremental
from . import compare
from .discover import RESULT, discover

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# ---- SQL text -------------------------------------------------------------------------------------------------------


def _on(cols: Sequence[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)


def error_sql(source: str, lhs: Sequence[str], rhs: str) -> str:
    """One row: total_rows, removals, violating_pairs, g3, g1."""
    x = ", ".join(lhs)
    if lhs:
        inner = f"SELECT sum(c) s, max(c) m, sum(c * (c - 1)) q FROM (SELECT {x}, {rhs}, count(*) c FROM {source} GROUP BY {x}, {rhs}) GROUP BY {x}"
        r, p = "sum(s - m)", "sum(s * (s - 1) - q)"
    else:
        inner = f"SELECT count(*) s FROM {source} GROUP BY {rhs}"
        r, p = "sum(s - 1)", "sum(s * (s - 1))"
    return f"""SELECT CAST(n AS BIGINT) total_rows, CAST(r AS BIGINT) removals, CAST(p AS BIGINT) violating_pairs,
  CASE WHEN n > 1 THEN CAST(r AS DOUBLE) / CAST(n - 1 AS DOUBLE) ELSE 0.0 END g3,
  CASE WHEN n > 1 THEN CAST(p AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE) ELSE 0.0 END g1
FROM (SELECT coalesce(sum(s), 0) n, coalesce({r}, 0) r, coalesce({p}, 0) p FROM ({inner}))"""


def g2_sql(source: str, lhs: Sequence[str], rhs: str) -> str:
    """The same with g2, the share of rows that stand in a violating pair."""
    x = ", ".join(lhs)
    return f"""SELECT CAST(sum(s - m) AS BIGINT) removals, CAST(sum(s * (s - 1) - q) AS BIGINT) violating_pairs, CAST(sum(CASE WHEN s > m THEN s ELSE 0 END) AS DOUBLE) / CAST(sum(s) AS DOUBLE) g2
FROM (SELECT sum(c) s, max(c) m, sum(c * (c - 1)) q FROM (SELECT {x}, {rhs}, count(*) c FROM {source} GROUP BY {x}, {rhs}) GROUP BY {x})"""


def candidates_sql(source: str, candidates: Sequence[tuple[Sequence[str], str]], one: Callable = error_sql) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{','.join(sorted(x))}' lhs, '{a}' rhs, * FROM ({one(source, sorted(x), a)})" for x, a in candidates)


def discover_sql(source: str, columns: Sequence[str], eps: float, measure: str, max_lhs: int, one: Callable = error_sql) -> str:
    cands = [(x, a) for a in columns for k in range(1, max_lhs + 1) for x in combinations([c for c in columns if c != a], k)]
    return f"""WITH e AS MATERIALIZED ({candidates_sql(source, cands, one)}),
valid AS MATERIALIZED (SELECT *, string_split(lhs, ',') cols FROM e WHERE {measure} <= {eps!r})
SELECT v.lhs, v.rhs, v.{measure} AS error, v.removals, v.violating_pairs FROM valid v WHERE NOT EXISTS (
  SELECT 1 FROM valid w WHERE w.rhs = v.rhs AND len(w.cols) < len(v.cols) AND list_has_all(v.cols, w.cols))"""


def md5_key(id_col: str, seed: int = sampling.SEED) -> str:
    return f"md5('{seed}:' || CAST({id_col} AS VARCHAR))"


# ---- single candidates ----------------------------------------------------------------------------------------------


@query("g3_orders_custdate_status", f"SELECT total_rows, removals, g3 FROM ({error_sql('orders', ['o_custkey', 'o_orderdate'], 'o_orderstatus')})")
def _(spark, sf):
    return measures.errors(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"], "o_orderstatus").select("total_rows", "removals", "g3")


@query("g1_part_brand_type", f"SELECT total_rows, violating_pairs, g1 FROM ({error_sql('part', ['p_brand'], 'p_type')})")
def _(spark, sf):
    return measures.errors(table(spark, sf, "part"), ["p_brand"], "p_type").select("total_rows", "violating_pairs", "g1")


@query("g3_empty_lhs", f"SELECT total_rows, removals, g3 FROM ({error_sql('customer', [], 'c_mktsegment')})")
def _(spark, sf):
    return measures.errors(table(spark, sf, "customer"), [], "c_mktsegment").select("total_rows", "removals", "g3")


@query("g1_empty_lhs", f"SELECT total_rows, violating_pairs, g1 FROM ({error_sql('customer', [], 'c_mktsegment')})")
def _(spark, sf):
    return measures.errors(table(spark, sf, "customer"), [], "c_mktsegment").select("total_rows", "violating_pairs", "g1")


@query("removals_and_pairs", error_sql("lineitem", ["l_suppkey", "l_quantity"], "l_returnflag"))
def _(spark, sf):
    return measures.errors(table(spark, sf, "lineitem"), ["l_suppkey", "l_quantity"], "l_returnflag")


_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query("simple_measure", "SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({1.0 - k / 6!r} AS DOUBLE))" for k in range(1, 6)) + ") t(lhs_size, error)")
def _(spark, sf):
    k = len(table(spark, sf, "events").columns)
    return spark.createDataFrame([(n, measures.simple_measure(_EVENT_COLUMNS[:n], k)) for n in range(1, k)], "lhs_size int, error double")


# ---- partitions -----------------------------------------------------------------------------------------------------


@query("pli_clusters_orders_priority", "SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) cluster_size FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return partitions.stripped(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("pli_members_nation", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') members, CAST(count(*) AS BIGINT) cluster_size FROM nation GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    c = partitions.clusters(table(spark, sf, "nation"), ["n_regionkey"], "n_nationkey")
    return c.select("n_regionkey", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "cluster_size")


@query(
    "pli_member_rows_orders",
    """WITH c AS (SELECT o_orderpriority, o_orderstatus, dense_rank() OVER (ORDER BY o_orderpriority, o_orderstatus) cluster_id FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
SELECT CAST(cluster_id AS BIGINT) cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY o_orderkey) AS BIGINT) AS position, o_orderkey FROM orders JOIN c USING (o_orderpriority, o_orderstatus)""",
)
def _(spark, sf):
    return partitions.cluster_members(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("pli_product_part_brand_type", "SELECT p_brand, p_type, CAST(count(*) AS BIGINT) cluster_size FROM part GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return partitions.product(table(spark, sf, "part"), ["p_brand"], ["p_type"])


@query(
    "attribute_vector_customer",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) cluster_id FROM customer GROUP BY 1, 2 HAVING count(*) > 1)
SELECT c_custkey, coalesce(CAST(cluster_id AS BIGINT), 0) cluster_id FROM customer LEFT JOIN c USING (c_nationkey, c_mktsegment)""",
)
def _(spark, sf):
    return partitions.attribute_vector(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query(
    "attribute_vector_nation",
    """WITH c AS (SELECT n_regionkey, dense_rank() OVER (ORDER BY n_regionkey) cluster_id FROM nation GROUP BY 1 HAVING count(*) > 1)
SELECT n_nationkey, coalesce(CAST(cluster_id AS BIGINT), 0) cluster_id FROM nation LEFT JOIN c USING (n_regionkey)""",
)
def _(spark, sf):
    return partitions.attribute_vector(table(spark, sf, "nation"), ["n_regionkey"], "n_nationkey")


_STAT_SETS = [["l_returnflag"], ["l_linestatus"], ["l_suppkey"], ["l_shipdate"], ["l_orderkey", "l_linenumber"], ["l_extendedprice"], ["l_discount", "l_tax", "l_quantity"]]


@query(
    "partition_stats_all_columns",
    "\nUNION ALL\n".join(
        f"SELECT '{','.join(sorted(s))}' AS columns, CAST(count(*) FILTER (c > 1) AS BIGINT) clusters, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) partition_size, CAST(count(*) AS BIGINT) distinct_groups, CAST(sum(c) AS BIGINT) total_rows FROM (SELECT count(*) c FROM lineitem GROUP BY {', '.join(s)})"
        for s in _STAT_SETS
    ),
)
def _(spark, sf):
    return partitions.statistics(table(spark, sf, "lineitem"), _STAT_SETS)


_KEY_SETS = [("orders", ["o_orderkey"]), ("orders", ["o_custkey", "o_orderdate"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("customer", ["c_acctbal"])]


@query("superkey_test", "\nUNION ALL\n".join(f"SELECT '{t}' table_name, '{','.join(c)}' AS columns, NOT EXISTS (SELECT 1 FROM {t} GROUP BY {', '.join(c)} HAVING count(*) > 1) is_key" for t, c in _KEY_SETS))
def _(spark, sf):
    rows = [(t, ",".join(c), partitions.is_superkey(table(spark, sf, t), c)) for t, c in _KEY_SETS]
    return spark.createDataFrame(rows, "table_name string, columns string, is_key boolean")


# ---- violations -----------------------------------------------------------------------------------------------------


@query(
    "majority_value_per_group",
    """WITH c AS (SELECT user_id, event_type, count(*) c FROM events GROUP BY ALL), r AS (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) i, sum(c) OVER (PARTITION BY user_id) n FROM c)
SELECT user_id, event_type majority_value, CAST(c AS BIGINT) majority_rows, CAST(n AS BIGINT) group_rows FROM r WHERE i = 1""",
)
def _(spark, sf):
    return measures.majority(table(spark, sf, "events"), ["user_id"], "event_type")


@query(
    "rows_to_remove",
    """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) c FROM orders GROUP BY ALL), best AS (
SELECT o_custkey, o_orderstatus b FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderstatus) = 1)
SELECT o_orderkey, o.o_custkey, o_orderstatus FROM orders o JOIN best USING (o_custkey) WHERE o_orderstatus <> b""",
)
def _(spark, sf):
    return measures.rows_to_remove(table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), ["o_custkey"], "o_orderstatus")


@query(
    "violating_pairs_count",
    """SELECT p_brand, CAST(sum(c) * (sum(c) - 1) - sum(c * (c - 1)) AS BIGINT) violating_pairs, CAST(sum(c) - max(c) AS BIGINT) removals
FROM (SELECT p_brand, p_size, count(*) c FROM part GROUP BY ALL) GROUP BY p_brand""",
)
def _(spark, sf):
    s, m, q = F.col("__s"), F.col("__m"), F.col("__q")
    g = measures.by_value(table(spark, sf, "part"), ["p_brand"], "p_size")
    return g.select("p_brand", measures.G1.group(s, m, q).alias("violating_pairs"), measures.G3.group(s, m, q).alias("removals"))


# ---- levels ---------------------------------------------------------------------------------------------------------

_PART = ["p_brand", "p_type", "p_size", "p_retailprice"]
_CUSTOMER = ["c_nationkey", "c_mktsegment", "c_acctbal", "c_name"]


def _level(name: str, source: str, columns: list[str], size: int) -> None:
    cands = levels.single_level(columns, size)

    @query(name, f"SELECT lhs, rhs, removals, violating_pairs, g3, g1 FROM ({candidates_sql(source, [(sorted(x), a) for x, a in cands])})")
    def _(spark, sf):
        df = table(spark, sf, source, columns)
        return levels.level_errors(df, cands, df.count())


_level("level1_errors_part", "part", _PART, 1)
_level("level2_errors_customer", "customer", _CUSTOMER, 2)
_level("level2_errors_lineitem", "lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"], 2)

_GROUPING = [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_discount"], ["l_tax"]]


@query(
    "grouping_sets_counts",
    "\nUNION ALL\n".join(
        f"SELECT {i} AS node, {', '.join(c if c in s else f'NULL AS {c}' for c in ('l_returnflag', 'l_linestatus', 'l_discount', 'l_tax'))}, CAST(count(*) AS BIGINT) c FROM lineitem GROUP BY {', '.join(s)}"
        for i, s in enumerate(_GROUPING)
    ),
)
def _(spark, sf):
    return partitions.grouped(table(spark, sf, "lineitem"), _GROUPING).withColumnsRenamed({"__node": "node", "__c": "c"})


# ---- discovery ------------------------------------------------------------------------------------------------------


def _discovery(name: str, source: str, columns: list[str], eps: float, measure: str, max_lhs: int, search: str = "levelwise", sampling: str = "random", param: float = 200) -> None:
    @query(name, discover_sql(source, columns, eps, measure, max_lhs))
    def _(spark, sf):
        found = discover(table(spark, sf, source, columns), eps, measure, max_lhs, search=search, sampling=sampling, sample_param=param)
        return found.to_df(spark).select("lhs", "rhs", "error", "removals", "violating_pairs")


_ORDERS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINEITEM = ["l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_NATION = ["n_nationkey", "n_name", "n_regionkey"]
_CUSTOMER = ["c_nationkey", "c_mktsegment", "c_acctbal", "c_name"]
_EVENTS = ["user_id", "event_type", "value", "props"]
_discovery("discover_g3_orders", "orders", _ORDERS, 0.05, "g3", 3)
_discovery("discover_g1_part", "part", ["p_name", *_PART], 0.01, "g1", 3)
_discovery("discover_exact_nation", "nation", _NATION, 0.0, "g3", 2)
_discovery("discover_g3_events", "events", _EVENTS, 0.05, "g3", 3)
_discovery("discover_max_lhs2_lineitem", "lineitem", [*_LINEITEM, "l_orderkey", "l_linenumber"], 0.05, "g3", 2)
_discovery("discover_best_first", "orders", _ORDERS, 0.05, "g3", 3, "bestfirst")
_discovery("discover_best_first_part", "part", ["p_name", *_PART], 0.15, "g3", 4, "bestfirst")
_discovery("discover_best_first_none", "customer", _CUSTOMER, 0.4, "g3", 2, "bestfirst", "none")
_discovery("discover_best_first_random", "customer", _CUSTOMER, 0.4, "g3", 2, "bestfirst", "random", 0.1)
_discovery("discover_best_first_focused", "customer", _CUSTOMER, 0.4, "g3", 2, "bestfirst", "focused")
_discovery("discover_best_first_neyman", "customer", _CUSTOMER, 0.4, "g3", 2, "bestfirst", "neyman")

#: A measure of one's own: the share of rows that stand in a violating pair.
G2 = measures.Measure("g2", lambda s, m, q: F.when(s > m, s).otherwise(0), lambda s: F.when(s > 1, s).otherwise(0), lambda n: n, grows=True)


@query("discover_own_measure", discover_sql("part", ["p_name", *_PART], 0.9, "g2", 3, g2_sql))
def _(spark, sf):
    found = discover(table(spark, sf, "part", ["p_name", *_PART]), 0.9, G2, 3)
    return found.to_df(spark).select("lhs", "rhs", "error", "removals", "violating_pairs")


@query(
    "sampling_estimates_by_mode",
    f"""WITH lone AS (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1)
SELECT 'none' AS mode, removals AS violations FROM ({error_sql('customer', ['c_mktsegment'], 'c_nationkey')})
UNION ALL SELECT 'random', CAST(coalesce(sum(s - t), 0) AS BIGINT) FROM (SELECT sum(c) s, max(c) t FROM (SELECT c_mktsegment, c_nationkey, count(*) c FROM (SELECT * FROM customer ORDER BY {md5_key('c_custkey')}, c_custkey LIMIT 200) WHERE c_mktsegment IN (SELECT * FROM lone) GROUP BY 1, 2) GROUP BY c_mktsegment)""",
)
def _(spark, sf):
    out = None
    for mode in ("none", "random"):
        one = sampling.estimate_error(table(spark, sf, "customer"), "c_custkey", ["c_mktsegment"], "c_nationkey", mode).select(F.lit(mode).alias("mode"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


# ---- ranking and comparison -----------------------------------------------------------------------------------------


def _found(spark, sf, eps: float, measure: str) -> DataFrame:
    return discover(table(spark, sf, "part", ["p_name", *_PART]), eps, measure, 3).to_df(spark).select("lhs", "rhs", "error")


def _found_sql(eps: float, measure: str) -> str:
    return f"(SELECT lhs, rhs, error FROM ({discover_sql('part', ['p_name', *_PART], eps, measure, 3)}))"


@query("top10_by_error", f"SELECT * FROM {_found_sql(0.3, 'g3')} ORDER BY error, lhs, rhs LIMIT 10")
def _(spark, sf):
    return compare.top_by_error(_found(spark, sf, 0.3, "g3"))


@query("ranked_by_error", f"SELECT lhs, rhs, error, CAST(row_number() OVER (ORDER BY error, lhs, rhs) AS BIGINT) AS place FROM {_found_sql(0.3, 'g3')}")
def _(spark, sf):
    """All by error, the order as places: rows as many as dependencies."""
    rows = compare.ranked(_found(spark, sf, 0.3, "g3")).collect()
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "lhs string, rhs string, error double, place long")


@query("fd_set_intersect", f"SELECT a.lhs, a.rhs, a.error error_left, b.error error_right FROM {_found_sql(0.15, 'g3')} a JOIN {_found_sql(0.0001, 'g1')} b USING (lhs, rhs)")
def _(spark, sf):
    return compare.common(_found(spark, sf, 0.15, "g3"), _found(spark, sf, 0.0001, "g1"))


@query("fd_set_except", f"SELECT a.* FROM {_found_sql(0.15, 'g3')} a ANTI JOIN {_found_sql(0.0001, 'g1')} b USING (lhs, rhs)")
def _(spark, sf):
    return compare.only(_found(spark, sf, 0.15, "g3"), _found(spark, sf, 0.0001, "g1"))


@query("fd_set_union", f"SELECT lhs, rhs, min(error) error FROM (SELECT * FROM {_found_sql(0.15, 'g3')} UNION ALL SELECT * FROM {_found_sql(0.0001, 'g1')}) GROUP BY ALL")
def _(spark, sf):
    return compare.merged(_found(spark, sf, 0.15, "g3"), _found(spark, sf, 0.0001, "g1"))


_PAIRS = levels.single_level(["s_nationkey", "s_acctbal", "s_name"], 1)


@query("measure_comparison_g1_g3", f"SELECT lhs, rhs, g3, g1, g1 <= g3 AS g1_lower FROM ({candidates_sql('supplier', _PAIRS)})")
def _(spark, sf):
    df = table(spark, sf, "supplier")
    return levels.level_errors(df, _PAIRS, df.count()).select("lhs", "rhs", "g3", "g1", (F.col("g1") <= F.col("g3")).alias("g1_lower"))


# ---- thresholds -----------------------------------------------------------------------------------------------------

_RATES = {"p_brand": 0.25, "p_type": 0.5, "p_size": 0.125, "p_retailprice": 0.0625}


@query(
    "dynamic_threshold_filter",
    f"""WITH rates(c, r) AS (VALUES {', '.join(f"('{c}', CAST({r} AS DOUBLE))" for c, r in _RATES.items())}), e AS ({candidates_sql('part', [(sorted(x), a) for x, a in levels.single_level(_PART, 1)])})
SELECT e.lhs, e.rhs, e.g3, x.r + a.r AS alpha FROM e JOIN rates x ON x.c = e.lhs JOIN rates a ON a.c = e.rhs WHERE e.g3 <= x.r + a.r""",
)
def _(spark, sf):
    df = table(spark, sf, "part", _PART)
    cands = levels.single_level(_PART, 1)
    limits = spark.createDataFrame([(",".join(sorted(x)), a, measures.dynamic_threshold([*x, a], _RATES)) for x, a in cands], "lhs string, rhs string, alpha double")
    return levels.level_errors(df, cands, df.count()).join(F.broadcast(limits), ["lhs", "rhs"]).filter("g3 <= alpha").select("lhs", "rhs", "g3", "alpha")


# ---- sampling -------------------------------------------------------------------------------------------------------

_SIZE_SQL = "(SELECT CAST(least(200, count(*)) AS BIGINT) m FROM {t})"


@query("sample_random", f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {md5_key('o_orderkey')}, o_orderkey LIMIT 200")
def _(spark, sf):
    return sampling.sample_random(table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]), "o_orderkey").rows


def focused_sql(source: str, cols: list[str], id_col: str, m: int = 200) -> str:
    """Rows of the focused sample."""
    x = ", ".join(cols)
    return f"""(WITH c AS (SELECT *, count(*) OVER (PARTITION BY {x}) size_, row_number() OVER (PARTITION BY {x} ORDER BY {md5_key(id_col)}, {id_col}) at_ FROM {source}),
t AS (SELECT CAST(coalesce(sum(size_), 0) AS DOUBLE) total FROM (SELECT count(*) size_ FROM {source} GROUP BY {x} HAVING count(*) > 1))
SELECT c.* EXCLUDE (size_, at_) FROM c, t WHERE size_ > 1 AND (total <= {m} OR at_ <= least(size_, greatest(1, floor(CAST(size_ AS DOUBLE) / total * CAST({m} AS DOUBLE) + 0.5)))))"""


@query("sample_focused", f"SELECT event_id, user_id FROM {focused_sql('events', ['user_id'], 'event_id')}")
def _(spark, sf):
    return sampling.sample_focused(table(spark, sf, "events", ["event_id", "user_id"]), "event_id", ["user_id"]).rows


def pilot_sql(source: str, x: str, id_col: str, rhs: str) -> str:
    return f"""(WITH c AS (SELECT {x}, {rhs}, count(*) OVER (PARTITION BY {x}) size_, row_number() OVER (PARTITION BY {x} ORDER BY {md5_key(id_col)}, {id_col}) at_ FROM {source}),
p AS (SELECT * FROM c WHERE size_ > 1 AND at_ <= least(20, floor(sqrt(CAST(size_ AS DOUBLE))))),
g AS (SELECT {x}, size_, sum(k) n, max(k) top FROM (SELECT {x}, size_, {rhs}, count(*) k FROM p GROUP BY ALL) GROUP BY {x}, size_)
SELECT {x}, CAST(size_ AS BIGINT) cluster_size, CAST(n AS BIGINT) pilot_rows,
  CASE WHEN n > 1 THEN (CAST(n - top AS DOUBLE) - n * (CAST(n - top AS DOUBLE) / n) * (CAST(n - top AS DOUBLE) / n)) / (n - 1) ELSE 0.0 END variance FROM g)"""


@query("neyman_pilot_variance", f"SELECT * FROM {pilot_sql('lineitem', 'l_suppkey', 'l_orderkey * 10 + l_linenumber', 'l_returnflag')}")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return sampling.pilot_variances(df, "row_id", ["l_suppkey"], "l_returnflag")


@query(
    "neyman_all_columns",
    "\nUNION ALL\n".join(f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, cluster_size, pilot_rows, variance FROM {pilot_sql('customer', c, 'c_custkey', 'c_mktsegment')}" for c in ("c_nationkey", "c_name")),
)
def _(spark, sf):
    return sampling.all_pilot_variances(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", ["c_nationkey", "c_name", "c_mktsegment"])


def allocation_sql(source: str, x: str, id_col: str, rhs: str, m: int = 200) -> str:
    """Largest remainder; the tables at hand have clusters that vary."""
    return f"""(WITH v AS ({pilot_sql(source, x, id_col, rhs)}), w AS (SELECT *, CAST(round(cluster_size * sqrt(variance), 6) AS DECIMAL(28,6)) weight FROM v),
s AS (SELECT *, CAST(weight AS DOUBLE) * CAST({m} AS DOUBLE) / CAST((SELECT sum(weight) FROM w) AS DOUBLE) share FROM w),
f AS (SELECT *, CAST(floor(share) AS BIGINT) low, round(share - floor(share), 9) rest FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, {x}) i, {m} - sum(low) OVER () left_ FROM f)
SELECT {x}, cluster_size, variance, CAST(least(cluster_size, low + CASE WHEN i <= left_ THEN 1 ELSE 0 END) AS BIGINT) allocation FROM r)"""


@query("neyman_allocation", f"SELECT * FROM {allocation_sql('events', 'event_type', 'event_id', 'user_id')}")
def _(spark, sf):
    v = sampling.pilot_variances(table(spark, sf, "events"), "event_id", ["event_type"], "user_id")
    return sampling.neyman_allocation(v, ["event_type"], 200)


def neyman_sql(source: str, base: str, id_col: str, rhs: str, m: int = 200) -> str:
    return f"""(SELECT e.* EXCLUDE (at_) FROM (SELECT *, row_number() OVER (PARTITION BY {base} ORDER BY {md5_key(id_col)}, {id_col}) at_ FROM {source}) e
JOIN {allocation_sql(source, base, id_col, rhs, m)} q ON q.{base} = e.{base} WHERE at_ <= q.allocation)"""


@query("sample_neyman", f"SELECT event_id, event_type, user_id FROM {neyman_sql('events', 'event_type', 'event_id', 'user_id')}")
def _(spark, sf):
    return sampling.sample_neyman(table(spark, sf, "events", ["event_id", "event_type", "user_id"]), "event_id", ["event_type"], "user_id").rows


def _estimate_sql(sample: str, source: str, lhs: list[str], rhs: str, m: int = 200) -> str:
    x = ", ".join(lhs)
    keep = " AND ".join(f"{c} IN (SELECT {c} FROM {source} GROUP BY {c} HAVING count(*) > 1)" for c in lhs)
    return f"""WITH n AS (SELECT count(*) n, least({m}, count(*)) m FROM {source}), s AS (SELECT * FROM {sample} WHERE {keep}),
v AS (SELECT coalesce(sum(s - t), 0) v, coalesce(sum(s), 0) u FROM (SELECT sum(c) s, max(c) t FROM (SELECT {x}, {rhs}, count(*) c FROM s GROUP BY {x}, {rhs}) GROUP BY {x}))
SELECT CAST(v AS BIGINT) violations, CAST(u AS BIGINT) rows_used, CAST(m AS BIGINT) sample_size, CAST(v AS DOUBLE) * CAST(n AS DOUBLE) / CAST(m AS DOUBLE) / CAST(n - 1 AS DOUBLE) g3 FROM n, v"""


@query("g3_estimate_random", _estimate_sql(f"(SELECT * FROM orders ORDER BY {md5_key('o_orderkey')}, o_orderkey LIMIT 200)", "orders", ["o_custkey"], "o_orderpriority"))
def _(spark, sf):
    return sampling.estimate_error(table(spark, sf, "orders"), "o_orderkey", ["o_custkey"], "o_orderpriority", "random")


@query("g3_estimate_focused", _estimate_sql(focused_sql("events", ["user_id"], "event_id"), "events", ["user_id"], "event_type"))
def _(spark, sf):
    return sampling.estimate_error(table(spark, sf, "events"), "event_id", ["user_id"], "event_type", "focused")


@query("g3_estimate_neyman", _estimate_sql(neyman_sql("events", "event_type", "event_id", "user_id"), "events", ["event_type"], "user_id"))
def _(spark, sf):
    return sampling.estimate_error(table(spark, sf, "events"), "event_id", ["event_type"], "user_id", "neyman")


@query(
    "g3_estimate_empty_lhs",
    f"""WITH s AS (SELECT c_mktsegment, count(*) c FROM (SELECT * FROM customer ORDER BY {md5_key('c_custkey')}, c_custkey LIMIT 200) GROUP BY 1)
SELECT CAST(sum(c) - max(c) AS BIGINT) violations, CAST(sum(c) AS BIGINT) rows_used, CAST(least(200, n) AS BIGINT) sample_size, CAST(sum(c) - max(c) AS DOUBLE) * CAST(n AS DOUBLE) / CAST(least(200, n) AS DOUBLE) / CAST(n - 1 AS DOUBLE) g3
FROM s, (SELECT count(*) n FROM customer) GROUP BY n""",
)
def _(spark, sf):
    return sampling.estimate_error(table(spark, sf, "customer"), "c_custkey", [], "c_mktsegment", "random")


_BASES = [("orders", "o_orderkey", ["o_orderpriority", "o_custkey"], "o_orderstatus"), ("orders", "o_orderkey", ["o_totalprice", "o_orderdate", "o_custkey"], "o_orderstatus"), ("customer", "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment")]


def _base_sql(source: str, lhs: list[str]) -> str:
    sizes = " UNION ALL ".join(f"SELECT '{c}' AS base, {i} AS i, coalesce(sum(n), 0) AS size FROM (SELECT count(*) n FROM {source} GROUP BY {c} HAVING count(*) > 1)" for i, c in enumerate(lhs))
    return f"SELECT '{','.join(lhs)}' AS lhs, base, CAST(size AS BIGINT) AS clustered_rows FROM (SELECT * FROM ({sizes}) ORDER BY size, i LIMIT 1)"


@query("neyman_base_column", "\nUNION ALL\n".join(_base_sql(t, x) for t, _, x, _ in _BASES))
def _(spark, sf):
    """The column of several whose clusters hold the fewest rows, as a sample says."""
    rows = []
    for source, key, lhs, rhs in _BASES:
        info = sampling.sample_neyman(table(spark, sf, source), key, lhs, rhs).info
        rows.append((",".join(lhs), info["base"], info["clustered_rows"]))
    return spark.createDataFrame(rows, "lhs string, base string, clustered_rows long")


@query(
    "sample_metadata",
    "SELECT 'random' AS strategy, CAST(least(200, count(*)) AS BIGINT) AS asked, CAST(NULL AS BIGINT) AS clustered_rows FROM events UNION ALL SELECT 'focused', CAST(least(200, sum(n)) AS BIGINT), CAST(sum(n) FILTER (n > 1) AS BIGINT) FROM (SELECT count(*) n FROM events GROUP BY user_id)",
)
def _(spark, sf):
    df = table(spark, sf, "events")
    infos = [sampling.sample_random(df, "event_id").info, sampling.sample_focused(df, "event_id", ["user_id"]).info]
    return spark.createDataFrame([(i["strategy"], i["asked"], i.get("clustered_rows")) for i in infos], "strategy string, asked long, clustered_rows long")


# ---- column sets ----------------------------------------------------------------------------------------------------

#: Families of sets of 1 to 5, by a rule.
_FAMILIES = {f"family {k}": [tuple(sorted({(i * k + j * j) % 5 + 1 for j in range(2 + (i + k) % 3)})) for i in range(1, 6)] for k in range(1, 8)}
_BITS = "(SELECT range AS m FROM range(0, 64) WHERE range & 1 = 0)"


def _hitting_sql(name: str, family: list[tuple[int, ...]]) -> str:
    hits = " AND ".join(f"m & {mask_of(s)} <> 0" for s in family)
    text = "array_to_string(list_filter([1, 2, 3, 4, 5], lambda b: m & (1 << b) <> 0), ',')"
    return f"SELECT '{name}' family, {text} hitting_set FROM {_BITS} WHERE {hits} AND NOT EXISTS (SELECT 1 FROM (SELECT m AS p FROM {_BITS} WHERE {hits}) WHERE p <> m AND p & m = p)"


@query("minimal_hitting_sets", "\nUNION ALL\n".join(_hitting_sql(k, v) for k, v in _FAMILIES.items()))
def _(spark, sf):
    rows = [(k, to_text(m)) for k, v in _FAMILIES.items() for m in minimal_hitting_sets(map(mask_of, v))]
    return spark.createDataFrame(rows, "family string, hitting_set string")


@query(
    "lattice_parents_children",
    """SELECT CAST(a.m AS BIGINT) AS "set", CAST(b.m AS BIGINT) AS neighbour, CASE WHEN a.m & b.m = b.m THEN 'parent' ELSE 'child' END AS kind
FROM (SELECT range m FROM range(1, 32)) a, (SELECT range m FROM range(1, 32)) b WHERE bit_count(xor(a.m, b.m)) = 1""",
)
def _(spark, sf):
    rows = [(m, p, "parent") for m in range(1, 32) for p in parents(m)] + [(m, c, "child") for m in range(1, 32) for c in children(m, 5)]
    return spark.createDataFrame(rows, "set long, neighbour long, kind string")


@query(
    "subset_prune_pairs",
    """SELECT CAST(a.m AS BIGINT) AS candidate, CAST(k.m AS BIGINT) AS known FROM (SELECT range m FROM range(1, 64)) a JOIN (VALUES (5), (10), (48)) k(m) ON a.m & k.m = k.m""",
)
def _(spark, sf):
    from ..functions.columnsets import subset_col

    known = spark.createDataFrame([(5,), (10,), (48,)], "known long")
    return spark.range(1, 64).withColumnRenamed("id", "candidate").join(F.broadcast(known), subset_col(F.col("known"), F.col("candidate")))


@query(
    "mask_operations",
    """SELECT CAST(m AS BIGINT) AS "set", CAST(bit_count(m) AS INT) AS n, array_to_string(list_filter(range(6), lambda i: m & (1 << CAST(i AS INT)) <> 0), ',') AS members,
CAST(63 - m AS BIGINT) AS others, CAST(m | 4 AS BIGINT) AS with_2, CAST(m & 59 AS BIGINT) AS without_2, (m & 4) <> 0 AS has_2, CAST(coalesce(list_min(list_filter(range(2, 6), lambda i: m & (1 << CAST(i AS INT)) <> 0)), -1) AS INT) AS next_2,
CAST(m & 21 AS BIGINT) AS inside, CAST(m & ~21 AS BIGINT) AS outside, m & 21 = m AS is_subset, m & 21 = m AND m <> 21 AS is_proper FROM (SELECT CAST(range AS INT) AS m FROM range(0, 64))""",
)
def _(spark, sf):
    from ..functions import columnsets as cs

    other = cs.mask_of([0, 2, 4])
    rows = [(m, cs.cardinality(m), cs.to_text(m), cs.complement(m, 6), cs.with_bit(m, 2), cs.without_bit(m, 2), cs.has_bit(m, 2), cs.next_bit(m, 2), cs.intersection(m, other), cs.difference(m, other), cs.is_subset(m, other), cs.is_proper_subset(m, other)) for m in range(64)]
    return spark.createDataFrame(rows, "set long, n int, members string, others long, with_2 long, without_2 long, has_2 boolean, next_2 int, inside long, outside long, is_subset boolean, is_proper boolean")


@query(
    "cached_subsets",
    """WITH k(m) AS (VALUES (1), (3), (5), (6), (11), (24), (42)), q AS (SELECT CAST(range AS INT) AS m FROM range(1, 64))
SELECT CAST(q.m AS BIGINT) AS "set", array_to_string(list_sort(list(k.m)), ',') AS subsets FROM q JOIN k ON k.m & q.m = k.m GROUP BY q.m""",
)
def _(spark, sf):
    """Which sets of a store lie in a set."""
    from ..functions.columnsets import SetMap

    store = SetMap()
    for m in (1, 3, 5, 6, 11, 24, 42):
        store.set(m, m)
    rows = [(m, ",".join(map(str, sorted(found)))) for m in range(1, 64) if (found := list(store.subsets_of(m)))]
    return spark.createDataFrame(rows, "set long, subsets string")


# ---- sources and runs -----------------------------------------------------------------------------------------------


@query(
    "csv_delimiter_probe",
    "SELECT DISTINCT props AS line, CAST(length(props) - length(replace(props, ',', '')) AS BIGINT) commas, CAST(length(props) - length(replace(props, ';', '')) AS BIGINT) semicolons, CAST(length(props) - length(replace(props, chr(9), '')) AS BIGINT) tabs FROM events",
)
def _(spark, sf):
    from ..sources.csv import delimiter_counts

    return delimiter_counts(table(spark, sf, "events").select(F.col("props").alias("line")).distinct(), "line")


@query("csv_roundtrip_profile", error_sql("(SELECT CAST(c_nationkey AS VARCHAR) c_nationkey, c_mktsegment FROM customer)", ["c_nationkey"], "c_mktsegment"))
def _(spark, sf):
    from ..sources.csv import read_csv
    from ..sources.shared import scratch

    path = scratch(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return measures.errors(read_csv(spark, path, delimiter=","), ["c_nationkey"], "c_mktsegment")


@query("results_sink_dedup", "SELECT * FROM (VALUES ('orders', 'G3-No-Sampling', 'bestfirst')) t(dataset, config, algorithm)")
def _(spark, sf):
    from ..sources.results import ResultsTable, RunResult
    from ..sources.shared import scratch

    out = ResultsTable(spark, scratch(spark, "results"), fmt="parquet")
    out.write(RunResult("orders", "G3-No-Sampling", "levelwise", fd_count=3))
    out.write_error("orders", "G3-No-Sampling", "bestfirst", "stopped")
    runs = spark.createDataFrame([("orders", "G3-No-Sampling", a) for a in ("levelwise", "bestfirst")], "Dataset string, ConfigName string, Algorithm string")
    return out.pending(runs).toDF("dataset", "config", "algorithm")


@query("csv_probe_shape", "SELECT CAST(count(*) AS BIGINT) n_rows, CAST(5 AS BIGINT) n_columns, CAST(min(c_custkey) AS VARCHAR) least_key FROM customer")
def _(spark, sf):
    """Lines and columns told without reading the table, and a cell of it."""
    from ..sources.csv import column_count, read_csv, row_count
    from ..sources.shared import scratch

    path = scratch(spark, "csv")
    table(spark, sf, "customer").coalesce(1).write.option("header", True).csv(path)
    cell = read_csv(spark, path, columns=["c_custkey"]).agg(F.min(F.col("c_custkey").cast("long")).cast("string")).first()[0]
    return spark.createDataFrame([(row_count(spark, path), column_count(spark, path), cell)], "n_rows long, n_columns long, least_key string")


@query("csv_generated_names", "SELECT CAST(n_nationkey AS VARCHAR) col_1, n_name col_2, CAST(n_regionkey AS VARCHAR) col_3 FROM nation")
def _(spark, sf):
    from ..sources.csv import CsvLoader
    from ..sources.shared import scratch

    path = scratch(spark, "csv")
    table(spark, sf, "nation").write.option("sep", ";").csv(path)
    return CsvLoader.of(path).with_header(False).with_delimiter(";").load(spark)


@query("csv_datasets_by_width", "SELECT * FROM (VALUES (1, 'region', 2), (2, 'nation', 3), (3, 'supplier', 4), (4, 'customer', 5)) t(place, name, width)")
def _(spark, sf):
    """Files of a folder, narrowest first."""
    from ..sources.csv import datasets_by_width
    from ..sources.shared import scratch

    folder = scratch(spark, "folder")
    for name in ("customer", "nation", "region", "supplier"):
        table(spark, sf, name).coalesce(1).write.option("header", True).csv(f"{folder}/{name}.csv")
    rows = [(i, p.rsplit("/", 1)[1].removesuffix(".csv"), n) for i, (p, n) in enumerate(datasets_by_width(spark, folder), 1)]
    return spark.createDataFrame(rows, "place int, name string, width int")


@query("table_of_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation UNION ALL SELECT '', ''")
def _(spark, sf):
    """Rows that are checked against the columns as they are added; nulls are empty."""
    from ..sources.csv import table_of

    rows = [tuple(r) for r in table(spark, sf, "nation", ["n_nationkey", "n_name"]).collect()]
    return table_of(spark, ["key", "name"], [*rows, (None, None)])


@query("typed_table", "SELECT n_nationkey AS k, n_name AS name, CAST(n_regionkey AS DOUBLE) / 2 AS half, n_regionkey > 2 AS far FROM nation")
def _(spark, sf):
    from ..sources.csv import typed_table

    rows = [(r[0], r[1], r[2] / 2, r[2] > 2) for r in table(spark, sf, "nation").collect()]
    return typed_table(spark, [("k", "INTEGER"), ("name", "STRING"), ("half", "DOUBLE"), ("far", "BOOLEAN")], rows)


@query("results_sink_text", "SELECT * FROM (VALUES ('a;b', 'FAILURE', 'no; luck at all', true), ('a;b', 'SUCCESS', NULL, true)) t(dataset, status, message, stamped)")
def _(spark, sf):
    """Commas become semicolons, lines one, and every row has its time as text."""
    from ..sources.results import ResultsTable, RunResult
    from ..sources.shared import scratch

    out = ResultsTable(spark, scratch(spark, "results"))
    out.write(RunResult("a,b", "G3-No-Sampling", "levelwise"))
    out.write_error("a,b", "G3-No-Sampling", "bestfirst", "no, luck\nat all")
    stamp = F.regexp_like("Timestamp", F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"))
    return out.read().select(F.col("Dataset").alias("dataset"), F.col("Status").alias("status"), F.col("ErrorMessage").alias("message"), stamp.alias("stamped"))


@query("incremental_counts_events", error_sql("events", ["user_id"], "event_type"))
def _(spark, sf):
    df = table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    halves = [incremental.group_counts(df.filter(F.col("event_id") % 2 == i), ["user_id", "event_type"]) for i in (0, 1)]
    return incremental.errors_of_counts(incremental.merge_counts(*halves), ["user_id"], "event_type")


__all__ = ["ORACLE_SQL", "QUERIES", "RESULT"]
