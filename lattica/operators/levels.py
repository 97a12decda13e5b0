"""A whole level of candidates X -> A in one job.

A node is a set of columns S; one grouping of the table by S answers every S \\ A -> A. A level is one plan: grouping
sets over its nodes (one Expand, one shuffle of partial counts), each group repeated for the A that are asked of its
node with A blanked out, grouped again by what remains. Both measures fall out, and the distinct counts of S and of
every S \\ A, which the search prunes with. Rows multiply by the nodes before the first partial aggregation, so wide
levels are cut into chunks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .encoding import Encoded
from .measures import G1, G3, Measure
from .partitions import grouped

#: Nodes of one job, and jobs side by side.
CHUNK, AT_ONCE = 24, 4
#: Of a table that is dealt by a column, (row, node) pairs of one task.
DEALT = 1_000_000


@dataclass(frozen=True)
class Found:
    lhs: frozenset
    rhs: str
    removals: int
    violating_pairs: int
    lhs_groups: int
    node_groups: int
    #: The numerator of the measure that was asked for, if neither of those two.
    violations: float | None = None

    def error(self, measure: Measure, n: int) -> float:
        base = measure.base(n)
        number = self.removals if measure is G3 else self.violating_pairs if measure is G1 else self.violations
        return number / base if base else 0.0


def _sums(measure: Measure | None) -> list:
    s, m, q = F.col("s"), F.col("m"), F.col("q")
    own = F.lit(None).cast("double") if measure in (None, G3, G1) else F.sum(measure.group(s, m, q)).cast("double")
    return [F.sum(G3.group(s, m, q)).cast("long").alias("removals"), F.sum(G1.group(s, m, q)).cast("long").alias("violating_pairs"), F.count("*").alias("lhs_groups"), F.sum("d").cast("long").alias("node_groups"), own.alias("violations")]


def level_plan(df: DataFrame, candidates: Sequence[tuple[frozenset, str]], weight: str | None = None, measure: Measure | None = None) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """The plan for some candidates with non-empty left-hand sides: a row for each (node, rhs), and the nodes' columns."""
    every = sorted({c for x, a in candidates for c in (*x, a)})
    asked: dict[tuple[str, ...], list[str]] = {}
    for x, a in candidates:
        if not x or a in x:
            raise ValueError("a left-hand side must not be empty or hold the right-hand side")
        asked.setdefault(tuple(sorted((*x, a))), []).append(a)
    nodes = sorted(asked)
    number = {c: i for i, c in enumerate(every)}
    groups = grouped(df, nodes, weight)
    wanted = F.element_at(F.lit([sorted(number[a] for a in asked[s]) for s in nodes]) if len(nodes) > 1 else F.array(F.array(*[F.lit(number[a]) for a in sorted(asked[nodes[0]], key=number.get)])), F.col("__node") + 1)
    spread = groups.withColumn("__rhs", F.explode(wanted))
    rest = [F.when(F.col("__rhs") != i, F.col(f"`{c}`")).alias(f"__x{i}") for c, i in number.items()]
    keys = spread.select(F.col("__node").alias("node"), "__rhs", F.col("__c").alias("c"), *rest)
    c = F.col("c")
    per = keys.groupBy("node", "__rhs", *[f"__x{i}" for i in number.values()]).agg(F.sum(c).alias("s"), F.max(c).alias("m"), F.sum(c * (c - 1)).alias("q"), F.count("*").alias("d"))
    out = per.groupBy("node", "__rhs").agg(*_sums(measure))
    rhs = F.element_at(F.array(*map(F.lit, every)), F.col("__rhs") + 1)
    return out.select("node", rhs.alias("rhs"), "removals", "violating_pairs", "lhs_groups", "node_groups", "violations"), nodes


def packed_plan(table: Encoded, candidates: Sequence[tuple[frozenset, str]], weight: str | None = None, measure: Measure | None = None, by: str | None = None, rows: int = 0) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """level_plan() over codes: a node's key is one BIGINT, and blanking out A is a bit mask. by: a column of every left-hand
    side. The (about so many) rows are dealt by it, once, and both groupings then need no shuffle."""
    asked: dict[tuple[str, ...], list[str]] = {}
    for x, a in candidates:
        asked.setdefault(tuple(sorted((*x, a))), []).append(a)
    nodes = sorted(asked)
    keys, masks = zip(*(table.key(n) for n in nodes), strict=True)
    w = F.col(f"`{weight}`") if weight else F.lit(1).cast("long")
    data, own = table.data, []
    if by is not None:
        tasks = max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * len(nodes) / DEALT))
        data, own = data.repartition(tasks, F.col(f"`{by}`")), [F.col(f"`{by}`").alias("__by")]
    spread = data.select(*own, w.alias("w"), F.inline(F.array(*[F.struct(F.lit(i).alias("node"), k.alias("key")) for i, k in enumerate(keys)])))
    own = ["__by"] if own else []
    groups = spread.groupBy(*own, "node", "key").agg(F.sum("w").alias("c"))
    every = sorted({a for n in nodes for a in asked[n]})
    wanted = [[{"rhs": every.index(a), "mask": m[a]} for a in asked[n]] for n, m in zip(nodes, masks, strict=True)]
    asks = F.from_json(F.lit(json.dumps(wanted)), "array<array<struct<rhs:int,mask:bigint>>>")
    each = groups.select(*own, "node", "key", "c", F.inline(F.element_at(asks, F.col("node") + 1)))
    c = F.col("c")
    per = each.groupBy(*own, "node", "rhs", F.col("key").bitwiseAND(F.col("mask")).alias("x")).agg(F.sum(c).alias("s"), F.max(c).alias("m"), F.sum(c * (c - 1)).alias("q"), F.count("*").alias("d"))
    out = per.groupBy("node", "rhs").agg(*_sums(measure))
    return out.withColumn("rhs", F.element_at(F.array(*map(F.lit, every)), F.col("rhs") + 1)), nodes


def chunks(candidates: Iterable[tuple[frozenset, str]], size: int = CHUNK) -> list[list[tuple[frozenset, str]]]:
    """Candidates of one node stay together; a chunk has at most `size` nodes. Sorted nodes share columns."""
    by_node: dict[tuple[str, ...], list[tuple[frozenset, str]]] = {}
    for x, a in candidates:
        by_node.setdefault(tuple(sorted((*x, a))), []).append((x, a))
    nodes = sorted(by_node)
    return [[c for n in nodes[i : i + size] for c in by_node[n]] for i in range(0, len(nodes), size)]


def evaluate(table: DataFrame | Encoded, candidates: Iterable[tuple[frozenset, str]], weight: str | None = None, chunk: int = CHUNK, measure: Measure | None = None, by: str | None = None, rows: int = 0) -> dict[tuple[frozenset, str], Found]:
    """The exact figures of all candidates, chunks side by side. As many rows as candidates come to the driver. by, rows: see
    packed_plan()."""
    out = {}
    candidates = list(candidates)
    if isinstance(table, Encoded):
        packed = [c for c in candidates if table.fits((*c[0], c[1]))]
        wide = [c for c in candidates if not table.fits((*c[0], c[1]))]
        make_packed = partial(packed_plan, by=by, rows=rows)
        parts = [(make_packed, table, p) for p in chunks(packed, chunk)] + [(level_plan, table.data, p) for p in chunks(wide, chunk)]
    else:
        parts = [(level_plan, table, p) for p in chunks(candidates, chunk)]

    def asked(part: tuple) -> list[Found]:
        make, data, wanted = part
        plan, nodes = make(data, wanted, weight, measure)
        return [Found(frozenset(nodes[r["node"]]) - {r["rhs"]}, r["rhs"], r["removals"], r["violating_pairs"], r["lhs_groups"], r["node_groups"], r["violations"]) for r in plan.collect()]

    spark = (table.data if isinstance(table, Encoded) else table).sparkSession
    if len(parts) < 2:
        found = map(asked, parts)
    else:  # the threads' jobs belong to the caller's job group
        with ThreadPoolExecutor(AT_ONCE) as pool:
            found = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(asked), p) for p in parts]]
    for rows in found:
        out.update({(f.lhs, f.rhs): f for f in rows})
    for x, a in candidates:  # an empty table has no groups
        out.setdefault((x, a), Found(x, a, 0, 0, 0, 0, 0.0))
    return out


#: Eighths of the values of a column that are asked one after the other.
EIGHTHS = (0, 1, 2, 4, 8)


def evaluate_dealt(table: Encoded, candidates: Iterable[tuple[frozenset, str]], by: str, n: int, eps: float, weight: str | None = None, chunk: int = CHUNK, measure: Measure = G3) -> dict[tuple[frozenset, str], Found]:
    """The exact figures of those candidates, all with `by` on the left, whose error is within eps; the others are not in the
    result. No group of X has rows in two parts of by's values, so figures of parts add up, and a candidate is left once
    those of the parts so far exceed eps (measures that grow)."""
    part = F.pmod(F.xxhash64(F.col(f"`{by}`")), F.lit(EIGHTHS[-1]))
    left = {c: Found(*c, 0, 0, 0, 0, 0.0) for c in candidates}
    for low, high in zip(EIGHTHS, EIGHTHS[1:], strict=False):
        rows = Encoded(table.data.filter((part >= low) & (part < high)), table.bits)
        for c, f in evaluate(rows, left, weight, chunk, measure, by, n * (high - low) // EIGHTHS[-1]).items():
            o = left[c]
            total = Found(*c, *((getattr(o, k) or 0) + (getattr(f, k) or 0) for k in ("removals", "violating_pairs", "lhs_groups", "node_groups", "violations")))
            if total.error(measure, n) > eps:
                del left[c]
            else:
                left[c] = total
        if not left:
            break
    return left


def level_errors(df: DataFrame, candidates: Sequence[tuple[frozenset, str]], total_rows: int, measures: Sequence[Measure] = (G3, G1), chunk: int = CHUNK) -> DataFrame:
    """lhs, rhs, the numerators and an error column for each measure, for every candidate."""
    out: DataFrame | None = None
    for part in chunks(candidates, chunk):
        plan, nodes = level_plan(df, part)
        names = F.array(*[F.lit(",".join(n)) for n in nodes])
        lhs = F.array_join(F.array_remove(F.split(F.element_at(names, F.col("node") + 1), ","), F.col("rhs")), ",")
        num = {"g3": F.col("removals"), "g1": F.col("violating_pairs")}
        if unknown := [m.name for m in measures if m.name not in num]:
            raise ValueError(f"evaluate() asks for measures of one's own, one at a time: {', '.join(unknown)}")
        cols = [(num[m.name].cast("double") / F.lit(float(m.base(total_rows))) if m.base(total_rows) else F.lit(0.0)).alias(m.name) for m in measures]
        rows = plan.select(lhs.alias("lhs"), "rhs", "removals", "violating_pairs", *cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def single_level(columns: Sequence[str], size: int) -> list[tuple[frozenset, str]]:
    """Every candidate with `size` columns on the left."""
    from itertools import combinations

    return [(frozenset(x), a) for a in columns for x in combinations([c for c in columns if c != a], size)]
