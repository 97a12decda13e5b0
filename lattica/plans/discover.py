"""Discovery of all minimal approximate dependencies X -> A with error <= epsilon, X not empty.

Two searches with the same, complete result:

levelwise   Level k asks every X of k columns that has no valid proper subset; a level is a few grouping jobs.
            Supersets of a key are never asked for what the key determines, and a candidate is known without a job when
            its distinct counts decide it. Violations only grow with rows, so what a quarter of a large table already
            rejects is rejected, exactly; only the rest is asked of the whole table.
bestfirst   For each A, dualise and advance: the minimal sets that no known invalid set contains are tested; an invalid
            one is grown to a maximal invalid set along the largest errors, as a sample estimates them; the search ends
            when all of them are valid. It asks little where valid sets are large. Several steps of growth are asked at
            once, along the estimates.

An estimate only orders the search, it never decides. sampling names how rows are drawn for it ("random", "focused",
"neyman", or a strategy of one's own); "none" estimates by exact errors.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columnsets import MaximalFamily, MinimalFamily, indices, mask_of, minimal_hitting_sets
from ..operators.encoding import Encoded, encoded, span_columns
from ..operators.levels import CHUNK, Found, evaluate, evaluate_dealt
from ..operators.measures import G1, G3, Measure, measure_named
from ..operators.partitions import check_columns
from ..operators.sampling import SEED, Estimator, SmallEstimator, Strategy, drawn_by, sample_size

RESULT = T.StructType(
    [
        T.StructField("lhs", T.StringType()),
        T.StructField("lhs_cols", T.ArrayType(T.StringType())),
        T.StructField("rhs", T.StringType()),
        T.StructField("error", T.DoubleType()),
        T.StructField("removals", T.LongType()),
        T.StructField("violating_pairs", T.LongType()),
    ]
)


@dataclass
class Discovery:
    """The dependencies as rows, and what the search did."""

    rows: list[tuple]
    validations: int
    seconds: float
    total_rows: int
    levels: list[dict] = field(default_factory=list)

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, RESULT)

    def pairs(self) -> set[tuple[frozenset, str]]:
        return {(frozenset(r[1]), r[2]) for r in self.rows}

    def show(self, limit: int = 10) -> list[str]:
        """The lowest errors as lines, then the total."""
        best = sorted(self.rows, key=lambda r: (r[3], r[0], r[2]))[:limit]
        return [f"{{{r[0]}}} -> {r[2]} ({r[3]:.6f})" for r in best] + [f"{len(self.rows)} dependencies"]


def _input_splits(df: DataFrame) -> int:
    """About how many tasks read the table, by the size that the optimizer knows."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, size // df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


class Profile:
    """A table ready for search: its columns only, equal rows counted once if that pays, large tables as integer codes;
    kept between jobs."""

    #: Tables of so many rows are encoded, and thinned to a part in so many for a first look.
    ENCODE_ROWS, THIN = 100_000, 4
    #: A column is dealt by if no value has more than one of EVEN rows; columns of few values are counted together while
    #: their combinations are under one of SMALL rows.
    EVEN, SMALL = 256, 16

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, cast_all_string: bool = False, preaggregate: bool | None = None, encode: bool | None = None):
        self.columns = check_columns(df, columns or df.columns)
        data = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if cast_all_string else F.col(f"`{c}`") for c in self.columns])
        self.weight = None
        counted = data.groupBy(*[f"`{c}`" for c in self.columns]).agg(F.count("*").alias("__rows"))
        # one scan: rows, and how many differ, for counting equal rows once pays if they repeat
        distinct = [F.approx_count_distinct(F.struct(*[f"`{c}`" for c in self.columns])).alias("d")] if preaggregate is None and self.columns else []
        seen = data.agg(F.count("*").alias("n"), *distinct, *span_columns(data, self.columns)).first()
        self.total_rows = seen["n"]
        if preaggregate or distinct and seen["d"] < 0.5 * seen["n"]:
            data, self.weight = counted, "__rows"
        self.encoded: Encoded | None = None
        if (self.total_rows >= self.ENCODE_ROWS if encode is None else encode) and self.columns:
            self.encoded = encoded(data, self.columns, [self.weight] if self.weight else [], seen)
            # few input splits would leave cores idle in every level: a slim table is dealt once
            cores = df.sparkSession.sparkContext.defaultParallelism
            if _input_splits(df) < cores:
                data = self.encoded.data.repartition(cores)
            else:
                data = self.encoded.data
        self.data = data.persist(StorageLevel.MEMORY_AND_DISK)  # recomputed from the input where an executor is lost
        self.table = Encoded(self.data, self.encoded.bits) if self.encoded else self.data
        self.thin: Encoded | None = None
        if self.encoded:
            part = F.pmod(F.xxhash64(*[f"`{c}`" for c in self.columns]), F.lit(self.THIN)) == 0
            self.thin = Encoded(self.data.filter(part), self.encoded.bits)
        #: Of each column: its values, the rows of the most frequent one, and the most rows of self.data with one value.
        self.values: dict[str, tuple[int, int, int]] = {}
        self.data_rows = self.total_rows  # fewer if equal rows are counted once
        self.small: Encoded | None = None
        self.small_columns: frozenset = frozenset()

    def count_values(self) -> None:
        """Fills values, and small: the columns of few values with the number of rows of each combination."""
        w = F.col(f"`{self.weight}`") if self.weight else F.lit(1).cast("long")
        codes = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("long").alias("v")) for i, c in enumerate(self.columns)])
        each = self.data.select(w.alias("w"), F.inline(codes)).groupBy("i", "v").agg(F.sum("w").alias("c"), F.count("*").alias("r"))
        for x in each.groupBy("i").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.max("r").alias("r"), F.sum("r").alias("rows")).collect():
            self.values[self.columns[x["i"]]] = (x["n"], x["c"], x["r"])
            self.data_rows = x["rows"]
        few, size = [], 1
        for c in sorted(self.values, key=lambda c: (self.values[c][0], c)):
            size *= self.values[c][0]
            if size * self.SMALL > self.data_rows:
                break
            few.append(c)
        if len(few) > 1:
            counts = self.data.groupBy(*[f"`{c}`" for c in few]).agg(F.sum(w).cast("long").alias("__rows"))
            self.small = Encoded(counts.persist(StorageLevel.MEMORY_AND_DISK), self.encoded.bits)
            self.small_columns = frozenset(few)

    def dealt_by(self, lhs: frozenset) -> str | None:
        """The column of the most values to deal the rows by, if it is spread evenly enough."""
        best = max(lhs, key=lambda c: (self.values[c][0], c))
        return best if self.values[best][2] * self.EVEN <= self.data_rows else None

    def rows(self, id_col: str) -> DataFrame:
        """Each row of the table, with a number that only equal rows share: they are interchangeable in a sample."""
        data = self.data
        if self.weight:
            data = data.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(self.weight))))
        number = F.xxhash64(*[F.col(f"`{c}`") for c in self.columns], *([F.col("__copy")] if self.weight else []))
        return data.select(*[F.col(f"`{c}`") for c in self.columns], number.alias(id_col))

    def close(self) -> None:
        self.data.unpersist()
        if self.small:
            self.small.data.unpersist()

    def __enter__(self) -> Profile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _row(found: Found, error: float) -> tuple:
    cols = sorted(found.lhs)
    return (",".join(cols), cols, found.rhs, error, found.removals, found.violating_pairs)


def _check(eps: float, max_lhs: int | None) -> None:
    if not 0 <= eps <= 1:
        raise ValueError("epsilon must lie in 0 to 1")
    if max_lhs is not None and max_lhs < 1:
        raise ValueError("max_lhs must be at least 1")


def discover(df: DataFrame, eps: float = 0.05, measure: str | Measure = "g3", max_lhs: int | None = None, columns: Sequence[str] | None = None, rhs: Sequence[str] | None = None, search: str = "levelwise", cast_all_string: bool = False, chunk: int = CHUNK, sampling: str | Strategy = "random", sample_param: float = 200, seed: int = SEED) -> Discovery:
    """All minimal dependencies with at most max_lhs columns on the left and a right-hand side among rhs. sampling and
    sample_param (rows, or under 1 a share) hold for the best-first search."""
    _check(eps, max_lhs)
    drawn_by(sampling)
    sample_size(1, sample_param)
    if search not in SEARCHES:
        raise ValueError(f"no search named {search}; there are {', '.join(SEARCHES)}")
    began = time.perf_counter()
    with Profile(df, columns, cast_all_string) as profile:
        targets = check_columns(df, rhs) if rhs else profile.columns
        if not set(targets) <= set(profile.columns):
            raise ValueError("right-hand sides must be among the columns")
        limit = min(max_lhs or len(profile.columns), max(0, len(profile.columns) - 1))
        found = SEARCHES[search](profile, eps, measure_named(measure), limit, targets, chunk, (sampling, sample_param, seed))
    found.seconds = time.perf_counter() - began
    return found


def _levelwise(profile: Profile, eps: float, measure: Measure, limit: int, targets: list[str], chunk: int, drawing: tuple) -> Discovery:
    n, columns = profile.total_rows, profile.columns
    valid = {a: MinimalFamily() for a in targets}
    out = Discovery([], 0, 0.0, n)
    groups: dict[frozenset, int] = {}
    if profile.encoded and measure.grows:
        profile.count_values()
        groups = {frozenset((c,)): v[0] for c, v in profile.values.items()}
    # what a level extends: for each A the sets that were invalid, by prefix join
    open_sets: dict[str, set[frozenset]] = {a: {frozenset((c,)) for c in columns if c != a} for a in targets}
    for size in range(1, limit + 1):
        asked, known = [], {}
        for a in targets:
            for x in open_sets[a]:
                d = groups.get(x)
                if d is not None and d == n:  # a key determines everything
                    known[x, a] = Found(x, a, 0, 0, d, d, 0.0)
                elif not _hopeless(groups, profile.values, x, a, measure, eps, n):
                    asked.append((x, a))
                # else: certainly over epsilon, and stays open for its supersets
        first = len(asked)
        out.validations += first
        results, small = dict(known), [c for c in asked if c[0] | {c[1]} <= profile.small_columns]
        if small:
            results |= evaluate(profile.small, small, "__rows", chunk, measure)
        dealt: dict[str, list] = {}
        for c in asked if profile.values else []:
            if not c[0] | {c[1]} <= profile.small_columns and profile.table.fits((*c[0], c[1])) and (by := profile.dealt_by(c[0])):
                dealt.setdefault(by, []).append(c)
        for by, those in sorted(dealt.items()):
            results |= evaluate_dealt(profile.table, those, by, n, eps, profile.weight, chunk, measure)
        others = {*small, *(c for those in dealt.values() for c in those)}
        asked = [c for c in asked if c not in others]
        if profile.thin and asked and measure.grows:
            # where X may have as many values as the table rows, a part of them would show few violations
            low = [c for c in asked if sum(profile.thin.bits[x] for x in c[0]) < math.log2(n)]
            look = evaluate(profile.thin, low, profile.weight, chunk, measure)
            asked = [c for c in asked if c not in look or look[c].error(measure, n) <= eps]
        results |= evaluate(profile.table, asked, profile.weight, chunk, measure)
        whole = len(results) - len(known)
        out.levels.append({"level": size, "asked": whole, "known": len(known), "rejected early": first - whole})
        for (x, a), f in results.items():
            groups[x] = f.lhs_groups
            groups[x | {a}] = f.node_groups
            e = f.error(measure, n)
            if e <= eps:
                valid[a].add(mask_of(columns.index(c) for c in x))
                open_sets[a].discard(x)
                out.rows.append(_row(f, e))
        if size == limit:
            break
        for a in targets:
            open_sets[a] = _next_level(open_sets[a])
        # an X whose every A is decided is no longer looked at
        if not any(open_sets.values()):
            break
    out.rows.sort(key=lambda r: (r[2], len(r[1]), r[0]))
    return out


def _hopeless(groups: dict[frozenset, int], values: dict[str, tuple[int, int, int]], x: frozenset, a: str, measure: Measure, eps: float, n: int) -> bool:
    """A group of X with d values of A loses d - 1 rows at least, so removals >= distinct(X u A) - distinct(X); and it keeps
    the rows of one value of A at most, so removals >= n - distinct(X) times the rows of A's most frequent value. Where a
    count is not known, bounds from smaller sets serve."""
    base = measure.base(n)
    if measure is not G3 or base <= 0:
        return False
    most = groups.get(x)
    if most is None and x <= values.keys():
        most = min(n, math.prod(values[c][0] for c in x))
    if most is None:
        return False
    least = groups.get(x | {a}) or max((groups.get(frozenset((c,)), 0) for c in (*x, a)), default=0)
    kept = most * values[a][1] if a in values else n
    return max(least - most, n - kept) / base > eps


def _next_level(sets: set[frozenset]) -> set[frozenset]:
    """Sets of one column more whose every subset of one less is there."""
    by_prefix: dict[tuple, list] = {}
    for s in sets:
        t = sorted(s)
        by_prefix.setdefault(tuple(t[:-1]), []).append(t[-1])
    out = set()
    for prefix, lasts in by_prefix.items():
        for a, b in combinations(sorted(lasts), 2):
            s = frozenset((*prefix, a, b))
            if all(s - {c} in sets for c in s):
                out.add(s)
    return out


#: Steps of growth that one job asks for, for each set that grows.
AHEAD = 3


def _bestfirst(profile: Profile, eps: float, measure: Measure, limit: int, targets: list[str], chunk: int, drawing: tuple) -> Discovery:
    n, columns = profile.total_rows, profile.columns
    number = {c: i for i, c in enumerate(columns)}
    out = Discovery([], 0, 0.0, n)
    memo: dict[tuple[int, str], Found] = {}
    estimated: dict[tuple[int, str], float] = {}
    names: dict[int, frozenset] = {}
    estimator = _estimator(profile, measure, *drawing)

    def named(mask: int) -> frozenset:
        if mask not in names:
            names[mask] = frozenset(columns[i] for i in indices(mask))
        return names[mask]

    def exact(asked: set[tuple[int, str]]) -> int:
        new = [(named(m), a) for m, a in sorted(asked) if (m, a) not in memo]
        if not new:
            return 0
        for (x, a), f in evaluate(profile.table, new, profile.weight, chunk, measure).items():
            memo[mask_of(number[c] for c in x), a] = f
        return len(new)

    def estimate(asked: set[tuple[int, str]]) -> None:
        if estimator is None:
            exact(asked)
            estimated.update({k: memo[k].error(measure, n) for k in asked})
        else:
            new = [k for k in sorted(asked) if k not in estimated]
            found = estimator.errors([(named(m), a) for m, a in new])
            estimated.update({(m, a): found[named(m), a] for m, a in new})

    def fine(mask: int, a: str) -> bool:
        return memo[mask, a].error(measure, n) <= eps

    def best(now: int, a: str, rest: list[int]) -> int:
        return max(rest, key=lambda i: (estimated[now | 1 << i, a], -i))

    def ahead(climb: dict[tuple[int, str], int], tried: dict[tuple[int, str], int]) -> dict[tuple[int, str], list[int]]:
        """For each set that grows the columns of its next steps, if all of these are invalid."""
        paths: dict[tuple[int, str], list[int]] = {k: [] for k in climb}
        for _ in range(AHEAD):
            ends = {k: climb[k] | mask_of(paths[k]) for k in climb}
            rest = {k: [i for i in indices(every[k[1]] & ~ends[k] & ~tried[k])] for k in climb if ends[k].bit_count() < limit}
            rest = {k: r for k, r in rest.items() if r}
            if not rest:
                break
            estimate({(ends[k] | 1 << i, k[1]) for k, r in rest.items() for i in r})
            for k, r in rest.items():
                paths[k].append(best(ends[k], k[1], r))
        return paths

    def steps(climb: dict[tuple[int, str], int], paths: dict[tuple[int, str], list[int]]) -> set[tuple[int, str]]:
        return {(climb[k] | mask_of(path[: j + 1]), k[1]) for k, path in paths.items() for j in range(len(path))}

    invalid = {a: MaximalFamily() for a in targets}
    every = {a: mask_of(number[c] for c in columns if c != a) for a in targets}
    done: set[str] = set()
    try:
        while len(done) < len(targets):
            hits = {a: [m for m in minimal_hitting_sets(every[a] & ~x for x in invalid[a]) if m.bit_count() <= limit] if len(invalid[a]) else [1 << i for i in indices(every[a])] for a in targets if a not in done}
            hits = {a: [m for m in ms if m] for a, ms in hits.items()}
            # with them the growth of those that the estimates call invalid
            first = {(m, a): m for a, ms in hits.items() for m in ms}
            estimate(set(first))
            guess = {k: m for k, m in first.items() if estimated[k] > eps}
            out.validations += exact(set(first) | steps(guess, ahead(guess, dict.fromkeys(guess, 0))))
            climb: dict[tuple[int, str], int] = {}
            for a, ms in hits.items():
                bad = [m for m in ms if not fine(m, a)]
                if not bad:
                    done.add(a)
                    for m in ms:
                        out.rows.append(_row(memo[m, a], memo[m, a].error(measure, n)))
                for m in bad:
                    climb[m, a] = m
            # grow each invalid set, all of them side by side: the column whose estimate stays largest first
            tried: dict[tuple[int, str], int] = dict.fromkeys(climb, 0)
            while climb:
                paths = ahead(climb, tried)
                for (_, a), now in ((k, climb[k]) for k in climb if not paths[k]):
                    invalid[a].add(now)
                out.validations += exact(steps(climb, paths))
                grown = {}
                for k, path in paths.items():
                    now = climb[k]
                    for i in path:
                        if fine(now | 1 << i, k[1]):
                            tried[k] |= 1 << i  # and so is every larger set with it
                            break
                        now |= 1 << i
                    if path:
                        grown[k] = now
                climb = grown
    finally:
        if estimator is not None:
            estimator.close()
    out.rows.sort(key=lambda r: (r[2], len(r[1]), r[0]))
    out.levels.append({"level": 0, "asked": out.validations, "estimated": len(estimated), "mean estimate": math.fsum(estimated.values()) / max(1, len(estimated))})
    return out


def _estimator(profile: Profile, measure: Measure, sampling: str | Strategy, param: float, seed: int) -> Estimator | SmallEstimator | None:
    """None: estimates are exact errors."""
    if drawn_by(sampling) is None or not measure.sampled or not profile.columns:
        return None
    n = profile.total_rows
    rows = profile.rows("__row")
    if sampling == "random" and measure in (G3, G1) and sample_size(n, param) <= SmallEstimator.MOST_ROWS:
        return SmallEstimator(rows, "__row", profile.columns, param, seed, measure, n)
    return Estimator(rows, "__row", profile.columns, sampling, param, seed, measure, n)


SEARCHES: dict[str, Callable[..., Discovery]] = {"levelwise": _levelwise, "bestfirst": _bestfirst}


def duplication(df: DataFrame, column: str, measure: str | Measure = "g3") -> float:
    """The measure for an empty left-hand side: how much the column repeats itself. Never part of a discovery."""
    from ..operators.measures import error

    return error(df, [], column, measure)


__all__ = ["Discovery", "Profile", "RESULT", "SEARCHES", "discover", "duplication"]
