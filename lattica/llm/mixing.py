"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised. Smaller exponents flatten the mixture; the smallest a
in [0, 1] is found by bisection for which the entropy does not exceed its target and no source repeats more often than
its limit. Exponents above 1 would leave parts of small sources out, so where 1 does not keep a limit the natural shares
stay, and a warning says which limit is missed. The weights become token budgets, and each source gives its documents in epochs, each a permutation of the
whole source, up to its budget; the stream of each source is cut to as many blocks as the mixture has, so that each
block holds the sources at the target weights, and the documents of a block are permuted.

A document's place in its source's stream is a prefix sum of tokens. It is taken in two steps, so that a hot source is
no single task: sums of hash ranges of some thousand documents first, then a window inside each range.

Up to MAX_SOURCES sources are planned on the driver. More of them stay a table: the driver gets how many sources have
each number of tokens, of which there are less than sqrt(2 * tokens), and finds the exponent from that.

Cases: a null source is a source of its own; null or empty texts have no tokens and take no budget; a long text is drawn
whole, over the budget if it is the last of its source; documents with the same hash of id and text are ordered by these, and
repeated rows, which are drawn like others, share a range; a corpus without tokens or an empty table gives an empty result;
other columns pass through, but those named n_tokens, epoch, block or slot, which are replaced.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: More sources are planned as a table.
MAX_SOURCES = 200_000
RANGE_ROWS = 2000


@dataclass(frozen=True)
class Mixture:
    exponent: float
    sources: tuple  # of (source, tokens, documents, weight, budget)
    budget: int
    unmet: tuple = ()  # a sentence for each limit that the weights miss


def entropy(weights: list[float], counts: list[int] | None = None) -> float:
    """counts: how many sources have each weight, by default one."""
    return -math.fsum(c * w * math.log(w) for w, c in zip(weights, counts or [1] * len(weights), strict=True) if w > 0)


def tempered(tokens: list[int], exponent: float, counts: list[int] | None = None) -> list[float]:
    """Shares raised to the exponent and normalised; a source without tokens gets none."""
    counts = counts or [1] * len(tokens)
    total = sum(t * c for t, c in zip(tokens, counts, strict=True))
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    whole = math.fsum(r * c for r, c in zip(raised, counts, strict=True))
    return [r / whole for r in raised]


def solve_exponent(tokens: list[int], budget: int, entropy_ratio: float | None, max_repetition: float | None, counts: list[int] | None = None) -> float:
    """The smallest exponent in [0, 1] that keeps entropy <= entropy_ratio * log(sources) and budget * weight <=
    max_repetition * tokens; 1 if none does. Both grow as the exponent falls, so bisection finds it."""
    n = sum(c for t, c in zip(tokens, counts or [1] * len(tokens), strict=True) if t > 0)

    def fine(a: float) -> bool:
        w = tempered(tokens, a, counts)
        if entropy_ratio is not None and entropy(w, counts) > entropy_ratio * math.log(n) + 1e-12:
            return False
        return max_repetition is None or all(budget * x <= max_repetition * t * (1 + 1e-12) for x, t in zip(w, tokens, strict=True))

    if n < 2 or fine(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fine(mid) else (mid, high)
    return high


def unmet_limits(tokens: list[int], weights: list[float], budget: int, entropy_ratio: float | None, max_repetition: float | None, counts: list[int] | None = None) -> tuple:
    out = []
    n = sum(c for t, c in zip(tokens, counts or [1] * len(tokens), strict=True) if t > 0)
    if entropy_ratio is not None and n > 1 and entropy(weights, counts) > entropy_ratio * math.log(n) + 1e-9:
        out.append(f"the entropy is {entropy(weights, counts) / math.log(n):.4f} of its maximum, above the target {entropy_ratio}, for the sources' own shares are flatter")
    most = max((budget * w / t for w, t in zip(weights, tokens, strict=True) if t), default=0.0)
    if max_repetition is not None and most > max_repetition * (1 + 1e-9):
        out.append(f"a source is drawn {most:.4f} times, above the limit {max_repetition}")
    return tuple(out)


def plan_mixture(stats: list[tuple], budget: int | None, entropy_ratio: float | None, max_repetition: float | None) -> Mixture:
    """stats: (source, tokens, documents). budget: tokens to draw, by default as many as there are."""
    stats = sorted(stats, key=lambda s: (s[0] is not None, s[0]))
    tokens = [s[1] for s in stats]
    total = budget or sum(tokens)
    if not sum(tokens):
        return Mixture(1.0, (), 0)
    a = solve_exponent(tokens, total, entropy_ratio, max_repetition)
    weights = tempered(tokens, a)
    unmet = unmet_limits(tokens, weights, total, entropy_ratio, max_repetition)
    return Mixture(a, tuple((s, t, n, w, w * total) for (s, t, n), w in zip(stats, weights, strict=True)), total, unmet)


def plan_table(stats: DataFrame, budget: int | None, entropy_ratio: float | None, max_repetition: float | None) -> tuple[Mixture, DataFrame]:
    """plan_mixture() of a table (source, t, n): the mixture without its sources, and stats with their budgets as b."""
    per = sorted((r["t"], r["c"]) for r in stats.filter("t > 0").groupBy("t").agg(F.count("*").alias("c")).collect())  # less than sqrt(2 * tokens) rows
    tokens, counts = [t for t, _ in per], [c for _, c in per]
    whole = sum(t * c for t, c in per)
    total = budget or whole
    if not whole:
        return Mixture(1.0, (), 0), stats.withColumn("b", F.lit(0.0))
    a = solve_exponent(tokens, total, entropy_ratio, max_repetition, counts)
    weights = tempered(tokens, a, counts)
    unmet = unmet_limits(tokens, weights, total, entropy_ratio, max_repetition, counts)
    budgets = stats.sparkSession.createDataFrame([(t, w * total) for t, w in zip(tokens, weights, strict=True)], "t long, b double")
    return Mixture(a, (), total, unmet), stats.join(budgets, "t")


def token_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, budget: int | None = None, entropy_ratio: float | None = 0.95, max_repetition: float | None = 2.0, block_tokens: int = 1 << 20, seed: int = 17, range_rows: int = RANGE_ROWS, max_sources: int = MAX_SOURCES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs drawn to the mixture: a row for each drawn copy, with n_tokens, epoch (0: first copy), block and slot (the
    order inside the block: sort by block, slot). Columns of docs with these names are replaced."""
    names = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block", "slot")]
    counted = docs.select(*names, token_count(F.col(text_col)).alias("n_tokens"))
    stats = counted.groupBy(source_col).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    spark = docs.sparkSession
    kind = docs.schema[source_col].dataType.simpleString()
    few = stats.limit(max_sources + 1).collect()
    if len(few) <= max_sources:
        mix = plan_mixture([(r[0], r["t"], r["n"]) for r in few], budget, entropy_ratio, max_repetition)
    else:
        many = stored(stats.select(F.col(source_col).alias("__mx_source"), "t", "n"), "sources")
        mix, given = plan_table(many, budget, entropy_ratio, max_repetition)
    for missed in mix.unmet:
        warnings.warn(f"mixture: {missed}", stacklevel=2)
    n_blocks = max(1, math.ceil(mix.budget / block_tokens))
    same = F.col(source_col).eqNullSafe(F.col("__mx_source"))
    if len(few) <= max_sources:
        plan = spark.createDataFrame(
            [(i, s, t, b, max(1, 1 << math.ceil(math.log2(max(1, n / range_rows)))), math.ceil(b / t - 1e-12)) for i, (s, t, n, _, b) in enumerate(mix.sources) if t and b > 0],
            f"__mx_id long, __mx_source {kind}, __mx_tokens long, __mx_budget double, __mx_ranges long, __mx_epochs int",
        )
        here = counted.join(F.broadcast(plan), same)  # at most max_sources rows
    else:
        ranges = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / range_rows)))).cast("long")
        epochs = F.ceil(F.col("b") / F.col("t") - 1e-12).cast("int")
        plan = stored(given.filter("t > 0 AND b > 0").select(F.monotonically_increasing_id().alias("__mx_id"), "__mx_source", "n", F.col("t").alias("__mx_tokens"), F.col("b").alias("__mx_budget"), ranges.alias("__mx_ranges"), epochs.alias("__mx_epochs")), "mixture-plan")
        # hot sources are sent, so that no task gets all rows of one: the most frequent, max_sources at most
        hot = stored(plan.filter(F.col("n") > range_rows).orderBy(F.desc("n"), F.xxhash64("__mx_source")).limit(max_sources), "mixture-hot")
        cold = plan.join(F.broadcast(hot.select(F.col("__mx_source").alias("__mx_hot"))), F.col("__mx_source").eqNullSafe(F.col("__mx_hot")), "left_anti")
        rest = counted.join(F.broadcast(hot.select("__mx_source")), same, "left_anti")
        here = counted.join(F.broadcast(hot.drop("n")), same).unionByName(rest.join(cold.drop("n"), same))
    here = here.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__mx_epochs") - 1)))
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    here = here.withColumn("__mx_u", F.xxhash64(F.lit(seed), "epoch", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_hash))
    unit = F.shiftrightunsigned("__mx_u", 11) * F.lit(2.0**-53)
    here = here.withColumn("__mx_range", F.floor(unit * F.col("__mx_ranges")))
    # no prefix sum needs the text: the sums come from a scan of their own. Rows are dealt once, by numbers: a key that can
    # be null would be dealt anew for the join
    key = ["__mx_id", "epoch", "__mx_range"]
    before = Window.partitionBy("__mx_id", "epoch").orderBy("__mx_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = here.groupBy(*key, "__mx_tokens").agg(F.sum("n_tokens").alias("__mx_sum"))
    sums = sums.select(*[F.col(k).alias(f"{k}_") for k in key], (F.coalesce(F.sum("__mx_sum").over(before), F.lit(0)) + F.col("epoch") * F.col("__mx_tokens")).alias("__mx_start"))
    inside = Window.partitionBy(*key).orderBy("__mx_u", F.col(id_col).asc_nulls_first(), text_hash).rowsBetween(Window.unboundedPreceding, -1)
    placed = here.withColumn("__mx_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(sums, [F.col(k) == F.col(f"{k}_") for k in key])
    place = F.col("__mx_start") + F.col("__mx_in")
    drawn = placed.filter(place < F.col("__mx_budget"))
    block = F.least(F.floor(place / F.col("__mx_budget") * n_blocks), F.lit(n_blocks - 1)).cast("long")
    slot = F.xxhash64(F.lit(seed + 1), F.col("__mx_u"))
    return drawn.select(*names, "n_tokens", "epoch", block.alias("block"), slot.alias("slot"))
