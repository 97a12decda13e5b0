import random

import pytest

from lattica.plans import compare
from lattica.plans.discover import discover
from tests.fixtures import GRID, VOYAGES, brute_minimal, cells, voyages

SEARCHES = ["levelwise", "bestfirst"]


def by_definition(rows, names, eps, which=0, max_lhs=None):
    return {(frozenset(names[c] for c in x), names[a]): e for (x, a), e in brute_minimal(rows, len(names), eps, which, max_lhs).items()}


@pytest.mark.parametrize("eps, measure", [(0.0, "g3"), (0.05, "g3"), (0.15, "g3"), (0.05, "g1")])
def test_voyages(spark, eps, measure):
    df = voyages(spark)
    a, b = (discover(df, eps, measure, search=s) for s in SEARCHES)
    assert {(frozenset(r[1]), r[2]): r[3] for r in a.rows} == by_definition(cells(VOYAGES), df.columns, eps, int(measure == "g1")) and a.rows == b.rows
    assert a.validations < 6 * 31


@pytest.mark.parametrize("search", SEARCHES)
def test_grid(spark, search):
    df = spark.createDataFrame(GRID, "A string, B string, C string, D string")
    for eps in (0.1, 0.3):
        assert discover(df, eps, search=search).pairs() == set(by_definition(GRID, "ABCD", eps))
    only = discover(df, 0.1, rhs=["D"], search=search)
    assert only.pairs() == {k for k in by_definition(GRID, "ABCD", 0.1) if k[1] == "D"} and (frozenset("B"), "D") in only.pairs()


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("search", SEARCHES)
def test_random_tables_equal_brute_force(spark, seed, search):
    rnd = random.Random(seed)
    k, n = rnd.randint(3, 5), rnd.randint(2, 14)
    rows = [tuple(rnd.randrange(rnd.choice([2, 3, 4])) for _ in range(k)) for _ in range(n)]
    cols = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    eps, which = [(0.0, 0), (0.05, 0), (0.15, 0), (0.3, 0), (0.05, 1), (0.15, 1)][seed]
    limit = None if seed % 2 else 2
    limit = min(limit or k - 1, k - 1)
    expected = brute_minimal(rows, k, eps, which, limit)
    got = discover(df, eps, ("g3", "g1")[which], max_lhs=limit, search=search)
    assert {(frozenset(cols.index(c) for c in r[1]), cols.index(r[2])): r[3] for r in got.rows} == expected


def test_constant_and_key_columns(spark):
    df = spark.createDataFrame([(i, "c", i % 3) for i in range(9)], "k int, c string, v int")
    found = discover(df, 0.0)
    assert found.pairs() == {(frozenset(["k"]), "c"), (frozenset(["k"]), "v"), (frozenset(["v"]), "c")}


def test_generated_grid(spark):
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(f"val{r % 4}_{i}" for i in range(6)) for r in range(20)], cols)
    found = discover(df, 0.05)
    assert len(found.rows) == 6 * 5 and all(r[3] == 0 and len(r[1]) == 1 for r in found.rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "a int, b int")
    assert discover(empty, 0.0).pairs() == {(frozenset("a"), "b"), (frozenset("b"), "a")}
    one = spark.createDataFrame([(1,)], "a int")
    assert discover(one, 0.0).rows == []
    for bad in ({"eps": -1}, {"eps": 0.1, "max_lhs": 0}, {"eps": 0.1, "search": "none"}, {"eps": 0.1, "columns": ["zz"]}):
        with pytest.raises(ValueError):
            discover(empty, **bad)
    nulls = spark.createDataFrame([(None, "x"), ("", "x"), (None, "y")], "a string, b string")
    assert discover(nulls, 0.5, cast_all_string=True).pairs() == {(frozenset("a"), "b"), (frozenset("b"), "a")}


def test_compare(spark):
    rows = cells(VOYAGES)
    wide, exact = (set(by_definition(rows, VOYAGES.split("\n", 1)[0].split(","), e)) for e in (0.15, 0.0))
    a = discover(voyages(spark), 0.15).to_df(spark)
    b = discover(voyages(spark), 0.0).to_df(spark)
    assert compare.common(a, b).count() == len(wide & exact) and compare.only(a, b).count() == len(wide - exact) and compare.only(b, a).count() == len(exact - wide)
    assert compare.merged(a, b).count() == len(wide | exact)
    top = compare.top_by_error(a, 3).collect()
    assert [r["error"] for r in top] == [0, 0, 0]
    assert compare.minimal(a).count() == len(wide)
    lines = discover(voyages(spark), 0.15).show(2)
    assert len(lines) == 3 and lines[-1] == f"{len(wide)} dependencies"


def test_large_tables_take_the_same_path(spark, monkeypatch):
    from lattica.plans.discover import Profile

    rnd = random.Random(9)
    rows = [(rnd.randrange(40), rnd.choice("abc"), rnd.randrange(3), i // 7, None if i % 3 else 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, c int, d int, e double")
    for eps, measure in ((0.05, "g3"), (0.3, "g3"), (0.02, "g1")):
        plain = discover(df, eps, measure)
        with monkeypatch.context() as m:
            m.setattr(Profile, "ENCODE_ROWS", 1)
            large = discover(df, eps, measure)
            assert large.rows == plain.rows == discover(df, eps, measure, search="bestfirst").rows
    assert sum(x["rejected early"] for x in large.levels) > 0


@pytest.mark.parametrize("eps, measure", [(0.05, "g3"), (0.3, "g3"), (0.02, "g1")])
@pytest.mark.parametrize("repeat", [1, 3])
def test_dealt_by_a_column_of_the_left_hand_side(spark, monkeypatch, eps, measure, repeat):
    from lattica.plans import discover as module

    rnd = random.Random(4)
    rows = [(i // 4, i % 4 if i % 50 else None, rnd.randrange(30), rnd.choice("xy"), 0 if i < 250 else i) for i in range(400)] * repeat
    df = spark.createDataFrame(rows, "order int, line int, supplier int, flag string, hot int")
    plain = discover(df, eps, measure, max_lhs=3)
    asked, dealt = [], []
    for name, seen in (("evaluate", asked), ("evaluate_dealt", dealt)):
        monkeypatch.setattr(module, name, lambda t, c, *x, f=getattr(module, name), seen=seen, **k: seen.extend((y, *x[:1]) for y in c) or f(t, c, *x, **k))
    for k, v in (("ENCODE_ROWS", 1), ("EVEN", 10), ("SMALL", 4)):
        monkeypatch.setattr(module.Profile, k, v)
    assert discover(df, eps, measure, max_lhs=3).rows == plain.rows
    assert {by for _, by in dealt} <= {"order", "supplier"} and dealt  # not by the column with a hot value
    assert not any("order" in x for (x, _), *_ in asked if "hot" not in x)
    if measure == "g3":  # two flags can't tell 100 orders: known without a job
        assert (frozenset(["flag"]), "order") not in [c for c, *_ in asked + dealt]


def test_dealt_rows_are_shuffled_once(spark):
    from lattica.operators.encoding import encoded
    from lattica.operators.levels import packed_plan

    df = spark.createDataFrame([(i // 4, i % 3, i % 5) for i in range(400)], "a int, b int, c int")
    plan, _ = packed_plan(encoded(df, df.columns), [(frozenset("ab"), "c"), (frozenset("a"), "b")], by="a", rows=400)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(a#") == 1 and text.count("Exchange ") == 2  # and one for the sums


@pytest.mark.parametrize("sampling, param", [("none", 200), ("random", 5), ("random", 0.5), ("focused", 6), ("neyman", 0.7)])
def test_sampling_never_decides(spark, sampling, param):
    df = voyages(spark).select("ship", "port", "berth", "cargo")
    got = discover(df, 0.15, max_lhs=2, search="bestfirst", sampling=sampling, sample_param=param)
    assert got.rows == discover(df, 0.15, max_lhs=2).rows
    assert got.levels[-1]["estimated"] > 0


def test_exact_estimates_of_g1(spark):
    df = voyages(spark)
    assert discover(df, 0.15, "g1", max_lhs=3, search="bestfirst").rows == discover(df, 0.15, "g1", max_lhs=3).rows


def test_strategies_of_ones_own(spark):
    from pyspark.sql import functions as F

    from lattica.operators.sampling import Sample

    asked = []

    def third(df, id_col, lhs, rhs, param, seed, total_rows):
        asked.append((tuple(lhs), rhs))
        return Sample(df.filter(F.pmod(F.col(id_col), F.lit(3)) == 0), max(1, total_rows // 3), total_rows)

    df = voyages(spark).select("ship", "port", "berth", "cargo")
    got = discover(df, 0.05, max_lhs=2, search="bestfirst", sampling=third)
    assert got.rows == discover(df, 0.05, max_lhs=2).rows and asked and all(rhs not in lhs for lhs, rhs in asked)
    for bad in ({"sampling": "best"}, {"sample_param": 0}):
        with pytest.raises(ValueError):
            discover(df, 0.05, search="bestfirst", **bad)


def test_measures_of_ones_own(spark):
    """The share of X groups that hold more than one A."""
    from pyspark.sql import functions as F

    from lattica.operators.measures import Measure, error

    mixed = Measure("mixed", lambda s, m, q: F.when(s > m, m).otherwise(0), lambda s: s - 1, lambda n: n)
    rows, df = cells(VOYAGES), voyages(spark)

    def definition(x, a):
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[c] for c in x), []).append(r[a])
        return sum(max(map(g.count, g)) for g in groups.values() if len(set(g)) > 1) / len(rows)

    assert error(df, ["port"], "berth", mixed) == definition((1,), 3) and error(df, [], "port", mixed) == 0.7
    found = discover(df, 0.3, mixed, max_lhs=2)
    assert found.rows and found.rows == discover(df, 0.3, mixed, max_lhs=2, search="bestfirst", sampling="random", sample_param=8).rows
    for _, cols, rhs, e, *_ in found.rows:
        assert e == definition([df.columns.index(c) for c in cols], df.columns.index(rhs)) <= 0.3


def test_estimators_agree(spark):
    """The driver's estimates equal the distributed ones, and those of estimate_error()."""
    from pyspark.sql import functions as F

    from lattica.operators import sampling
    from lattica.operators.measures import G3

    rnd = random.Random(3)
    rows = [(rnd.randrange(9), rnd.choice(["a", "b", None]), rnd.randrange(4), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, c int, d int").withColumn("id", F.col("d"))
    asked = [(frozenset(x), a) for x, a in ((("a",), "b"), (("a", "b"), "c"), (("d",), "a"))]
    small = sampling.SmallEstimator(df, "id", ["a", "b", "c", "d"], 60, 5, G3, 300).errors(asked)
    whole = sampling.Estimator(df, "id", ["a", "b", "c", "d"], "random", 60, 5, G3, 300)
    assert small == pytest.approx(whole.errors(asked))
    whole.close()
    seen = set()
    for name in ("random", "focused", "neyman"):
        e = sampling.Estimator(df, "id", ["a", "b", "c", "d"], name, 60, 5, G3, 300)
        got = e.errors(asked)
        seen.add(tuple(got.values()))
        e.close()
        for (x, a), v in got.items():
            assert v == pytest.approx(sampling.estimate_error(df, "id", sorted(x), a, name, 60, 5).first()["g3"])
    assert len(seen) == 3
