import random
from itertools import combinations

import pytest

from lattica.operators import encoding, levels, measures, partitions
from tests.fixtures import GRID, LETTERS, TILES, VOYAGES, brute_alone, brute_errors, brute_partition, cells, voyages


NAMES = VOYAGES.split("\n", 1)[0].split(",")


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_errors_by_definition(spark, size):
    df, rows = voyages(spark), cells(VOYAGES)
    for rhs in (1, 3, 5):
        for lhs in list(combinations([c for c in range(6) if c != rhs], size))[:4]:
            r = measures.errors(df, [NAMES[c] for c in lhs], NAMES[rhs]).first()
            assert (r["g3"], r["g1"]) == (brute_errors(rows, lhs, rhs) if lhs else brute_alone(rows, rhs))
            assert r["total_rows"] == 10


def test_known_errors(spark):
    df = voyages(spark)
    assert measures.error(df, ["pilot"], "port") == 0 and measures.error(df, ["port"], "pilot") == 1 / 9
    tiles = spark.createDataFrame(TILES, "id int, wood string, size string, tone string")
    assert measures.error(tiles, ["wood"], "tone") == 1 / 5 and measures.error(tiles, ["wood"], "tone", "g1") == 4 / 30


def test_stripped_partitions(spark):
    for rows, names in ((TILES, ("id", "wood", "size", "tone")), (LETTERS, ("id", "letter", "word"))):
        df = spark.createDataFrame(rows, list(names))
        for size in (1, 2):
            for at in combinations(range(1, len(names)), size):
                want = brute_partition(rows, at)
                cols = [names[c] for c in at]
                assert sorted(r["members"] for r in partitions.clusters(df, cols, "id").collect()) == want
                got = {}
                for r in partitions.cluster_members(df, cols, "id").collect():
                    got.setdefault(r["cluster_id"], []).append((r["position"], r["id"]))
                assert sorted([i for _, i in sorted(m)] for m in got.values()) == want
                assert all([p for p, _ in sorted(m)] == list(range(1, len(m) + 1)) for m in got.values())
                assert sorted(r["cluster_size"] for r in partitions.product(df, cols[:1], cols[1:]).collect()) == sorted(map(len, want))


def test_separators_do_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert partitions.stripped(df, ["x", "y"]).count() == 0
    assert partitions.is_superkey(df, ["x", "y"])


def test_attribute_vector(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "z")], "id int, v string")
    got = {r["id"]: r["cluster_id"] for r in partitions.attribute_vector(df, ["v"], "id").collect()}
    assert got == {4: 1, 5: 1, 1: 2, 3: 2, 2: 0, 6: 0}


def test_statistics_and_grouping_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 2), (None, None)], "a int, b int")
    got = {r["columns"]: (r["clusters"], r["partition_size"], r["distinct_groups"], r["total_rows"]) for r in partitions.statistics(df, [["a"], ["b"], ["a", "b"]]).collect()}
    assert got == {"a": (2, 4, 2, 4), "b": (1, 3, 2, 4), "a,b": (1, 2, 3, 4)}


def test_wide_grouping(spark):
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple((r >> i) & 1 for i in range(12)) for r in range(50)], cols)
    sets = [[c] for c in cols] + [[a, b] for a, b in zip(cols, cols[1:])]
    got = {r["columns"]: r["distinct_groups"] for r in partitions.statistics(df, sets).collect()}
    assert len(got) == 23 and got["c0"] == 2 and got["c0,c1"] == 4 and got["c11"] == 1


@pytest.mark.parametrize("seed", range(4))
def test_levels_equal_definitions(spark, seed):
    rnd = random.Random(seed)
    k = rnd.randint(3, 5)
    rows = [tuple(rnd.choice([None, "a", "b", "c"]) for _ in range(k)) for _ in range(rnd.randint(2, 14))]
    cols = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    cands = [c for size in (1, 2) for c in levels.single_level(cols, size)]
    codes = encoding.encoded(df, cols)
    assert levels.evaluate(codes, cands, chunk=4) == levels.evaluate(encoding.Encoded(codes.data, dict.fromkeys(cols, 40)), cands) == levels.evaluate(df, cands)
    for (x, a), f in levels.evaluate(df, cands, chunk=4).items():
        g3, g1 = brute_errors(rows, [cols.index(c) for c in sorted(x)], cols.index(a))
        n = len(rows)
        assert f.removals / (n - 1) == g3 and f.violating_pairs / (n * (n - 1)) == g1
        assert f.lhs_groups == len({tuple(r[cols.index(c)] for c in sorted(x)) for r in rows})
        assert f.node_groups == len({tuple(r[cols.index(c)] for c in sorted(x | {a})) for r in rows})
        single = measures.errors(df, sorted(x), a).first()
        assert (single["removals"], single["violating_pairs"]) == (f.removals, f.violating_pairs)


def test_empty_and_one_row(spark):
    for rows in ([], [("a", "b")]):
        df = spark.createDataFrame(rows, "x string, y string")
        assert measures.error(df, ["x"], "y") == 0 and measures.error(df, ["x"], "y", "g1") == 0 and measures.error(df, [], "y") == 0


def test_majority_and_removals(spark):
    df = spark.createDataFrame([(1, "x", "b"), (2, "x", "a"), (3, "x", None), (4, "y", None), (5, "y", None), (6, "y", "q")], "id int, k string, v string")
    assert {r["k"]: (r["majority_value"], r["majority_rows"], r["group_rows"]) for r in measures.majority(df, ["k"], "v").collect()} == {"x": ("a", 1, 3), "y": (None, 2, 3)}
    assert sorted(r["id"] for r in measures.rows_to_remove(df, ["k"], "v").collect()) == [1, 3, 6]


def test_thresholds_and_validation(spark):
    assert measures.dynamic_threshold(["a", "b", "a"], {"a": 0.1, "b": 0.2}) == pytest.approx(0.3)
    with pytest.raises(ValueError):
        measures.dynamic_threshold(["a"], {"a": 1.5})
    df = spark.createDataFrame(GRID, "A string, B string, C string, D string")
    assert measures.error(df, ["A"], "B") == 2 / 6 and measures.error(df, ["A"], "B", "g1") == 4 / 42
    for lhs, rhs in ((["A"], "A"), (["nope"], "A")):
        with pytest.raises(ValueError):
            measures.errors(df, lhs, rhs)
    with pytest.raises(ValueError):
        measures.measure_named("g9")
    assert measures.simple_measure(["a"], 4) == 0.75


def test_encoding(spark):
    import datetime as dt

    rows = [(i % 7 - 3, None if i % 5 == 0 else f"v{i % 11}", dt.date(2020, 1, 1 + i % 9), float(i % 4), i * 10**12, None) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c date, d double, e long, f int")
    codes = encoding.encoded(df, df.columns)
    assert codes.data.columns == df.columns and codes.fits(["a", "b", "c", "d", "e"])
    for c in df.columns:
        both = df.select(c).distinct().count(), codes.data.select(c).distinct().count()
        assert both[0] == both[1] and codes.data.agg({c: "max"}).first()[0] < 1 << codes.bits[c]
    assert codes.data.groupBy(*df.columns).count().count() == df.distinct().count()
    key, masks = codes.key(["b", "a"])
    assert codes.data.select(key.alias("k")).distinct().count() == df.select("a", "b").distinct().count()
    assert encoding.encoded(df.limit(0), df.columns).data.count() == 0
