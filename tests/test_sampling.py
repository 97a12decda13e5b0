import hashlib

import pytest

from lattica.operators import measures, sampling


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "abcde"[min(4, int((i * i % 97) ** 0.5) // 2)], i % 7, i % 3) for i in range(400)]
    return spark.createDataFrame(data, "id int, a string, b int, c int").cache()


def key(i, seed=sampling.SEED):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_sizes():
    assert sampling.sample_size(100, 0.25) == 25 and sampling.sample_size(100, 200) == 100 and sampling.sample_size(100, 30.9) == 30
    with pytest.raises(ValueError):
        sampling.sample_size(10, 0)


def test_random(rows):
    s = sampling.sample_random(rows, "id", param=50)
    assert sorted(r["id"] for r in s.rows.collect()) == sorted(sorted(range(400), key=key)[:50])
    assert s.info == {"strategy": "random", "asked": 50}


def test_focused(rows):
    s = sampling.sample_focused(rows, "id", ["a"], param=60)
    data = rows.collect()
    sizes = {}
    for r in data:
        sizes.setdefault(r["a"], []).append(r["id"])
    total = sum(len(v) for v in sizes.values() if len(v) > 1)
    expected = set()
    for v in sizes.values():
        if len(v) > 1:
            expected |= set(sorted(v, key=key)[: min(len(v), max(1, int(len(v) / total * 60 + 0.5)))])
    assert {r["id"] for r in s.rows.collect()} == expected
    assert sampling.sample_focused(rows, "id", ["a"], param=1000).rows.count() == total
    assert sampling.sample_focused(rows, "id", ["id"], param=10).rows.count() == 0  # no clusters


def test_neyman(rows, spark):
    s = sampling.sample_neyman(rows, "id", ["a", "b"], "c", param=100)
    assert s.info["base"] in ("a", "b") and 0 < s.rows.count() <= 100
    v = sampling.pilot_variances(rows, "id", ["b"], "c")
    allocation = {r["b"]: r["allocation"] for r in sampling.neyman_allocation(v, ["b"], 50).collect()}
    assert sum(allocation.values()) == 50
    flat = spark.createDataFrame([("x", 3, 0.0), ("y", 100, 0.0), ("z", 100, 0.0)], "k string, cluster_size long, variance double")
    assert {r["k"]: r["allocation"] for r in sampling.neyman_allocation(flat, ["k"], 30).collect()} == {"x": 3, "y": 13, "z": 14}


@pytest.mark.parametrize("m", [0, 300, 1000, 2500, 9000, 10**6])
def test_even_split_over_blocks(spark, m):
    sizes = [(None if i == 0 else f"k{i:04d}", 2 + i * i % 13, 0.0) for i in range(1000)]
    left, expected = m, {}
    for i, (k, n, _) in enumerate(sizes):
        expected[k] = min(n, left // (1000 - i))
        left -= expected[k]
    w = spark.createDataFrame(sizes, "k string, cluster_size long, variance double").repartition(5)
    for block_rows in (100_000, 130):
        got = sampling._even(w, ["k"], m, 1000, block_rows)
        assert got.columns == ["k", "cluster_size", "variance", "allocation"]
        assert {r["k"]: r["allocation"] for r in got.collect()} == expected


def test_even_split_of_many_clusters(spark):
    flat = spark.range(150_000).selectExpr("id k", "10L cluster_size", "0D variance")
    got = sampling.neyman_allocation(flat, ["k"], 1_000_000).selectExpr("sum(allocation) s", "min(allocation) a", "max(allocation) b", "count(*) n").first()
    assert tuple(got) == (1_000_000, 6, 7, 150_000)


def test_variance_is_the_sample_variance(spark):
    from statistics import variance

    from pyspark.sql import functions as F

    for n, top in ((1, 1), (5, 3), (20, 20), (7, 1)):
        got = spark.range(1).select(measures.conflict_variance(F.lit(n), F.lit(top)).alias("v")).first()["v"]
        assert got == pytest.approx(variance([0] * top + [1] * (n - top)) if n > 1 else 0)


def test_estimates(rows):
    exact = measures.errors(rows, ["b"], "c").first()
    whole = sampling.estimate_error(rows, "id", ["b"], "c", "random", param=400).first()
    assert whole["violations"] == exact["removals"] and whole["g3"] == pytest.approx(exact["g3"])
    assert sampling.estimate_error(rows, "id", ["b"], "c", "none").first()["g3"] == exact["g3"]
    for s in ("random", "focused", "neyman"):
        assert 0 <= sampling.estimate_error(rows, "id", ["b"], "c", s, param=100).first()["g3"] <= 1.5
    lone = sampling.estimate_error(rows, "id", ["id"], "c", "random", param=100).first()
    assert (lone["violations"], lone["g3"], lone["rows_used"]) == (0, 0.0, 0)
    with pytest.raises(ValueError):
        sampling.estimate_error(rows, "id", ["b"], "c", "best")


def test_estimates_of_an_empty_left_hand_side(rows):
    drawn = sorted(range(400), key=key)[:50]
    counts = [sum(i % 3 == k for i in drawn) for k in range(3)]
    for s in ("random", "focused", "neyman"):
        got = sampling.estimate_error(rows, "id", [], "c", s, param=50).first()
        assert (got["violations"], got["rows_used"]) == (50 - max(counts), 50) and got["g3"] == pytest.approx((50 - max(counts)) * 8 / 399)
    assert sampling.estimate_error(rows, "id", [], "c", "none").first()["g3"] == measures.errors(rows, [], "c").first()["g3"]


def test_base_column_of_several(spark):
    df = spark.createDataFrame([(i, i // 2, i % 9, i if i > 5 else 0, i % 3) for i in range(90)], "id int, pairs int, nines int, few int, c int")
    assert sampling.base_column(df, ["pairs", "nines", "few"]) == "few" and sampling.base_column(df, ["nines", "pairs"]) == "nines"
    s = sampling.sample_neyman(df, "id", ["pairs", "few"], "c", param=4)
    assert s.info["base"] == "few" and all(r["id"] <= 5 for r in s.rows.collect())
