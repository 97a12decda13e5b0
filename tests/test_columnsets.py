import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.functions import columnsets as cs


@pytest.mark.parametrize(
    "family, expected",
    [
        ([(0, 4), (4, 5), (0, 5)], [(0, 4), (0, 5), (4, 5)]),  # any two of three
        ([(7,), (3, 7), (2, 3)], [(2, 7), (3, 7)]),
        ([(0, 1, 2, 3)], [(0,), (1,), (2,), (3,)]),
        ([(1, 2), ()], []),
        ([], [()]),
    ],
)
def test_hitting_sets_of_known_families(family, expected):
    found = cs.minimal_hitting_sets(map(cs.mask_of, family))
    assert sorted(found) == sorted(map(cs.mask_of, expected))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 5), min_size=1), max_size=6))
def test_hitting_sets_are_all_minimal_ones(family):
    masks = [cs.mask_of(s) for s in family]
    hits = [m for m in range(64) if all(m & f for f in masks)]
    expected = [m for m in hits if not any(o != m and o & m == o for o in hits)]
    assert sorted(cs.minimal_hitting_sets(masks)) == sorted(expected)


def test_families_stay_antichains():
    rnd = random.Random(1)
    for _ in range(50):
        masks = [rnd.randrange(1, 64) for _ in range(12)]
        low, high = cs.MinimalFamily(masks), cs.MaximalFamily(masks)
        assert sorted(low) == sorted({m for m in masks if not any(o != m and o & m == o for o in masks)})
        assert sorted(high) == sorted({m for m in masks if not any(o != m and o & m == m for o in masks)})
        for probe in range(64):
            assert low.has_subset_of(probe) == any(m & probe == m for m in masks)
            assert high.has_superset_of(probe) == any(m & probe == probe for m in masks)


def test_algebra_beyond_64_columns():
    wide = cs.mask_of([0, 63, 64, 100])
    assert cs.indices(wide) == [0, 63, 64, 100] and cs.cardinality(wide) == 4
    assert cs.next_bit(wide, 1) == 63 and cs.next_bit(wide, 101) == -1
    assert cs.complement(0b101, 4) == 0b1010
    assert cs.is_subset(0b1, 0b11) and not cs.is_proper_subset(0b11, 0b11)
    assert cs.union(1, 2) == 3 and cs.intersection(3, 2) == 2 and cs.difference(3, 2) == 1
    assert cs.has_bit(cs.with_bit(0, 70), 70) and cs.without_bit(wide, 100) == cs.mask_of([0, 63, 64])
    with pytest.raises(ValueError):
        cs.mask_of([-1])


def test_neighbours():
    assert cs.parents(0b1) == []  # never the empty set
    assert sorted(cs.parents(0b111)) == [0b011, 0b101, 0b110]
    assert cs.children(0b1, 4, rhs=2) == [0b11, 0b1001]
    assert cs.to_text(0b101, ["z", "y", "a"]) == "a,z"


def test_set_map():
    t = cs.SetMap()
    for m in (0b1, 0b11, 0b101, 0b110):
        t.set(m, m)
    assert t.set_if_absent(0b1, 9) == 1 and t.get(0b1000) is None
    assert t.subsets_of(0b111) == [0b1, 0b11, 0b101, 0b110]
    assert t.longest_prefix(0b1011) == 0b11
    assert t.delete(0b1) == 3 and len(t) == 1  # with all that extends it


def test_masks_in_dataframes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 3), (4, 3)], "a long, b long")
    got = df.select(cs.subset_col(F.col("a"), F.col("b")).alias("s"), cs.size_col(F.col("b")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, 2), (False, 2)]


def test_all_subsets_reached():
    reach = {0b1}
    for _ in range(3):
        reach |= {c for m in reach for c in cs.children(m, 4)}
    assert reach == {cs.mask_of((0, *x)) for k in range(4) for x in combinations((1, 2, 3), k)}
