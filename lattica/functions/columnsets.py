"""Sets of columns as bit masks: algebra, lattice neighbours, families of sets, minimal hitting sets.

Masks are Python ints on the driver (any number of columns) and BIGINT columns in lattice DataFrames (up to 63).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_of(indices: Iterable[int]) -> int:
    out = 0
    for i in indices:
        if i < 0:
            raise ValueError(f"negative column index {i}")
        out |= 1 << i
    return out


def indices(mask: int) -> list[int]:
    """Ascending."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def iterate(mask: int) -> Iterator[int]:
    yield from indices(mask)


def cardinality(mask: int) -> int:
    return mask.bit_count()


def is_subset(a: int, b: int) -> bool:
    return a & ~b == 0


def is_proper_subset(a: int, b: int) -> bool:
    return a != b and a & ~b == 0


def union(a: int, b: int) -> int:
    return a | b


def intersection(a: int, b: int) -> int:
    return a & b


def difference(a: int, b: int) -> int:
    return a & ~b


def complement(mask: int, n: int) -> int:
    """Of n columns."""
    return ~mask & (1 << n) - 1


def with_bit(mask: int, i: int) -> int:
    return mask | 1 << i


def without_bit(mask: int, i: int) -> int:
    return mask & ~(1 << i)


def has_bit(mask: int, i: int) -> bool:
    return bool(mask >> i & 1)


def next_bit(mask: int, start: int) -> int:
    """The first set bit from start on, -1 if there is none."""
    rest = mask >> start
    return -1 if not rest else start + (rest & -rest).bit_length() - 1


def parents(mask: int) -> list[int]:
    """One column less; never the empty set."""
    return [p for i in indices(mask) if (p := without_bit(mask, i))]


def children(mask: int, n: int, rhs: int | None = None) -> list[int]:
    """One column more, never rhs."""
    return [with_bit(mask, i) for i in range(n) if not has_bit(mask, i) and i != rhs]


def to_text(mask: int, names: list[str] | None = None) -> str:
    """The columns, comma-joined: by name in the order of the names, else by index."""
    return ",".join(sorted(names[i] for i in indices(mask)) if names else map(str, indices(mask)))


def subset_col(a: Column, b: Column) -> Column:
    """For masks in BIGINT columns."""
    return a.bitwiseAND(b) == a


def size_col(a: Column) -> Column:
    return F.bit_count(a).cast("int")


class MinimalFamily:
    """An antichain of minimal sets: adding one drops its supersets and is void if a subset is there."""

    def __init__(self, masks: Iterable[int] = ()):
        self._by_size: dict[int, set[int]] = {}
        for m in masks:
            self.add(m)

    def has_subset_of(self, mask: int) -> bool:
        size = mask.bit_count()
        return any(m & ~mask == 0 for k, group in self._by_size.items() if k <= size for m in group)

    def add(self, mask: int) -> bool:
        if self.has_subset_of(mask):
            return False
        size = mask.bit_count()
        for k in [k for k in self._by_size if k > size]:
            self._by_size[k] = {m for m in self._by_size[k] if mask & ~m}
        self._by_size.setdefault(size, set()).add(mask)
        return True

    def __iter__(self) -> Iterator[int]:
        for k in sorted(self._by_size):
            yield from sorted(self._by_size[k])

    def __len__(self) -> int:
        return sum(map(len, self._by_size.values()))


class MaximalFamily:
    """An antichain of maximal sets."""

    def __init__(self, masks: Iterable[int] = ()):
        self._masks: set[int] = set()
        for m in masks:
            self.add(m)

    def has_superset_of(self, mask: int) -> bool:
        return any(mask & ~m == 0 for m in self._masks)

    def add(self, mask: int) -> bool:
        if self.has_superset_of(mask):
            return False
        self._masks = {m for m in self._masks if m & ~mask} | {mask}
        return True

    def __iter__(self) -> Iterator[int]:
        yield from sorted(self._masks)

    def __len__(self) -> int:
        return len(self._masks)


class SetMap:
    """Values by column set, with removal of a set and everything that extends it in index order (a prefix tree's
    subtree), and search by subset."""

    def __init__(self):
        self._values: dict[tuple[int, ...], object] = {}

    def get(self, mask: int, default=None):
        return self._values.get(tuple(indices(mask)), default)

    def set(self, mask: int, value) -> None:
        self._values[tuple(indices(mask))] = value

    def set_if_absent(self, mask: int, value):
        return self._values.setdefault(tuple(indices(mask)), value)

    def delete(self, mask: int) -> int:
        at = tuple(indices(mask))
        gone = [k for k in self._values if k[: len(at)] == at]
        for k in gone:
            del self._values[k]
        return len(gone)

    def subsets_of(self, mask: int) -> list[int]:
        return sorted(m for k in self._values if is_subset(m := mask_of(k), mask))

    def longest_prefix(self, mask: int) -> int | None:
        """The deepest stored prefix of the ascending indices."""
        at = tuple(indices(mask))
        return next((mask_of(at[:n]) for n in range(len(at), 0, -1) if at[:n] in self._values), None)

    def __len__(self) -> int:
        return len(self._values)


def minimal_hitting_sets(family: Iterable[int]) -> list[int]:
    """All minimal sets that meet every set of the family, by size and mask. A family with an empty set has none; an
    empty family has the empty set."""
    found = [0]
    for s in sorted(set(family), key=lambda m: (m.bit_count(), m)):
        if not s:
            return []
        hit = [t for t in found if t & s]
        grown = MinimalFamily(hit)
        for t in found:
            if not t & s:
                for i in indices(s):
                    grown.add(t | 1 << i)
        found = list(grown)
    return sorted(found, key=lambda m: (m.bit_count(), m))
