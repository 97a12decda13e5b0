"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (see required()): a conjunction of what any
match must hold, with disjunctions where the expression branches. Documents are indexed in segments of some megabytes:
the trigrams that the queries name are posted to the documents that hold them, postings are intersected and joined as
the query says, and only the candidates run the expression. Rules whose expression has no mandatory trigram scan every
document. Trigrams are of UTF-8 bytes with A-Z lower-cased, so one index serves rules in either case.

Cases: null and empty texts have no spans; repeated rows are scanned one by one; long texts are scanned whole, in time
that grows with their length only, for no rule reads a place more than a few times; spans of several rules that start together
are listed in the order of the rules; empty tables give empty results; other columns pass through, but one named secrets,
which is replaced.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser as P
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    #: least length of group (0: the whole match); matches that fail are dropped
    group: int = 0
    least: int = 0


# The base rules, in the order in which ties of start are listed, then those that the scan adds.
BASE_RULES = (
    SecretRule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18),
    SecretRule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}+"),
    # from the start of a run of its letters, else each eyJ in a run would read the rest of it
    SecretRule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    SecretRule("url_login", r"[a-z]{2,12}://[^\s/:@]++:[^\s/:@]{3,}+@[A-Za-z0-9.-]+"),
)

#: A query is True (any document), a frozenset of trigrams (all of them), or ("and" | "or", queries).
Query = bool | frozenset | tuple


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    if isinstance(a, frozenset) and isinstance(b, frozenset):
        return a | b
    return ("and", (a, b))


def _either(queries: list[Query]) -> Query:
    return True if any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _lower(code: int) -> bytes:
    return chr(code + 32 if 65 <= code <= 90 else code).encode("utf-8", "surrogatepass")


def _grams(s: bytes) -> Query:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2)) or True


#: A literal may stand for so many strings before it counts as unknown.
MOST = 64


def required(pattern: str, most: int = MOST) -> Query:
    """The Boolean trigram query that every match of the pattern satisfies (in lower case)."""

    def literal(tree) -> tuple[set[bytes] | None, Query]:
        """The strings that the sequence can be (None: too many), and what a match of it must hold besides."""
        runs: set[bytes] | None = {b""}
        query: Query = True

        def flush():
            nonlocal runs, query
            if runs is not None:
                query = _both(query, _either([_grams(r) for r in sorted(runs)]))
            runs = {b""}

        exact = True
        for op, arg in tree:
            own: set[bytes] | None = None
            more: Query = True
            if op is K.LITERAL:
                own = {_lower(arg)}
            elif op is K.IN:
                own = set()
                for kind, x in arg:
                    if kind is K.LITERAL:
                        own.add(_lower(x))
                    elif kind is K.RANGE and x[1] - x[0] < 16:
                        own |= {_lower(c) for c in range(x[0], x[1] + 1)}
                    else:
                        own = None
                        break
                if own is not None and len(own) > 16:
                    own = None
            elif op is K.SUBPATTERN:
                own, more = literal(arg[3])
            elif op is K.BRANCH:
                each = [literal(x) for x in arg[1]]
                if all(s is not None and q is True for s, q in each):
                    own = set().union(*(s for s, _ in each))
                else:
                    more = _either([q if s is None else _both(q, _either([_grams(r) for r in sorted(s)])) for s, q in each])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
                low, high, inner = arg
                s, q = literal(inner)
                if low == 0 and high == 1 and s is not None and q is True:
                    own = s | {b""}
                elif low == high == 1:
                    own, more = s, q
                elif low and s is not None and len(s) ** low <= most:
                    head = {b""}
                    for _ in range(min(low, 8)):
                        head = {a + b for a in head for b in s}
                    if low == high and low <= 8:
                        own = head
                    else:
                        more = _both(q, _either([_grams(r) for r in sorted(head)]))
                elif low:
                    more = q
            elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
                own = {b""}
            if own is not None and runs is not None and len(own) * len(runs) <= most:
                runs = {a + b for a in runs for b in own}
                query = _both(query, more)
            else:
                exact = False
                flush()
                query = _both(query, more)
                if own is not None:
                    runs = set(own) if len(own) <= most else {b""}
                    # what stood before may end differently, so the run starts anew here
        if exact:
            return runs, query
        flush()
        return None, query

    strings, query = literal(P.parse(pattern))
    return query if strings is None else _both(query, _either([_grams(s) for s in sorted(strings)]))


def named(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return set(query) if isinstance(query, frozenset) else set().union(*(named(q) for q in query[1]))


def lookup(wanted: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """The row of each wanted trigram, as a dictionary and by its 24 bits (-1: not wanted)."""
    row = {g: i for i, g in enumerate(wanted)}
    lut = np.full(1 << 24, -1, np.int16)
    for g, i in row.items():
        lut[g[0] << 16 | g[1] << 8 | g[2]] = i
    return row, lut


class Segment:
    """The inverted index of some documents: postings of the wanted trigrams as bit rows."""

    def __init__(self, texts: list[bytes], row: dict[bytes, int], lut: np.ndarray):
        self.n, self.row = len(texts), row
        self.bits = np.zeros((len(row), self.n), bool)
        starts = np.cumsum([0] + [len(t) + 3 for t in texts])
        data = np.frombuffer(b"\x00\x00\x00".join([*texts, b""]), np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int32)
        if len(data) > 2:
            hit = lut[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
            at = np.flatnonzero(hit >= 0)
            self.bits[hit[at], np.searchsorted(starts, at, "right") - 1] = True

    def find(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, frozenset):
            return self.bits[[self.row[g] for g in query]].all(axis=0)
        found = [self.find(q) for q in query[1]]
        return np.logical_and.reduce(found) if query[0] == "and" else np.logical_or.reduce(found)


def scanner(rules: tuple[SecretRule, ...]) -> Callable[[list[str]], list[list[tuple[str, int, int]]]]:
    """A function from texts to their spans (kind, start, end), in the order of the rules."""
    known = [(r, re.compile(r.pattern), required(r.pattern)) for r in rules]
    row, lut = lookup(sorted(set().union(*(named(q) for _, _, q in known))))

    def scan(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        segment = Segment([t.encode("utf-8", "surrogatepass") for t in texts], row, lut)
        spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for rule, expression, query in known:
            for i in np.flatnonzero(segment.find(query)):
                for m in expression.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((rule.kind, m.start(), m.end()))
        return spans

    return scan


#: [0-9a-f]{16,} finds the runs of [0-9a-f]+ that have 16 or more, without stopping at each short one.
_LONG_HEX = SecretRule("hex", r"[0-9a-f]{16,}")


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """docs without text_col, with secrets: all spans as array<struct<kind, start, end>>, code points, end exclusive, by
    start and then kind in the order of the rules. No shuffle: a segment is indexed where its documents are read."""
    names = [c for c in docs.columns if c not in (text_col, "secrets")]
    out = T.StructType([*(docs.schema[c] for c in names), T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    used = tuple(_LONG_HEX if r == BASE_RULES[2] else r for r in rules)
    order = {r.kind: i for i, r in enumerate(used)}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(used)
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                high, size = low, 0
                texts = []
                while high < batch.num_rows and (size < segment_bytes or high == low):
                    texts.append(batch.column(len(names))[high].as_py() or "")
                    size += len(texts[-1])
                    high += 1
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in sorted(x, key=lambda x: (x[1], order[x[0]]))] for x in scan(texts)]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[: len(names)], pa.array(found, kind)], names=out.names)
                low = high

    return docs.select(*names, text_col).mapInArrow(run, out)


