"""Benchmark decontamination by pigeonhole edit matching.

An item of n normalised characters may be altered by k = floor(error_rate * n) edits. It is split into k + 1 pieces of
nearly equal length; whatever holds the item within k edits holds one piece unaltered. One Aho-Corasick automaton finds
all exact pieces in a document, each hit gives the window where its item could lie, and overlapping windows of an item
are verified together with Myers' bit-parallel edit distance (the item against any substring of the window).

Texts are compared in lower case with white space as single spaces. Items under min_chars normalised characters are too
short to be told when altered: they match unaltered, between word boundaries.

Items are sent to the executors in chunks of about max_item_bytes, equal ones once; more of them mean more passes over the
documents, not a larger broadcast. A worker builds the automaton of a chunk once for all its tasks.

Cases: null and empty texts and items match nothing; equal items match as often as they are listed; repeated documents
are judged one by one; long texts are matched whole; of several places with the least distance the first end counts, and
matches are listed by item_id; empty tables give empty results; other columns pass through, but one named matches, which
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rows

ERROR_RATE = 0.08
MIN_CHARS = 32
MAX_ITEM_BYTES = 16 << 20
_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that cover the text, with their offsets."""
    n, m = len(text), errors + 1
    cuts = [i * n // m for i in range(m + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of the pattern (its masks and length) to a substring of text, if at most `most`, and the
    first end of such a substring."""
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no carry into the first row
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return None if best > most else (best, at)


def between_words(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        self.items = []
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normal(text or "")
            if not t:
                continue
            whole = len(t) < min_chars
            k = 0 if whole else int(error_rate * len(t))
            for offset, piece in pieces(t, k):
                at.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, t, k, None if whole else masks(t)))
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def match(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item found, by place in the item list."""
        if not text or not self.items:
            return []
        t = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, int] = {}  # their first ends
        for end, (length, where) in self.automaton.iter(t):
            start = end + 1 - length
            for i, offset in where:
                _, item, k, peq = self.items[i]
                if peq is None:
                    if i not in short and between_words(t, start, end + 1):
                        short[i] = end + 1
                    continue
                windows.setdefault(i, []).append((start - offset - k, start - offset + len(item) + k))
        out = []
        for i in sorted(windows.keys() | short.keys()):
            item_id, item, k, peq = self.items[i]
            if i in short:
                out.append((item_id, 0, short[i]))
                continue
            merged: list[list[int]] = []
            for a, b in sorted(windows[i]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                low = max(0, a)
                part = t[low : max(0, b)]
                exact = part.find(item)
                found = (0, exact + len(item)) if exact >= 0 else myers(peq, len(item), part, k if best is None else best[0] - 1)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], low + found[1])
                if best and not best[0]:
                    break
            if best:
                out.append((item_id, *best))
        return out


#: Of this worker, by what they were built from: a few, as many as one job has.
_matchers: dict[tuple, Matcher] = {}
MOST_MATCHERS = 4


def matcher_of(key: str, items: list[tuple[int, str]], error_rate: float, min_chars: int) -> Matcher:
    """The matcher of items whose hash is key, which this process keeps."""
    at = key, error_rate, min_chars
    if at not in _matchers:
        while len(_matchers) >= MOST_MATCHERS:
            del _matchers[next(iter(_matchers))]
        _matchers[at] = Matcher(items, error_rate, min_chars)
    return _matchers[at]


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """docs with matches: array of (item_id, distance, end), one for each item that the text holds."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.coalesce(F.col(item_col), F.lit("")).alias("t"))
    items = items.groupBy("i", "t").agg(F.count("*").alias("n"))
    size = items.agg(F.sum(F.octet_length("t") + 16).alias("n")).first()["n"] or 0
    chunks = 1 << max(0, -(-size // max_item_bytes) - 1).bit_length()
    names = [c for c in docs.columns if c != "matches"]
    out = docs.select(*names)
    kind = "array<struct<item_id:bigint,distance:int,end:int>>"
    found = F.array().cast(kind)
    for c in range(chunks):
        part = items if chunks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == c)
        # a chunk's size is even by its hash; a single item may be as long as it is
        rows = sorted(((r["i"], r["t"], r["n"]) for r in bounded_rows(part, max_item_bytes // 8 + 1000, "benchmark items in a chunk")), key=str)
        out = _matched(out, rows, error_rate, min_chars, text_col, f"__dc_{c}")
        found = F.concat(found, f"__dc_{c}")
    by_id = lambda a, b: F.when(a["item_id"].eqNullSafe(b["item_id"]), 0).when(a["item_id"].isNull() | (a["item_id"] < b["item_id"]), -1).otherwise(1)
    return out.select(*names, F.array_sort(found, by_id).alias("matches"))


def _matched(docs: DataFrame, items: list[tuple[int, str, int]], error_rate: float, min_chars: int, text_col: str, name: str) -> DataFrame:
    kept = docs.columns
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, _MATCH)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))
    key = xxhash.xxh128_hexdigest(repr(items).encode("utf-8", "surrogatepass"))
    sent = docs.sparkSession.sparkContext.broadcast(items)  # about max_item_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by import: what a nested function holds is copied to each task
        from lattica.llm.decontaminate import matcher_of

        matcher = matcher_of(key, [(i, t) for i, t, n in sent.value for _ in range(n)], error_rate, min_chars)
        for batch in batches:
            texts = batch.column(kept.index(text_col))
            found = [[{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.match(x.as_py())] for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)
