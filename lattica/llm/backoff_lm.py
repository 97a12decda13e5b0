"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model of a given order, smoothed by a hierarchical Dirichlet prior (MacKay and Peto, 1995):
p(w | h) = (c(hw) + a p(w | h')) / (c(h) + a), where h' is h without its first word, a the prior's weight, and at the root
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). It needs counts of n-grams only, so no context's followers must ever meet.

Its states are the contexts that training texts hold, the empty one (the root) included; a text begins in the state of
its start. An arc leads from h over w to the longest suffix of hw that is a state, with weight log10 p(w | h), for every hw
that was seen; the root has an arc for every word. A failure arc leads from h to h' with weight log10(a / (c(h) + a)). A
text is read from left to right: each word takes the state's arc, after as many failure arcs as it needs, and the weights
add up. The text's end is a word, too.

Many texts are read side by side, a word each a step. Long ones are cut: a state depends on the last order - 1 words only,
so a piece that reads these first, without their weights, from the root is in the state of the whole text.

Counts are corpus-wide: blocks of documents ask the shards of the count table (see blocks.py) for the n-grams of their own
texts, and build the part of the automaton that these can reach. Two passes over the texts: counting, scoring. N-grams are
told apart by KEY_BITS bits of hash more than log2 of the number of n-grams in the corpus (64 at most), so one of them
shares its bits with another with a probability of 2 ** -KEY_BITS, however large the corpus. Shards are ranges of the hash
of the whole n-gram, so no context or word is hot.

Cases: a null or empty text has the end as its only token; without any training document all counts are zero and every
state but the root is missing; equal rows count as often as they stand, and each gets its row (in a task they travel as one);
long texts are scored whole; nothing depends on an order, so there are no ties; a null doc_id counts as the text "" for the
split; empty tables give empty results; other columns are not read, so none can clash with the result's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks as B
from .common import built_on, mix64, stored, words_in

START, END = b" start", b" end"  # no word holds a space
ORDER = 3
#: The prior's weight.
PRIOR = 32.0
KEY_BITS = 26
#: A block's n-grams and its part of the automaton take some forty times its bytes.
BLOCK_BYTES = 8 << 20
#: Words of a text that are read in one piece.
PIECE = 256


class Grams:
    """The n-grams of some texts, by their length: gram u of length k is gram context[u] of length k - 1 and word[u]; without
    its first word it is gram suffix[u] of length k - 1. Words are numbered as in words_in(), then the start, then the end."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, order: int, weight: np.ndarray | None = None):
        """weight: for how much each text counts; counts is how often each n-gram stands in them, by that."""
        ids, starts, words = words_in(texts)
        self.start, self.end, self.n_words = len(words), len(words) + 1, len(words) + 2
        #: Of each text: its words and the end.
        self.lengths = np.diff(starts) + 1
        #: Where each text's start stands in flat.
        self.begin = starts[:-1] + 2 * np.arange(len(self.lengths))
        self.flat = np.full(len(ids) + 2 * len(self.lengths), -1, np.int32)
        self.flat[self.begin] = self.start
        self.flat[self.begin + self.lengths] = self.end
        self.flat[self.flat < 0] = ids
        del ids
        self.hash = [np.fromiter(map(xxhash.xxh64_intdigest, [*words, START, END]), np.uint64, self.n_words)]
        del words
        self.context: list = [None]
        self.word: list = [np.arange(self.n_words, dtype=np.int32)]
        self.suffix: list = [None]
        every = None if weight is None else np.repeat(weight.astype(np.float64), self.lengths + 1)
        self.counts = [] if weight is None else [np.bincount(self.flat, weights=every, minlength=self.n_words).astype(np.int64)]
        last = self.flat
        whole = np.ones(len(self.flat), bool)  # whether an n-gram of the length at hand ends there
        for k in range(2, order + 1):
            whole[self.begin[self.lengths >= k - 2] + k - 2] = False
            at = np.flatnonzero(whole).astype(np.int32)
            pair, gram = np.unique(last[at - 1] * np.int64(self.n_words) + self.flat[at], return_inverse=True)
            gram = gram.astype(np.int32)
            context, word = (pair // self.n_words).astype(np.int32), (pair % self.n_words).astype(np.int32)
            del pair
            suffix = np.empty(len(word), np.int32)
            suffix[gram] = last[at]
            self.context.append(context)
            self.word.append(word)
            self.suffix.append(suffix)
            self.hash.append(mix64(self.hash[-1][context] * np.uint64(0x9E3779B97F4A7C15) + self.hash[0][word] + np.uint64(k)))
            if weight is not None:
                self.counts.append(np.bincount(gram, weights=every[at], minlength=len(word)).astype(np.int64))
            last = np.full(len(self.flat), -1, np.int32)
            last[at] = gram
            del at, gram

    def sums(self, by_word: np.ndarray) -> np.ndarray:
        """Of each text, the sum over its words and its end."""
        v = by_word[self.flat]
        v[self.begin] = 0
        return np.add.reduceat(v, self.begin) if len(self.begin) else v


class Automaton:
    """States 0 (the root), 1, ...; arcs by state and word, in order."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, distinct: int, prior: float):
        order, n = len(counts), grams.n_words
        self.n_words = n
        c = counts
        words = c[0].astype(np.float64)
        words[grams.start] = 0  # no token, but a context
        self.known = words > 0
        p = [(words + 0.5) / (tokens + 0.5 * (distinct + 1))]
        state, top = [], 1
        total, fail = [np.array([tokens], np.float64)], [np.zeros(1, np.int32)]
        for k in range(order - 1):  # contexts of k + 1 words
            seen = (c[k] > 0) & (grams.word[k] != grams.end)
            number = np.where(seen, top - 1 + np.cumsum(seen, dtype=np.int32), 0).astype(np.int32)
            total.append(c[k][seen].astype(np.float64))
            fail.append(state[k - 1][grams.suffix[k][seen]] if k else np.zeros(len(total[-1]), np.int32))
            state.append(number)
            top += len(total[-1])
        self.fail = np.concatenate(fail)
        with np.errstate(divide="ignore"):
            self.failure = np.log10(prior / (np.concatenate(total) + prior))
        self.start = int(state[0][grams.start]) if state else 0
        self.root_weight = np.log10(p[0])
        self.root_next = state[0] if state else np.zeros(n, np.int32)
        key, weight, to = [], [], []
        for k in range(1, order):
            context = grams.context[k]
            p.append((c[k] + prior * p[k - 1][grams.suffix[k]]) / (c[k - 1][context] + prior))
            seen = c[k] > 0
            key.append(state[k - 1][context[seen]] * np.int64(n) + grams.word[k][seen])
            weight.append(np.log10(p[k][seen]))
            to.append((state[k] if k < order - 1 else state[k - 1][grams.suffix[k]])[seen])
        # and one at the end that nobody asks for
        self.arc = np.concatenate([*key, [np.iinfo(np.int64).max]])
        self.weight = np.concatenate([*weight, [0.0]])
        self.next = np.concatenate([*to, np.zeros(1, np.int32)])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state reads its word: the weights of the arcs taken, and the next states."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int32)
        root = state == 0
        todo = np.flatnonzero(~root)
        now = state[todo]
        while len(todo):
            key = now * np.int64(self.n_words) + word[todo]
            at = np.searchsorted(self.arc, key)
            hit = self.arc[at] == key
            arc, done = at[hit], todo[hit]
            weight[done] += self.weight[arc]
            after[done] = self.next[arc]
            todo, now = todo[~hit], now[~hit]
            weight[todo] += self.failure[now]
            now = self.fail[now]
            root[todo[now == 0]] = True
            todo, now = todo[now > 0], now[now > 0]
        weight[root] += self.root_weight[word[root]]
        after[root] = self.root_next[word[root]]
        return weight, after

    def read(self, grams: Grams, order: int, piece: int = PIECE) -> np.ndarray:
        """The weight of each text."""
        pieces = -(-grams.lengths // piece)
        text = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = number * piece + 1  # places in the text, whose start is place 0
        last = np.minimum(first + piece - 1, grams.lengths[text])
        begin = np.maximum(first - (order - 1), 1)
        order_of = np.argsort(begin - last, kind="stable")  # longest first
        text, first, last, begin = (x[order_of] for x in (text, first, last, begin))
        state = np.where(begin == 1, self.start, 0)
        at, score = grams.begin[text] + begin, np.zeros(len(text))
        left, skip = last - begin + 1, first - begin
        for t in range(int(left[0]) if len(left) else 0):
            n = np.searchsorted(-left, -t)  # those that have a word left
            weight, state = self.step(state[:n], grams.flat[at[:n] + t])
            score[:n] += np.where(t >= skip[:n], weight, 0)
        return np.bincount(text, weights=score, minlength=len(pieces))


def key_bits(tokens: int, order: int) -> int:
    return min(64, KEY_BITS + math.ceil(math.log2(tokens * order + 1)) + 1)


def _keys(hashes: list[np.ndarray], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys of the words, and those of the longer n-grams, with their order."""
    out = []
    for h in (hashes[0], np.concatenate([np.zeros(0, np.uint64), *hashes[1:]])):
        k = h >> np.uint64(64 - bits)
        order = np.argsort(k, kind="stable").astype(np.int32)
        out.append((k[order], order))
    return out


def _asked(shards: int, order: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = B.unpacked(t)
        g = Grams(rows.column("text"), order, rows.column("n").to_numpy() * rows.column("train").to_numpy())
        del rows
        counts = [g.counts[0], np.concatenate([np.zeros(0, np.int64), *g.counts[1:]])]
        keys = _keys(g.hash, bits)
        del g
        parts = []
        for (k, by), n in zip(keys, counts, strict=True):
            parts.append((k, n[by], np.searchsorted(B.shard_of(k << np.uint64(64 - bits), shards), np.arange(shards + 1))))
        out: dict[int, bytes] = {}
        for s in range(shards):
            if any(cut[s + 1] > cut[s] for _, _, cut in parts):
                out[s] = B.write_ints(*(x for k, n, cut in parts for x in (B.deltas(k[cut[s] : cut[s + 1]]), n[cut[s] : cut[s + 1]])))
        del parts, keys, counts
        B.trim()
        return pa.table({"shard": pa.array(list(out), pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array(list(out.values()), pa.binary())})

    return run


def _summed(asked: list[list[np.ndarray]], i: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their sums, and the sums that each block asks for."""
    keys, at = np.unique(np.concatenate([B.undeltas(a[i]) for a in asked]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([a[i + 1] for a in asked]).astype(np.float64), minlength=len(keys)).astype(np.int64)
    return keys, total, [total[x] for x in np.split(at, np.cumsum([len(a[i]) for a in asked])[:-1])]


def _answered(bits: int):
    start = np.uint64(xxhash.xxh64_intdigest(START)) >> np.uint64(64 - bits)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        asked = [B.read_ints(x.as_buffer().to_pybytes()) for x in t.column("blob")]
        keys, total, words = _summed(asked, 0)
        total[keys == start] = 0
        n, v = int(total.sum()), int(np.count_nonzero(total))
        longer = _summed(asked, 2)[2]
        del asked
        blobs = [B.write_ints(a, b) for a, b in zip(words, longer, strict=True)]
        del words, longer
        B.trim()
        return pa.table(
            {
                "block": pa.array([*t.column("block").to_pylist(), -1], pa.int32()),
                "shard": pa.array([key[0].as_py()] * (len(blobs) + 1), pa.int32()),
                "answer": pa.array([*blobs, b""], pa.binary()),
                "tokens": pa.array([0] * len(blobs) + [n], pa.int64()),
                "distinct": pa.array([0] * len(blobs) + [v], pa.int64()),
            }
        )

    return run


_SCORES = {"n": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _scored(tokens: int, distinct: int, order: int, bits: int, prior: float, id_type: pa.DataType):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], id_type), **{k: pa.array([], kind) for k, kind in _SCORES.items()}})
        rows = B.unpacked(docs)
        g = Grams(rows.column("text"), order)
        rows = rows.drop_columns(["text"])
        parts = [B.read_ints(x.as_buffer().to_pybytes()) for _, x in sorted(zip(answers.column("shard").to_pylist(), answers.column("answer"), strict=True), key=lambda x: x[0])]
        counts = []
        for i, (k, by) in enumerate(_keys(g.hash, bits)):
            c = np.empty(len(k), np.float64)
            c[by] = np.concatenate([p[i] for p in parts])
            counts.append(c)
            del k, by, c
        del parts
        counts = [counts[0], *np.split(counts[1], np.cumsum([len(h) for h in g.hash[1:]])[:-1])] if order > 1 else counts[:1]
        g.hash.clear()
        automaton = Automaton(g, counts, tokens, distinct, prior)
        del counts
        n = len(g.lengths)
        score = automaton.read(g, order)
        out = {
            "doc_id": rows.column("doc_id"),
            "n": rows.column("n"),
            "held_out": pa.array(~rows.column("train").to_numpy()),
            "n_tokens": pa.array(g.lengths, pa.int64()),
            "n_known": pa.array(g.sums(automaton.known.astype(np.int64))),
            "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
            "base_score": pa.array(g.sums(automaton.root_weight)),
            "score": pa.array(score),
        }
        del g, automaton
        B.trim()
        return pa.table(out)

    return run


def lm_scores(docs: DataFrame, train: Column, order: int = ORDER, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """For each row of docs: doc_id, held_out (not train), n_tokens, n_known, train_tokens, base_score and score."""
    if order < 1 or prior <= 0:
        raise ValueError("the order must be at least one and the prior's weight above zero")
    sums = docs.agg(F.sum(F.octet_length(text_col)).alias("size"), F.count("*").alias("rows")).first()
    size = sums["size"] or 0
    n = B.block_count(size, block_bytes or BLOCK_BYTES)
    bits = key_bits(size // 2 + 2 * sums["rows"], order)  # a word and the space after it have two bytes at least
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    same = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit(" ")).cast("binary"), F.lit("\n").cast("binary"), F.col("text"))))
    blocks = B.packed(kept.withColumn("same", same), F.xxhash64("same"), n, one_each="same", copies="n")
    asked = blocks.groupBy("block").applyInArrow(_asked(n, order, bits), "shard int, block int, blob binary")
    answers = stored(asked.groupBy("shard").applyInArrow(_answered(bits), "block int, shard int, answer binary, tokens long, distinct long"), "lm-answers")
    sums = answers.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    tokens, distinct = sums["n"] or 0, sums["v"] or 0
    kind = kept.schema["doc_id"].dataType
    run = _scored(tokens, distinct, order, bits, prior, to_arrow_type(kind))
    known = answers.filter("block >= 0").select("block", "shard", "answer")
    scores = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"doc_id {kind.simpleString()}, n long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    # equal rows travelled as one
    each = scores.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return built_on(answers, each.drop("n"))
