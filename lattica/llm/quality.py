"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Every token has a sparse ternary index vector drawn from its hash. A token's word vector is its own index vector plus
the sum, normalised, of the index vectors of its neighbours in the sample. Words that the sample holds rarely are told
by their shape (case, script, length, the marks at the end), so words never seen have a vector, too. A text is the mean
of its tokens' vectors, with a pseudo-token for each immediate repetition, its length, and its share of distinct words.
A network of two layers, in numpy, learns the labels; a temperature fitted on a part of the sample that it did not learn
from makes its outputs probabilities.

The sample is bounded: SAMPLE labelled rows (the smallest hashes of doc_id), whole texts. The driver reads them one
partition at a time, so it never holds them all. Everything else covers all rows; scoring is a map without shuffle.

Cases: null and empty texts get the score of a text without tokens; rows with a null label teach nothing, of several
labels of one id the least counts, of several texts of one id the first by its bytes; without labels, or with labels of one
kind only, every score is the share of good ones (0.5 if none); long texts are read whole; repeated rows get equal scores, and
a score equal to the threshold is predicted 1; empty tables give empty results; other columns pass through, but those named
held_out, score or predicted, which are replaced.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored

SAMPLE = 4000
#: Of the sample, a partition that the driver reads at once.
PART_BYTES = 4 << 20
DIM, NONZERO, WINDOW = 96, 6, 2
#: Words with fewer places in the sample are told by their shape.
COMMON = 25
REPEAT = b" repeat"
THRESHOLD = 0.7
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+$")


def shape(word: bytes) -> bytes:
    """What a word looks like: letters, length and the marks at its end."""
    m = _MARKS.search(word)
    tail = m[0][:3] if m else b""
    core = word[: m.start()] if m else word
    if not core:
        return b" mark " + tail
    text = core.decode("utf-8", "replace")
    case = b"n" if text.isdigit() else b"d" if any(c.isdigit() for c in text) else b"U" if text.isupper() and len(text) > 1 else b"T" if text[0].isupper() and not any(c.isupper() for c in text[1:]) else b"l" if not any(c.isupper() for c in text) else b"m"
    if not text.isalnum():
        case += b"p"
    return b" %s%d %s" % (case, min(len(text), 16) // 4, tail)


def index_vector(token: bytes) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return v / np.sqrt(NONZERO)


class WordVectors:
    """Word vectors learned from sample texts, which are read twice."""

    def __init__(self, texts: Callable[[], Iterable[bytes]]):
        counts: Counter[bytes] = Counter()
        for t in texts():
            counts.update(t.split())
        self.common = frozenset(w for w, n in counts.items() if n >= COMMON)
        number: dict[bytes, int] = {}
        of: dict[bytes, int] = {}
        for w in counts:
            token = w if w in self.common else shape(w)
            of[w] = number.setdefault(token, len(number))
        index = np.stack([index_vector(t) for t in number]) if number else np.zeros((0, DIM), np.float32)
        # neighbours' vectors have a few ones and minus ones each: those are counted, some texts at a time
        place = np.nonzero(index)[1].reshape(-1, NONZERO)
        sign = np.sign(index[np.arange(len(index))[:, None], place])
        sums = np.zeros(index.size)
        at: list[np.ndarray] = []
        near: list[np.ndarray] = []

        def add() -> None:
            if at:
                row, col = np.concatenate(at), np.concatenate(near)
                np.add(sums, np.bincount((row[:, None] * DIM + place[col]).ravel(), weights=sign[col].ravel(), minlength=len(sums)), out=sums)
                at.clear()
                near.clear()

        for t in texts():
            ids = np.array([of[w] for w in t.split()], np.int64)
            for step in range(1, WINDOW + 1):
                if len(ids) > step:
                    at.extend((ids[step:], ids[:-step]))
                    near.extend((ids[:-step], ids[step:]))
            if sum(map(len, at)) >= 1 << 19:
                add()
        add()
        context = sums.reshape(index.shape).astype(np.float32)
        size = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = dict(zip(number, index + context / np.maximum(size, 1e-9), strict=True))

    def of(self, token: bytes) -> np.ndarray:
        found = self.vectors.get(token)
        return index_vector(token) if found is None else found


class Pooler:
    """Turns texts to features; keeps the rows of the words it has met."""

    #: So many different words are kept before the store starts anew.
    MOST = 250_000

    def __init__(self, words: WordVectors):
        self.words = words
        self.table = np.zeros((0, DIM), np.float32)
        self.rows: dict[bytes, int] = {}
        self.repeat = words.of(REPEAT)
        pooler = self

        class Store(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = pooler._row(word if word in words.common else shape(word))
                return n

        self.store = Store()
        self.added: list[np.ndarray] = []

    def _row(self, token: bytes) -> int:
        if token not in self.rows:
            self.rows[token] = len(self.rows)
            self.added.append(self.words.of(token))
        return self.rows[token]

    def features(self, text: bytes) -> np.ndarray:
        w = text.split()
        out = np.zeros(DIM + 2, np.float32)
        if not w:
            return out
        if len(self.store) > self.MOST:
            self.store.clear()
        ids = np.fromiter(map(self.store.__getitem__, w), np.int64, len(w))
        if self.added:
            self.table = np.concatenate([self.table, np.stack(self.added)])
            self.added = []
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        repeats = sum(map(operator.eq, w, w[1:]))
        out[:DIM] = (counts[used].astype(np.float32) @ self.table[used] + repeats * self.repeat) / len(w)
        out[DIM] = np.log1p(len(w)) / 8
        out[DIM + 1] = len(set(w)) / len(w)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """Two layers, Adam on the log loss with weight decay, temperature from held-back rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, seed: int = 7):
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64)
        order = rng.permutation(len(y))
        n_back = max(1, len(y) // 5)
        back, learn = order[:n_back], order[n_back:]
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0]
        first, second = [0.0] * 4, [0.0] * 4
        step = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
                a = z[part] @ self.p[0] + self.p[1]
                h = np.maximum(a, 0)
                d = (sigmoid(h @ self.p[2] + self.p[3]) - y[part]) / len(part)
                back_h = np.outer(d, self.p[2]) * (a > 0)
                grads = [z[part].T @ back_h + 1e-4 * self.p[0], back_h.sum(axis=0), h.T @ d + 1e-4 * self.p[2], d.sum()]
                step += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        logits, truth = self.logits(x[back]), y[back]

        def loss(t: float) -> float:
            q = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
            return float(-(truth * np.log(q) + (1 - truth) * np.log(1 - q)).mean())

        self.temperature = min(np.geomspace(0.5, 20, 80), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x.astype(np.float64) - self.mean) / self.scale
        return np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.logits(x) / self.temperature)


class Model:
    """texts: gives the sample's texts, each time anew; y: their labels."""

    def __init__(self, texts: Callable[[], Iterable[bytes]], y: np.ndarray):
        self.words = WordVectors(texts)
        pool = Pooler(self.words)
        x = [pool.features(t) for t in texts()]
        self.network = Network(np.stack(x) if x else np.zeros((0, DIM + 2)), y)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, part_bytes: int = PART_BYTES) -> Model:
    """Learns from at most `sample` of the labelled ids."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r[id_col], float(r["y"])) for r in chosen], f"__q_id {labels.schema[id_col].dataType.simpleString()}, __q_y double")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # each chosen id once: of repeated ids the first text by its bytes
    found = stored(docs.join(F.broadcast(ids), F.col(id_col) == F.col("__q_id")).groupBy("__q_id", "__q_y").agg(F.min(text).alias("t")), "quality-sample")
    size = found.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    parts = found.repartitionByRange(max(1, -(-size // part_bytes)), "__q_id").sortWithinPartitions("__q_id")
    y = np.array([r["__q_y"] for r in found.select("__q_id", "__q_y").orderBy("__q_id").collect()])  # at most sample rows
    model = Model(lambda: (bytes(r["t"]) for r in parts.select("t").toLocalIterator(prefetchPartitions=True)), y)
    discard(found)
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score: the probability that the label is 1."""
    names = [c for c in docs.columns if c != score_col]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score_col, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        pool = Pooler(model.words)
        for batch in batches:
            texts = batch.column(names.index(text_col))
            x = np.stack([pool.features((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts]) if len(texts) else np.zeros((0, DIM + 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.network.probability(x), pa.float64())], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """docs with held_out, score and predicted. Learns from labels of rows that are not held out."""
    split = labels.withColumn("__q_out", held_out)
    model = fit(docs, split.filter(~F.col("__q_out")).drop("__q_out"), id_col)
    scored = score_quality(docs.drop("predicted").withColumn("held_out", held_out), model)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
