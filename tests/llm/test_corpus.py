"""Language model, n-gram join, permutation index, blocks and the pipeline."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import backoff_lm, blocks, ngram_join, permutation_index
from lattica.llm.components import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**63), max_size=30), min_size=1, max_size=4))
def test_integers_round_trip(lists):
    arrays = [np.array(x, np.uint64) for x in lists]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks.read_ints(blocks.write_ints(*arrays)), arrays))


def test_shards_are_ranges():
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    s = blocks.shard_of(h, 7)
    assert (np.diff(s.astype(int)) >= 0).all() and set(s.tolist()) == set(range(7))


class BruteModel:
    """The model by its definition, n-grams as tuples."""

    def __init__(self, rows, order, prior):
        self.order, self.prior, self.c = order, prior, collections.Counter()
        self.n, words = 0, set()
        for _, t, train in rows:
            if train:
                seq = [b" s", *(t or "").encode().lower().split(), b" e"]
                self.n += len(seq) - 1
                words.update(seq[1:])
                for k in range(1, order + 1):
                    self.c.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
        self.v, self.words = len(words), words

    def p(self, w, h):
        if not h:
            return ((self.c[w,] if w != b" s" else 0) + 0.5) / (self.n + 0.5 * (self.v + 1))
        return (self.c[*h, w] + self.prior * self.p(w, h[1:])) / (self.c[h] + self.prior) if self.c[h] else self.p(w, h[1:])

    def score(self, text):
        seq = [b" s", *(text or "").encode().lower().split(), b" e"]
        return sum(math.log10(self.p(seq[i], tuple(seq[max(0, i - self.order + 1) : i]))) for i in range(1, len(seq)))

    def row(self, text):
        seq = [*(text or "").encode().lower().split(), b" e"]
        return len(seq), sum(w in self.words for w in seq), self.n, sum(math.log10(self.p(w, ())) for w in seq), self.score(text)


ROWS = [(1, "The cat sat on the mat", True), (2, "the cat ate", False), (3, None, True), (4, "", False), (5, "THE the É é\tcat\n", True), (6, "word " * 3000, False), (7, "the cat sat on the mat", True), (7, "the cat sat on the mat", True), (None, "unseen here", False), (8, "on the mat the cat sat on the cat sat on", False), (None, None, None)]


@pytest.mark.parametrize("order, prior, block_bytes", [(1, 1.0, 1 << 20), (2, 0.5, 12), (3, 4.0, 1 << 20), (3, 4.0, 12), (5, 2.0, 40)])
def test_language_model(spark, order, prior, block_bytes):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score boolean")
    model = BruteModel(ROWS, order, prior)
    got = backoff_lm.lm_scores(df, F.col("score"), order=order, prior=prior, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda x: str((x[0], x[2], round(x[6], 6)))
    want = sorted(((r[0], not r[2], *model.row(r[1])) for r in ROWS), key=key)
    mine = sorted(map(tuple, got.collect()), key=key)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-11)


def test_equal_rows_count_as_often_as_they_stand(spark):
    rows = [(1, "a b c", True)] * 700 + [(2, "a b d", True), (3, "a b", False)]
    model = BruteModel(rows, 3, 4.0)
    got = backoff_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, t boolean"), F.col("t"), prior=4.0).collect()
    assert len(got) == 702 and {r["doc_id"]: r["score"] for r in got} == pytest.approx({i: model.score(t) for i, t, _ in rows}, rel=1e-11)


def automaton_of(rows, order, prior):
    train = np.array([bool(r[2]) for r in rows])
    g = backoff_lm.Grams(pa.array([(r[1] or "").encode() for r in rows], pa.binary()), order, train.astype(np.int64))
    model = BruteModel(rows, order, prior)
    return g, backoff_lm.Automaton(g, [c.astype(float) for c in g.counts], model.n, model.v, prior), model


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_states_arcs_and_failures(order):
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choices("abcde", k=rnd.randint(0, 12))), i % 3 > 0) for i in range(40)]
    g, a, model = automaton_of(rows, order, 1.5)
    names = [*(words_of(pa.array([(r[1] or "").encode() for r in rows], pa.binary()))), b" s", b" e"]
    contexts = {()} | {h for h in model.c if len(h) < order and h[-1] != b" e"}
    assert len(a.fail) == len(contexts)  # a state for each context
    # every state's outgoing weights are a distribution: its arcs, and what the failure arc leaves for the rest
    for s in range(1, len(a.fail)):
        arcs = slice(*np.searchsorted(a.arc, [s * a.n_words, (s + 1) * a.n_words]))
        seen, word = a.weight[arcs], a.arc[arcs] % a.n_words
        below = sum(10.0 ** a.step(np.array([a.fail[s]]), np.array([w]))[0][0] for w in word)
        assert (10.0**seen).sum() + 10.0 ** a.failure[s] * (1 - below) == pytest.approx(1)
        assert a.fail[s] < s
    # reading any words leads to the longest context that the model has
    for _ in range(60):
        seq = rnd.choices([i for i, w in enumerate(names[:-2])], k=8)
        state, history = np.array([a.start]), [b" s"]
        for w in seq:
            weight, state = a.step(state, np.array([w]))
            h = tuple(history[-(order - 1) :]) if order > 1 else ()
            assert weight[0] == pytest.approx(math.log10(model.p(names[w], h)))
            history.append(names[w])
            longest = next(k for k in range(min(order - 1, len(history)), -1, -1) if k == 0 or tuple(history[-k:]) in contexts)
            depth, s = 0, int(state[0])
            while s:
                depth, s = depth + 1, int(a.fail[s])
            assert depth == longest


def words_of(texts):
    from lattica.llm.common import words_in

    return words_in(texts)[2]


@pytest.mark.parametrize("piece", [1, 2, 5, 100])
def test_pieces_of_long_texts_carry_the_state(piece):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices("abcdefg", k=rnd.randint(0, 60))), i % 2 > 0) for i in range(30)]
    for order in (1, 2, 4):
        g, a, model = automaton_of(rows, order, 3.0)
        assert a.read(g, order, piece) == pytest.approx([model.score(t) for _, t, _ in rows], rel=1e-11)


def test_language_model_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in backoff_lm.lm_scores(df, F.lit(False)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["score"] == got[1]["base_score"] == 0.0 and got[2]["n_tokens"] == 1
    assert backoff_lm.lm_scores(df.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        backoff_lm.lm_scores(df, F.lit(True), order=0)


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_groups(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(rnd, n=60):
    words = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(5, 60))] for _ in range(6)]
    common = [rnd.choice(words) for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.3:
            w = w + common
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed, percent, block_bytes", [(0, 75, 300), (1, 75, 1 << 20), (2, 60, 500), (3, 90, 900)])
def test_groups_equal_brute_force(spark, seed, percent, block_bytes):
    rnd = random.Random(seed)
    texts = near_copies(rnd) + ["One two", "one  TWO", "one two three", "", None, "  ", "a b c d e", "A b C d e", "x " * 4000]
    rows = [(rnd.randrange(10**6), t) for t in texts] + [(None, "one two"), (5, texts[0]), (5, texts[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("k", F.lit(1))
    got = ngram_join.jaccard_groups(df, percent, block_bytes=block_bytes).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows, percent)


def test_a_large_group_of_near_copies_leaves_few_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(240):
        w = list(base)
        for at in rnd.sample(range(80), 1 if i % 4 else 2):
            w[at] = f"v{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    listed, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, texts, percent, label: (listed.append(pairs.count()) if label == "rest" else None) or links(pairs, texts, percent, label))
    got = ngram_join.jaccard_groups(df)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute_groups(rows, 75)
    monkeypatch.setattr(ngram_join, "MORE_ROUNDS", ngram_join.ROUNDS)
    ngram_join.jaccard_groups(df)
    assert listed[0] < 0.5 * listed[1] and listed[1] > 100, listed


def test_one_of_each(spark):
    rows = [(4, "a b c d e f g", "p"), (2, "A b c d e f  g", "q"), (2, "A b c d e f  g", "q"), (9, "h i j", None), (7, "", "r"), (8, None, "s"), (None, "h i j", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect()) == [(2, "A b c d e f  g"), (7, ""), (8, None), (9, "h i j")]
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=14), min_size=1, max_size=8), st.sets(st.integers(0, 40), max_size=14), st.integers(1, 8), st.integers(1, 5))
def test_prefix_tree(sets, probe, least, step):
    arrays = [np.array(sorted(s, reverse=True), np.uint64) for s in sets]
    tree = ngram_join.PrefixTree(arrays)
    assert sorted(tree.probe(np.array(sorted(probe), np.uint64), [least] * len(sets), step)) == [i for i, s in enumerate(sets) if len(s & probe) >= least]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


def neighbours_brute(rows, k):
    data = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in data:
        if i % 2 == 0:
            near = sorted((-float((q * x).sum() / math.sqrt((q * q).sum()) / math.sqrt((x * x).sum())), j) for j, x in data if j != i and len(x) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200, 230)]  # ties
    rows += [(300, None), (302, [0.0] * 6), (304, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (306, [float("nan")] * 6), (308, [float("inf")] * 6), (None, [1.0] * 6), (310, [1.0, 2.0]), (312, [2.0, 1.0]), (314, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = neighbours_brute(rows, 5)
    for segment, part in ((1000, 1000), (40, 20)):
        got = {}
        for r in permutation_index.nearest_neighbours(df, F.col("vec_id") % 2 == 0, segment_rows=segment, query_rows=part).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(got) == {i for i in want if want[i]}
        for i, near in got.items():
            assert [j for j, _ in near] == [j for j, _ in want[i]] and [s for _, s in near] == pytest.approx([s for _, s in want[i]], abs=1e-12)
    assert permutation_index.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_extreme_components_and_many_lengths(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 5))
    rows = [(i, (v * 10.0 ** (200 if i % 3 else -200)).tolist()) for i, v in enumerate(base)] + [(50, [5e-324, 0.0, 0.0, 0.0, 0.0]), (52, [1.7e308] * 5)]
    rows += [(100 + 2 * n + j, [1.0 + j] + [0.0] * (6 + n)) for n in range(20) for j in (0, 1)]  # more lengths than have fitted pivots
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation_index.nearest_neighbours(df, F.col("vec_id") % 2 == 0).collect()
    fives = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows if len(v) == 5]
    want = neighbours_brute(fives, 5)
    for i in want:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [j for _, j, _ in mine] == [j for j, _ in want[i]] and [s for *_, s in mine] == pytest.approx([s for _, s in want[i]], abs=1e-12)
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] >= 100} == {(100 + 2 * n, 101 + 2 * n, 1.0) for n in range(20)}


def test_recall_over_segments_with_a_hot_group(spark, monkeypatch):
    """At the query's parameters: 6,000 vectors without clusters, and 4,000 near one direction."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10000, 32))
    x[6000:] = x[0] + 0.05 * rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = permutation_index.nearest_neighbours(df, F.col("vec_id") % 50 == 0, segment_rows=2500, query_rows=64).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 10000, 50):
        near = unit @ unit[q]
        near[q] = -9
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-near)[:5].tolist()))
    assert len(got) == 1000 and hits / 1000 >= 0.9


def test_recall(spark, sf):
    from lattica.llm.queries import QUERIES

    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    index = permutation_index.Index(x, permutation_index.pivots_of(x[::3], 128), 32)
    hits = total = 0
    for q in range(0, len(ids), 10):  # a tight share of the rows, so that the footrule decides
        agree = index.agreement(index.nearest(x[q : q + 1])[0])
        kept = set(np.flatnonzero(agree >= np.sort(agree)[-60]))
        true = np.argsort(-(x @ x[q]))[1:6]
        hits, total = hits + len(kept & set(true)), total + 5
    assert hits / total > 0.75
    got = QUERIES["op3_permutation_index"](spark, sf).collect()
    good = sum(r["vec_id"] in set(ids[np.lexsort((ids, -np.where(ids == r["query_id"], -9, x @ x[r["query_id"]])))[:5]]) for r in got)
    assert good / len(got) >= 0.9


def test_footrule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 8))
    index = permutation_index.Index(x, permutation_index.pivots_of(rng.normal(size=(20, 8)), 20), 6)
    near = index.nearest(x)
    rank = np.full((30, 20), 6)
    for i in range(30):
        rank[i, near[i]] = np.arange(6)
    for i in range(5):
        footrule = np.abs(rank - rank[i]).sum(axis=1)
        assert (index.agreement(near[i]) == 6 * 7 - footrule).all()


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        from lattica.llm.common import stored

        docs = stored(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert all(a > b for a, b in zip(counts, counts[1:])) and counts[-1] > 0.7 * counts[0]
    out = cp.run(spark, sf)
    assert set(columns) < set(out.columns) and {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    held = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = [r["text"] for r in out.select("text").collect()]
    assert not any(b in t for b in held.values() for t in texts)
    kept = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()][:400], 75)
    assert all(d == c for d, _, c in kept)


def test_pipeline_stages_take_nothing_and_odd_rows(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing columns, stage by stage."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    empty = docs.limit(0)
    prose = docs.filter("lang = 'en' AND length(text) BETWEEN 800 AND 1500").orderBy("doc_id").first()["text"]
    long = " ".join(f"{prose[i % 700 : i % 700 + 60]}" for i in range(12000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one two three four five six seven", None, None, 3), (3, prose, "en", None, 1), (3, prose, "en", None, 1), (None, prose, None, "s", None), (4, long, "en", "s", len(long))]
    clashing = "held_out string, score string, predicted string, n_removed string, matches string, component_id string, block string"
    odd = spark.createDataFrame([(*r, *["mine"] * 7) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clashing}")
    left = {}
    for name, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
        out = stage(spark, odd, sf)
        if name != cp.STAGES[-1][0]:
            assert out.columns == odd.columns and out.dtypes == odd.dtypes
            assert {r[c] for r in out.collect() for c in odd.columns[5:]} <= {"mine"}
        left[name] = sorted(((r["doc_id"], len(r["text"] or "")) for r in out.collect()), key=str)
    size = lambda i: (rows[i][0], len(rows[i][1] or ""))
    assert left["quality classifier"].count((3, len(prose))) in (0, 2)  # one verdict
    assert left["line dedup"] == sorted(map(size, range(8)), key=str)  # nothing is on five sites
    assert left["n-gram Jaccard join"] == sorted(map(size, (0, 1, 2, 3, 4, 7)), key=str)
    assert left["benchmark decontamination"] == sorted(map(size, range(8)), key=str)
    mixed = cp.mixture(spark, odd, sf)
    assert set(odd.columns) <= set(mixed.columns) and dict(mixed.dtypes)["block"] == "bigint" and {size(7)} <= set(left[cp.STAGES[-1][0]])


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage by its definition on a small corpus: 2 sites with boilerplate, copies, benchmark passages, junk."""
    import corpus_pipeline as cp

    rnd = random.Random(33)
    words = ["".join(rnd.choices("aeiounrstlm", k=rnd.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rnd.choices(words, k=n)).capitalize() + "."
    exam = [(i, say(18)) for i in range(4)]
    notices = ["Subscribe to our letter today.", "Home", "All rights reserved by us."]
    docs, kinds = [], {}
    for i in range(260):
        lines = [say(rnd.randint(20, 40)) for _ in range(rnd.randint(1, 3))]
        kind = "plain"
        if i % 9 == 4:
            kind, lines = "junk", [" ".join(w.upper() + "%%%!!" for w in rnd.choices(words[:20], k=40))]
        elif i % 13 == 5:
            kind = "exam"
            at = rnd.randrange(len(lines))
            lines[at] += " " + exam[i % 4][1].replace("e", "E", 1)
        if kind != "junk" and i % 3 == 0:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(notices))
        kinds[i] = kind
        docs.append((i, "\n".join(lines), "en", f"s{i % 7}", 0))
    for j, i in enumerate(rnd.sample([i for i in kinds if kinds[i] == "plain"], 30)):
        w = docs[i][1].split(" ")
        w[rnd.randrange(len(w))] += "x" if j % 2 else ""
        kinds[1000 + j] = "plain"
        docs.append((1000 + j, " ".join(w), "en", f"s{j % 7}", 0))
    labels = [(i, int(k != "junk"), 0) for i, k in kinds.items() if i % 2 == 0 or k == "junk"]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", exam, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = [r for r in docs if kinds[r[0]] != "junk"]
    # lines on five sites or more stay where they come first
    sites, first = collections.defaultdict(set), {}
    for i, t, _, s, _ in sorted(kept):
        for at, line in enumerate(x.strip(" ") for x in t.split("\n")):
            if line:
                sites[line].add(s)
                first.setdefault(line, (i, at))
    cleaned = []
    for i, t, lang, s, _ in kept:
        lines = [x for at, x in enumerate(t.split("\n")) if not x.strip(" ") or len(sites[x.strip(" ")]) < 5 or first[x.strip(" ")] == (i, at)]
        if len(lines) == len(t.split("\n")) or "".join(lines).strip():
            cleaned.append((i, "\n".join(lines), lang, s, len("\n".join(lines))))
    assert sum(len(sites[n]) >= 5 for n in notices) == 3
    groups = {d: c for d, _, c in brute_groups([(r[0], r[1]) for r in cleaned], 75)}
    single = [r for r in cleaned if groups[r[0]] == r[0]]
    assert len(single) < len(cleaned) - 10
    from lattica.llm import decontaminate as dc
    from tests.llm.test_texts import edits

    clean = [r for r in single if all(edits(p, dc.normal(r[1])) > int(dc.ERROR_RATE * len(p)) for p in (dc.normal(t) for _, t in exam))]
    assert 10 < len(single) - len(clean) and {kinds[r[0]] for r in clean} == {"plain"}
    out = cp.run(spark, str(tmp_path)).collect()
    known = {r[0]: r for r in clean}
    assert {r["doc_id"] for r in out} == set(known) and all(tuple(r[:5]) == known[r["doc_id"]] for r in out)
    from tests.llm.test_native import drawn

    got = sorted((r["doc_id"], r["n_tokens"], r["epoch"], r["block"], r["slot"]) for r in out)
    assert got == drawn([(r[0], r[1], r[3]) for r in clean], entropy_ratio=0.95, max_repetition=2.0)


def test_pipeline_counts_short_lines(spark, sf):
    import corpus_pipeline as cp

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(i, f"Les.\nText number {i} of its own.\n\nX", "fr", f"s{i}", 0) for i in range(6)] + [(9, "Les.", "fr", "s9", 4)]
    out = {r["doc_id"]: r["text"] for r in cp.line_dedup(spark, spark.createDataFrame(rows, schema), sf).collect()}
    assert out == {0: rows[0][1], **{i: f"Text number {i} of its own.\n" for i in range(1, 6)}}
