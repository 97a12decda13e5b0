"""N-gram Jaccard self-join by prefix trees, for the connected groups of near-duplicates.

A text's set are its distinct word shingles; two texts link when the Jaccard similarity reaches a whole percentage.
Equal texts are one node from the start. The rest is exact:

1. Shingles get a global order: rarest first, by the number of distinct texts that hold them (counted corpus-wide by
   blocks that ask shards, see blocks.py), ties by hash. A text of n shingles must share ceil(s n) of them with any
   partner, so one of its first n - ceil(s n) + 1. Shingles that no other text has match nothing, so a text with enough
   of those leaves here; most texts do.
2. For each remaining prefix shingle the texts that post it are candidates of one of them: a star, not all pairs.
   Candidates are verified, and the links found make provisional groups. A second round does the same across the
   groups, with the centre drawn for each shingle anew; and more do, with several centres, while they find links and the
   groups still meet in many pairs, as around a large group of near-copies.
3. Texts that post the same shingle and are not in one group yet become candidate pairs if their sizes, the places of the
   shingle and their parity sketches allow the overlap (sets that differ in d shingles have sketches that differ in at
   most d bits). They are verified, too. Now every pair that could link has either been verified or
   lies within one group; so the groups are the exact components.

Verification keeps the ordered sets of the partners of a text in a prefix tree. It is walked with the running overlap,
which partners that begin alike share, and a subtree is left once what remains of its sets cannot reach the overlap.

Shingles are told apart by 64 bits of hash until the shards have counted them; those that several texts hold then have
numbers, which are shorter to move.

Cases: null texts and those without words have an empty set and link with nothing, equal ones included; a text with
fewer words than a shingle is one shingle; long texts are shingled whole; repeated rows and copies are members of their
text's group, and of rows that tie for the smallest id one_of_each() keeps one (the first text by MD5); a null doc_id has a
null component if all of its group are null; empty tables give empty results; other columns are not read by
jaccard_groups(), and pass through one_of_each() whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import built_on, discard, mix64, stored, words_in
from .components import components

WIDTH = 5
PERCENT = 75
#: Partners of one text that are verified by one task; more are dealt to several.
STAR = 256
#: Rounds of stars before the remaining pairs are listed: so many, and more, up to the second number, while a round finds
#: links and the groups meet in more than PAIRS pairs for each posting.
ROUNDS, MORE_ROUNDS, PAIRS = 2, 6, 2
#: Centres of a shingle in those further rounds.
CENTRES = 8
#: Postings of one shingle that are paired by one task; longer lists are dealt to a grid of tasks.
TILE = 256


def shingles(ids: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a word sequence (numbers into the hashes of words)."""
    h = hashes[ids]
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def overlap_for(n: int, m: int, percent: int) -> int:
    """The least overlap with which sets of n and m link: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


class PrefixTree:
    """Ordered sets, kept sorted so that those that begin alike are neighbours; shared[i] is how many first elements
    set i has in common with the one before. Walking them in this order is a depth-first walk of their trie."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def probe(self, probe: np.ndarray, least: list[int], step: int = 64) -> list[int]:
        """Which sets (their numbers) have at least least[number] elements in common with probe (sorted by value)."""
        found = []
        path = np.zeros(1, np.int64)  # the overlap of the first 0, 1, 2, ... elements of the path
        for number, own, shared in zip(self.order, self.sets, self.shared, strict=True):
            # the part of the path that this set shares is counted already, as far as the walk has come
            path = path[: min(shared, len(path) - 1) + 1]
            n, want = len(own), least[number]
            while (at := len(path) - 1) < n and path[-1] + n - at >= want:
                new = own[at : at + step]
                spot = np.minimum(np.searchsorted(probe, new), len(probe) - 1)
                path = np.concatenate([path, path[-1] + np.cumsum(probe[spot] == new)]) if len(probe) else np.concatenate([path, np.full(len(new), path[-1])])
            if len(path) - 1 >= n and path[n] >= want:
                found.append(number)
        return found


class _Block:
    """The distinct texts of a block: key, least document id, shingles."""

    def __init__(self, t: pa.Table, width: int):
        rows = B.unpacked(t).select(["k", "text"])
        at = {}
        keys = rows.column("k").to_pylist()
        for i, k in enumerate(keys):
            at.setdefault(k, i)
        self.keys = sorted(at)
        ids, starts, words = words_in(rows.column("text").take(pa.array([at[k] for k in self.keys], pa.int64())))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.sets = [shingles(ids[a:b], hashes, width) for a, b in zip(starts, starts[1:], strict=False)]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct shingles, where each of all sets stands in them, how many texts have each."""
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        return np.unique(every, return_inverse=True, return_counts=True)


def _asked(shards: int, width: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, _, n = _Block(t, width).counted()
        B.trim()
        cut = np.searchsorted(B.shard_of(keys, shards), np.arange(shards + 1))
        full = [s for s in range(shards) if cut[s + 1] > cut[s]]
        blobs = [B.write_ints(B.deltas(keys[cut[s] : cut[s + 1]]), n[cut[s] : cut[s + 1]]) for s in full]
        return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _answered(shards: int):
    """How many texts have each shingle that a block asks for; and a number, the same for all blocks, of each that
    several have. The numbers grow with the hash."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        asked = [B.read_ints(x.as_buffer().to_pybytes()) for x in t.column("blob")]
        _, at = np.unique(np.concatenate([B.undeltas(a[0]) for a in asked]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([a[1] for a in asked]).astype(np.float64)).astype(np.uint64)
        ends = np.cumsum([len(a[0]) for a in asked])
        del asked
        number = np.cumsum(total > 1).astype(np.uint64) * np.uint64(shards) + np.uint64(key[0].as_py())
        blobs = []
        for i in np.split(at, ends[:-1]):
            f = total[i]
            blobs.append(B.write_ints(f, B.deltas(number[i][f > 1])))
        return pa.table({"block": t.column("block"), "shard": t.column("shard"), "answer": pa.array(blobs, pa.binary())})

    return run


#: 64-bit words of a text's parity sketch.
SKETCH = 8
_SURVIVOR = "id long, k binary, n int, own int, toks binary, prefix array<long>, sketch array<long>"


def parity_sketch(s: np.ndarray) -> list[int]:
    """A bit for each of 64 SKETCH classes of hashes: whether the set has an odd number of them."""
    odd = np.bincount((s % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _survivors(width: int, percent: int):
    """A row for each text: a number (block and place in it), its key and n; and, if it may have a partner, how many of its
    shingles no other text has, the rest in the global order, and those of them that lie in its prefix."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            b = _Block(docs, width)
            _, at, _ = b.counted()
            parts = [B.read_ints(x) for _, x in sorted(zip(answers.column("shard").to_pylist(), answers.column("answer").to_pylist(), strict=True))]
            known = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            number = np.zeros(len(known), np.uint64)
            if parts:
                number[known > 1] = np.concatenate([B.undeltas(p[1]) for p in parts])
            low = 0
            first = key[0].as_py() << 32
            for i, (k, s) in enumerate(zip(b.keys, b.sets, strict=True), first):
                mine = at[low : low + len(s)]
                f = known[mine]
                low += len(s)
                own = int(np.count_nonzero(f == 1))
                length = len(s) - needed(len(s), percent) + 1
                if not len(s) or own >= length:
                    out.append((i, k, len(s), own, None, None, None))
                    continue
                toks = number[mine]
                toks = toks[np.lexsort((toks, f))[own:]]
                out.append((i, k, len(s), own, B.write_ints(toks), toks[: length - own].astype(np.int64).tolist(), parity_sketch(s)))
            del b, at, known, number
            B.trim()
        ids, ks, ns, owns, toks, prefixes, sketches = zip(*out, strict=True) if out else ((),) * 7
        return pa.table({"id": pa.array(ids, pa.int64()), "k": pa.array(ks, pa.binary()), "n": pa.array(ns, pa.int32()), "own": pa.array(owns, pa.int32()), "toks": pa.array(toks, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.list_(pa.int64()))})

    return run


def _verified(percent: int):
    def run(key: tuple[pa.Scalar, ...], edges: pa.Table, sets: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if edges.num_rows and sets.num_rows:
            size = dict(zip(sets.column("id").to_pylist(), sets.column("n").to_pylist(), strict=True))
            toks = {i: B.read_ints(t.as_buffer().to_pybytes())[0] for i, t in zip(sets.column("id").to_pylist(), sets.column("toks"), strict=True)}
            by: dict[int, list[int]] = {}
            for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
                by.setdefault(a, []).append(b)
            for a, partners in by.items():
                # most shared first: near-copies then begin alike
                tree = PrefixTree([toks[b][::-1] for b in partners])
                found += [(a, partners[i]) for i in tree.probe(np.sort(toks[a]), [overlap_for(size[a], size[b], percent) for b in partners])]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _able(percent: int) -> Column:
    """Whether sets of n and n2 can link if place and place2 are those of the first shingle that they share."""
    want = _want(percent)
    return (F.least("n", "n2") >= want) & (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= want)


def _want(percent: int) -> Column:
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / F.lit(100.0 + percent) - 1e-9)


def _alike(percent: int) -> Column:
    """Whether the sketches s0, s1, ... and s02, s12, ... allow the overlap."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}2"))) for i in range(SKETCH)])
    return differ <= F.col("n") + F.col("n2") - 2 * _want(percent)


def _second(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*but, *[F.col(c).alias(f"{c}2") for c in df.columns if c not in but])


def _plausible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, deg) whose sizes and sketches allow a link."""
    known = pairs.join(facts.withColumnRenamed("id", "a"), "a").join(_second(facts).withColumnRenamed("id2", "b"), "b")
    return known.filter((F.least("n", "n2") >= _want(percent)) & _alike(percent)).select("a", "b", "deg")


def _links(candidates: DataFrame, texts: DataFrame, percent: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Which candidates (a, b, deg) link; deg: at least as many partners as a may have. Also the candidates, as pairs in
    order. Each bucket of pairs gets the sets of its texts once."""
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / STAR).cast("long"))
    pairs = stored(candidates.select("a", "b", salt.alias("salt")), f"{label}-pairs")
    bucket = F.pmod(F.xxhash64("a", "salt"), F.lit(max(1, pairs.count() // (8 * STAR))))
    edges = pairs.select(bucket.alias("bucket"), "a", "b")
    ends = reduce(DataFrame.union, [pairs.select(bucket.alias("at"), F.col(c).alias("id")).distinct() for c in ("a", "b")]).distinct()
    links = edges.groupBy("bucket").cogroup(ends.join(texts, "id").groupBy("at")).applyInArrow(_verified(percent), "a long, b long")
    return stored(links, f"{label}-links"), pairs


def _joined(groups: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The groups (id, label) after more links: components of the groups that the links touch."""
    if not links.take(1):
        return groups
    if groups is None:
        first = components(links, "a", "b")
        return built_on(first, first.withColumnRenamed("node", "id"))
    of = lambda c: groups.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    edges = stored(edges.filter("a <> b").distinct(), "group-links")
    if not edges.take(1):
        discard(edges)
        return groups
    more = components(edges, "a", "b")
    top = more.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = groups.join(top, "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    out = stored(old.unionByName(more.withColumnRenamed("node", "id").join(groups.select("id"), "id", "left_anti")), "groups")
    discard(edges, more, groups)
    return out


def _labelled(post: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Postings with the label of the text's group, its own number if it has none."""
    if groups is None:
        return post.withColumn("label", F.col("id"))
    return post.drop("label").join(groups, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _star(post: DataFrame, number: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The postings of shingles that several groups post, and candidates (a, b, deg): in each of those shingles one text
    (in further rounds several) with those of other groups."""
    x = F.struct(F.col("id").alias("a"), F.col("label").alias("al"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    # first one order of the texts, so that texts alike choose alike; then another in each shingle
    draws = [F.xxhash64("id", F.lit(number)) if number == 0 else F.xxhash64("id", "tok", F.lit(number))]
    if number >= ROUNDS:
        draws = [F.xxhash64("id", "tok", F.lit(number), F.lit(i)) for i in range(CENTRES)]
    drawn = F.array_distinct(F.array(*[F.min_by(x, d) for d in draws])).alias("xs")
    centre = post.groupBy("tok").agg(drawn, F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    apart = (F.col("label") != F.col("al")) & _able(percent)
    if number < ROUNDS:
        mixed = stored(post.hint("merge").join(centre.select("tok", F.col("xs")[0].alias("x"), "c").select("tok", "x.*", "c"), "tok"), "postings")  # a sort-merge join's hot partitions are split
        rows = mixed.filter(apart)
    else:
        centre = stored(centre.select("tok", "c", "xs"), "centres")
        mixed = stored(post.hint("merge").join(centre.select("tok"), "tok"), "postings")
        rows = mixed.hint("merge").join(centre.select("tok", "c", F.inline("xs")), "tok").filter(apart)
    pairs = rows.groupBy(F.least("a", "id").alias("u"), F.greatest("a", "id").alias("v")).agg(F.min("a").alias("a"), F.max("c").alias("deg"))
    # a centre keeps its partners; of two that are centres of each other the smaller takes the pair
    return mixed, built_on(centre, pairs.select("a", F.when(F.col("a") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("b"), "deg"))


def _crowded(post: DataFrame) -> bool:
    """Whether the pairs of postings of one shingle in different groups are more than PAIRS for each posting."""
    c = F.col("c").cast("double")
    each = post.groupBy("tok", "label").agg(F.count("*").alias("c")).groupBy("tok").agg(F.sum(c).alias("n"), F.sum(c * c).alias("q"))
    r = each.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2).alias("pairs")).first()
    return bool(r["n"]) and r["pairs"] > PAIRS * r["n"]


def _rest(post: DataFrame, facts: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), but those done, of texts in different groups that post a shingle, if sizes, places and sketches allow
    a link. A list of more than TILE postings is cut to tiles, and each two tiles meet in a task of their own."""
    tiles = F.ceil(F.count("*") / TILE).cast("int").alias("tiles")
    mixed = post.groupBy("tok").agg(F.min("label").alias("low"), F.max("label").alias("high"), tiles).filter("low <> high").select("tok", "tiles")
    tile = F.pmod(F.xxhash64("id", F.lit(3)), F.col("tiles")).cast("int").alias("tile")
    listed = stored(post.hint("merge").join(mixed, "tok").select("*", tile).join(facts.drop("n"), "id"), "postings")
    right = _second(listed.withColumn("low", F.explode(F.sequence(F.lit(0), "tile"))).drop("tiles"), "tok", "low").withColumnRenamed("tile2", "high")
    left = listed.withColumn("high", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).drop("tiles").withColumnRenamed("tile", "low")
    once = (F.col("low") < F.col("high")) | (F.col("id") < F.col("id2"))
    pairs = left.join(right, ["tok", "low", "high"]).filter((F.col("label") != F.col("label2")) & once & _able(percent) & _alike(percent))
    pairs = pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    out = stored(pairs.join(done, ["a", "b"], "left_anti"), "rest")
    discard(listed)
    return out


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """For each row of docs: doc_id, n_shingles and component_id, the smallest doc_id of its group; also text_key (the
    text's MD5) and chosen: whether the row's text and id are those that stay if one document of each group does."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("k"), F.col(text_col).cast("binary").alias("text"))
    n_blocks = B.block_count(B.text_bytes(docs, text_col), block_bytes or B.BLOCK_BYTES)
    blocks = B.packed(rows.select("k", "text").filter("k is not null"), F.xxhash64("k"), n_blocks, one_each="k")
    asked = blocks.groupBy("block").applyInArrow(_asked(n_blocks, width), "shard int, block int, blob binary")
    answers = asked.groupBy("shard").applyInArrow(_answered(n_blocks), "block int, shard int, answer binary")
    found = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_survivors(width, percent), _SURVIVOR), "shingle-sets")
    able = found.filter("toks is not null")
    texts = able.select("id", "n", "toks")
    facts = able.select("id", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])

    # places count from 0 in the whole order: those that only this text has come first
    post = able.select("id", "n", "own", F.posexplode("prefix").alias("i", "tok")).select("tok", "id", "n", (F.col("i") + F.col("own")).alias("place"))
    groups, tried, held = None, [], None
    for number in range(MORE_ROUNDS):
        if number >= ROUNDS and not (linked and _crowded(_labelled(post, groups))):
            break
        mixed, star = _star(_labelled(post, groups), number, percent)
        discard(held)
        post, held = mixed.select("tok", "id", "n", "place"), mixed
        links, pairs = _links(_plausible(star, facts, percent), texts, percent, "star")
        linked = bool(links.take(1))
        groups = _joined(groups, links)
        discard(links, star)
        tried.append(pairs)
    done = reduce(DataFrame.unionByName, [p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for p in tried]).distinct()
    rest = _rest(_labelled(post, groups), facts, done, percent)
    discard(held, *tried)
    degree = rest.groupBy("a").agg(F.count("*").alias("deg"))
    links, pairs = _links(rest.join(degree, "a"), texts, percent, "rest")
    groups = _joined(groups, links)
    discard(rest, pairs, links)

    whole = groups if groups is not None else found.select("id", F.col("id").alias("label"))
    least = rows.groupBy("k").agg(F.min("doc_id").alias("least"))
    of = found.select("id", "k", "n").join(least, "k").join(whole, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # the smallest id, nulls last; of the texts that have it the first by key
    top = of.groupBy("label").agg(F.min(F.struct(F.isnull("least").alias("none"), "least", "k")).alias("top"))
    known = stored(of.join(top, "label").select("k", "n", F.col("top.least").alias("component_id"), (F.col("k") == F.col("top.k")).alias("best")), "classes")
    discard(found, groups)
    n = F.coalesce("n", F.lit(0)).cast("long")
    chosen = (n == 0) | F.col("best") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    component = F.when(n == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return built_on(known, rows.select("doc_id", "k").join(known, "k", "left").select("doc_id", n.alias("n_shingles"), component.alias("component_id"), F.col("k").alias("text_key"), chosen.alias("chosen")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: the smallest doc_id (of repeated rows one). Rows without words all stay."""
    found = jaccard_groups(docs, percent, width, id_col, text_col)
    groups = stored(found.select(F.col("doc_id").alias("__nj_id"), F.col("text_key").alias("__nj_k"), "n_shingles", "chosen"), "groups-of-rows")
    discard(found)
    key = F.unhex(F.md5(F.col(text_col).cast("binary")))
    same = F.col(id_col).eqNullSafe(F.col("__nj_id")) & (F.col("__nj_key") == F.col("__nj_k"))
    left = docs.withColumn("__nj_key", key).join(groups.filter("NOT chosen").select("__nj_id", "__nj_k").distinct(), same, "left_anti")
    again = stored(groups.filter("chosen AND n_shingles > 0").groupBy("__nj_id", "__nj_k").agg(F.count("*").alias("c")).filter("c > 1").select("__nj_id", "__nj_k"), "repeated-rows")
    if again.take(1):
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, "__nj_key"]))
    return left.select(*docs.columns)

