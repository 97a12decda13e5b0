"""URL filter, line dedup and mixing: DataFrame functions against definitions."""

import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import line_dedup, mixing, url_filter

URLS = [None, "", "nonsense", "http://", "https://A.Example.COM/en/7?q=1", "http://example.com/en/6", "http://example.com.evil.org/es/", "http://x.org/es/1#a", "http://net/de/1", "http://a.example.net/de/81", "http://example.net/de/7", "http://www.cheap-pills.example.com/fr/1", "http://not-cheap-pillsx.com/", "http://h.test/x?affid=3", "http://example.org/p/about/banner-ads/", "http://u.test/a\nb://c", "http://example.com" + "/a" * 30000]


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def expected_site(host, path):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    for i, u in enumerate(URLS):
        host, path = host_path(u)
        rule, verdict = expected_site(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == verdict
    assert {i for i in got if got[i]["rule"] is None and got[i]["verdict"] == "block"} == {11, 13}
    joined = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, max_index_bytes=0).collect()}
    assert joined == {i: (r["rule"], r["verdict"]) for i, r in got.items()}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_rule_keys():
    rules = (url_filter.pattern_rule("||rare.common^"), url_filter.pattern_rule("*ab*"), url_filter.pattern_rule("|http://x/|"))
    keys = {r.rule: t for t, r in url_filter.rule_keys(rules, {"common": 9, "rare": 1, "http": 9, "x": 5})}
    assert keys == {"||rare.common^": "rare", "*ab*": None, "|http://x/|": "x"}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("block org/es/",), ("allow Example.org/es/9",), ("! a remark",), ("||spam-farm.",), ("||spam-farm.",), (None,), ("",)], "rule string")
    rules = url_filter.rules_of(table)
    assert len(rules) == 3
    urls = ["http://a.org/es/1", "http://a.example.org/es/99", "http://x.spam-farm.net/", "http://x.net/"]
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string, other string")
    out = url_filter.filter_urls(df, rules)
    assert sorted(out.columns) == ["host", "other", "page_id", "path", "rule", "url", "verdict"]
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in out.collect())
    assert got == sorted([(0, "org/es/", "block"), (1, "example.org/es/9", "allow"), (2, None, "block"), (3, None, "allow")] * 2, key=str)
    with pytest.raises(ValueError):
        url_filter.rules_of(table, limit=3)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed string")


def test_lines(spark):
    rows = [(i, f"Shared by everyone here.\nOwn line number {i} here.\n\nshort", f"s{i}", "extra") for i in range(6)]
    rows += [(10, None, "s1", None), (11, "", None, None), (12, "Shared by everyone here.", None, None), (12, "Shared by everyone here.", None, None)]
    rows += [(20 + i, "On one site only, many times.", "s1", None) for i in range(9)]
    rows += [(40, "  Shared by everyone here. \nkeep me please now", "s0", None)]
    rows += [(50, "\n".join(["Shared by everyone here."] * 3000 + ["a last line stays"]), "s3", None)]
    out = {}
    for r in line_dedup.dedup_lines(docs(spark, rows), min_chars=10).collect():
        out.setdefault(r["doc_id"], []).append((r["text"], r["n_removed"]))
    assert out[0] == [(rows[0][1], 0)]  # the first occurrence stays
    assert all(out[i] == [(f"Own line number {i} here.\n\nshort", 1)] for i in range(1, 6))
    assert out[10] == [(None, 0)] and out[11] == [("", 0)] and out[12] == [("", 1), ("", 1)]
    assert all(out[20 + i] == [("On one site only, many times.", 0)] for i in range(9))
    assert out[40] == [("keep me please now", 1)] and out[50] == [("a last line stays", 3000)]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    spread = line_dedup.line_spread(docs(spark, rows), min_sites=2, min_chars=10).collect()
    assert [r["sites"] for r in spread] == [7]


def test_short_lines_are_counted(spark):
    rows = [(i, f"Les.\nText number {i} of its own.\n \nX", f"s{i}", None) for i in range(6)] + [(9, "Les.", None, "clash")]
    out = line_dedup.dedup_lines(docs(spark, rows))
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()} == {0: (rows[0][1], 0), **{i: (f"Text number {i} of its own.\n ", 2) for i in range(1, 6)}, 9: ("", 1)}


def test_near_threshold_counts_are_exact(spark):
    rows = [(100 * n + i, f"This line stands on {n} sites.", f"s{i}", None) for n in range(1, 40) for i in range(n)]
    got = line_dedup.line_spread(docs(spark, rows), min_sites=20, lg_k=4)  # a coarse sketch
    assert got.count() == 20 and {r["copies"] for r in got.collect()} == set(range(20, 40))


def spark_hash(*values, seed=42):
    """xxhash64() of Spark: strings, ("int", n) or longs in turn."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def drawn(rows, entropy_ratio, max_repetition, budget=None, block_tokens=1 << 20, seed=17, range_rows=2000):
    """The mixture by its definition, of rows (id, text, source): (id, tokens, epoch, block, slot), sorted."""
    count = {i: len((t or "").encode().split()) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total.setdefault(s, [0, 0])
        total[s][0] += count[i]
        total[s][1] += 1
    whole = sum(t for t, _ in total.values())
    budget = budget or whole
    # the least exponent that keeps both limits, by a fine grid around the bisected one
    shares = lambda a: {s: (t / whole) ** a / sum((u / whole) ** a for u, _ in total.values() if u) for s, (t, _) in total.items() if t}
    n = sum(t > 0 for t, _ in total.values())

    def fine(a):
        w = shares(a)
        flat = entropy_ratio is None or -sum(x * math.log(x) for x in w.values()) <= entropy_ratio * math.log(n) + 1e-12
        return flat and (max_repetition is None or all(budget * x <= max_repetition * total[s][0] * (1 + 1e-12) for s, x in w.items()))

    a = 0.0 if n < 2 or fine(0.0) else next((k / 4096 for k in range(1, 4096) if fine(k / 4096)), 1.0)
    if 0 < a < 1:
        low = a - 1 / 4096
        for _ in range(60):
            mid = (low + a) / 2
            low, a = (low, mid) if fine(mid) else (mid, a)
    given = {s: x * budget for s, x in shares(a).items()}
    blocks = max(1, math.ceil(budget / block_tokens))
    out = []
    for s, b in given.items():
        tokens, size = total[s]
        ranges = max(1, 1 << math.ceil(math.log2(max(1, size / range_rows))))
        for epoch in range(math.ceil(b / tokens - 1e-12)):
            order = []
            for i, t, source in rows:
                if source == s:
                    h = spark_hash(t or "")
                    u = spark_hash(("int", seed), ("int", epoch), str(i), h)
                    order.append((math.floor(((u & (1 << 64) - 1) >> 11) * 2.0**-53 * ranges), u, i, h, count[i]))
            place = epoch * tokens
            for _, u, i, _, c in sorted(order):
                if place < b:
                    out.append((i, c, epoch, min(math.floor(place / b * blocks), blocks - 1), spark_hash(("int", seed + 1), u)))
                place += c
    return sorted(out)


@pytest.mark.parametrize("limits", [{"entropy_ratio": 0.95, "max_repetition": 2.0}, {"entropy_ratio": 0.6, "max_repetition": None}, {"entropy_ratio": None, "max_repetition": 1.3}, {"entropy_ratio": 0.8, "max_repetition": 3.0, "budget": 5000}])
def test_mixture_equals_brute_force(spark, limits):
    rows = [(i, " ".join(["w", "é"] * (1 + i % 5)) if i % 17 else "", "hot" if i % 3 else f"s{i % 12}") for i in range(600)]
    rows.append((7000, "long " * 30000, "s3"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, **limits, block_tokens=700, range_rows=40).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["epoch"], r["block"], r["slot"]) for r in got) == drawn(rows, **limits, block_tokens=700, range_rows=40)


def test_mixture_query_equals_brute_force(spark, sf):
    from lattica.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op1_mixture"](spark, sf)
    assert got.columns == ["doc_id", "source", "n_tokens", "epoch", "block", "slot"]
    assert sorted((r["doc_id"], r["n_tokens"], r["epoch"], r["block"], r["slot"]) for r in got.collect()) == drawn(rows, 0.95, 2.0)


def test_exponent():
    tokens = [900, 50, 50]
    assert mixing.solve_exponent(tokens, 1000, None, None) == 0
    a = mixing.solve_exponent(tokens, 1000, None, 2.0)
    w = mixing.tempered(tokens, a)
    assert max(1000 * x / t for x, t in zip(w, tokens)) == pytest.approx(2.0)
    a = mixing.solve_exponent(tokens, 1000, 0.8, None)
    assert mixing.entropy(mixing.tempered(tokens, a)) == pytest.approx(0.8 * math.log(3))
    assert mixing.solve_exponent([5], 5, 0.5, 1.0) == 0 and mixing.tempered([5, 0], 0.5) == [1.0, 0.0]


def test_many_sources_are_planned_as_a_table(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), None if i % 50 == 7 else "hot" if i % 3 else f"s{i % 90}") for i in range(2000)] + [(9000, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r["doc_id"], r["source"] or "", r["epoch"], r["block"], r["slot"])
    for limits in ({"entropy_ratio": 0.8}, {"entropy_ratio": None, "max_repetition": 1.5}, {"budget": 9000, "entropy_ratio": 0.7}):
        few, many = (mixing.mix_sources(df, **limits, block_tokens=1000, range_rows=50, max_sources=n).collect() for n in (1000, 3))
        assert len(few) > 1500 and sorted(map(key, few)) == sorted(map(key, many))
    assert mixing.mix_sources(df.filter("text = ''").union(df.selectExpr("doc_id", "''", "source")), max_sources=3).count() == 0


def test_limits_that_cannot_be_met_are_reported(spark):
    flat = mixing.plan_mixture([("a", 100, 1), ("b", 101, 1), ("c", 99, 1)], None, 0.95, 2.0)
    assert flat.exponent == 1 and len(flat.unmet) == 1 and "entropy" in flat.unmet[0]
    assert "drawn 3.0000 times" in mixing.plan_mixture([("a", 900, 1), ("b", 100, 1)], 3000, None, 2.0).unmet[0]
    assert mixing.plan_mixture([("a", 900, 1), ("b", 50, 1), ("c", 50, 1)], None, 0.8, None).unmet == ()
    assert mixing.plan_mixture([("a", 5, 1)], None, 0.5, 1.0).unmet == () == mixing.plan_mixture([("a", 0, 1)], None, 0.5, 1.0).unmet
    df = spark.createDataFrame([(i, "a b c", f"s{i % 4}") for i in range(40)], "doc_id long, text string, source string")
    with pytest.warns(UserWarning, match="mixture: the entropy is 1.0000"):
        assert mixing.mix_sources(df).count() == 40


def test_mixture(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "hot" if i % 3 else f"s{i % 12}") for i in range(3000)] + [(None, "a b", None), (None, None, "hot"), (9000, "", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df, entropy_ratio=None, max_repetition=1.5, block_tokens=1000, range_rows=50).collect()
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    mix = mixing.plan_mixture([(s, t, 1) for s, t in tokens.items()], None, None, 1.5)
    for s, t, _, _, budget in mix.sources:
        mine = [r for r in out if r["source"] == s]
        drawn = sum(r["n_tokens"] for r in mine)
        assert budget <= drawn + 1e-6 and drawn - budget < 7 + 1e-6  # the last document may reach over
        whole = int(budget / t + 1e-9)
        assert sum(1 for r in mine if r["epoch"] < whole and r["n_tokens"]) == whole * sum(1 for x in rows if x[2] == s and x[1])
        keys = [(r["doc_id"], r["text"], r["epoch"]) for r in mine if r["n_tokens"]]
        assert len(keys) == len(set(keys))  # once an epoch
        blocks = {}
        for r in mine:
            blocks[r["block"]] = blocks.get(r["block"], 0) + r["n_tokens"]
        n_blocks = math.ceil(mix.budget / 1000)
        assert all(abs(x - budget / n_blocks) <= 14 for x in blocks.values())
    again = mixing.mix_sources(df.repartition(7), entropy_ratio=None, max_repetition=1.5, block_tokens=1000, range_rows=50).collect()
    key = lambda r: (r["doc_id"] or -1, r["source"] or "", r["epoch"], r["block"], r["slot"])
    assert sorted(map(key, out)) == sorted(map(key, again))  # however the rows are dealt
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(df.filter("text IS NULL")).count() == 0
    assert mixing.mix_sources(df.withColumn("epoch", F.lit("x"))).schema["epoch"].dataType.simpleString() == "int"
