"""HTML extraction, secret scans, decontamination and quality."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import decontaminate as dc
from lattica.llm import html_extract as hx
from lattica.llm import quality as ql
from lattica.llm import secret_scan as ss

NOISE = "<nav><ul><li><a href=/a>Home, sweet, home</a></ul></nav><div class='sidebar widget'><p>Buy, now, and save, a lot, of money, today, please.</p></div>"
PARA = "A paragraph of running text, with commas, that goes on for long enough to count as content, and then some more."


def test_article_is_kept_whole():
    html = f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>'</script></head><body>{NOISE}<article><h1>Head &amp; line</h1><p><b>{PARA}<br><p>Second  para\n x&#233;.</p><ul><li>one<li>two</ul></article><div id=comments><p>{PARA}</p></div><footer>&copy; me, you, all</footer></body></html>"
    assert hx.main_text(html) == f"Head & line {PARA} Second para xé. one two"


def test_containers_are_scored():
    html = f"<body>{NOISE}<div><div class=content><p>{PARA}</p><p>{PARA}</p><blockquote>said, he</blockquote></div><p>{PARA} A sibling.</p><div><a href=x>{PARA}</a></div></div><form><p>{PARA}</p></form></body>"
    assert hx.main_text(html) == f"{PARA} {PARA} said, he {PARA} A sibling."


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='site no-sidebar'", "div id='content-with-sidebar'", "div class='page-wrapper sticky-header'", "form", "div role=form", "div class='post has-comments'", "aside"])
def test_wrappers_are_no_boilerplate(wrapper):
    side = f"<div class='sidebar widget'><p>{PARA}</p></div>"
    talk = f"<section id=comments><article class=comment-body><p>{PARA} {PARA} {PARA} {PARA}</p></article></section>"
    end = f"</{wrapper.split()[0]}>"
    for inside, text in ((f"<article><h1>Head</h1><p>{PARA}</p></article>", f"Head {PARA}"), (f"<main><p>{PARA}</p></main>", PARA), (f"<div class=content><p>{PARA}</p><p>{PARA}</p></div>", f"{PARA} {PARA}")):
        assert hx.main_text(f"<body>{NOISE}<{wrapper}>{inside}{side}{end}<footer>me, you</footer></body>") == text
        assert hx.main_text(f"<body>{NOISE}<{wrapper}>{inside}{end}</body>") == text
    for inside in ("<article><p>Brief, but an article.</p></article>", "<main><div class='row no-sidebar'><article><p>Brief, but an article.</p></article></div></main>"):
        assert hx.main_text(f"<body>{NOISE}<{wrapper}>{inside}{side}{end}{talk}</body>") == "Brief, but an article."
    assert hx.main_text(f"<body><{wrapper}><p>{PARA}</p>{end}<{wrapper}><p>{PARA}</p>{end}</body>") == f"{PARA} {PARA}"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<section>A short</section><section>B is {PARA}</section><section>C short</section>", f"A short B is {PARA} C short"),
        (f"<article><p>{PARA}</p></article><article><h2>Next</h2><p>{PARA} 2</p></article>", f"{PARA} Next {PARA} 2"),
        ("<div><p>Hello.</p></div><div><p>World.</p></div>", "Hello. World."),
        (f"Loose text.<div class=content><p>{PARA}</p></div><ul><li>one<li>two</ul><h4>Head</h4><dl><dt>t<dd>d</dl>tail <b>text</b>", f"Loose text. {PARA} one two Head t d tail text"),
        (f"<article><p>{PARA}</p><div class='disclaimer-text'><p>{PARA}</p></div><div class='related-work'><p>{PARA}</p></div><p>x <math><mi>y</mi></math> <object>z</object></p></article>", f"{PARA} {PARA} {PARA} x y z"),
        (f"<article><header><h1>Title</h1></header><div><section><p>{PARA}</p></section><section><p>{PARA}</p></section></div><p>End.</p><div class=related><a href=x>one</a> <a href=y>two</a></div></article>", f"Title {PARA} {PARA} End."),
        (f"<div><ul><li><a href=x>Home page</a><li><a href=x>Other page</a></ul></div><div><div><p>{PARA}</p><p>{PARA}</p></div><p>End.</p></div>", f"{PARA} {PARA} End."),
        ("<article><h1>Few words.</h1></article><footer>me, you, all others, and everybody else, who reads this, at any time</footer>", "Few words."),
        (f"<article><p>{PARA}</p></article><p class=disclaimer>{PARA}</p>", PARA),
    ],
)
def test_nothing_of_the_text_is_lost(html, text):
    assert hx.main_text(html) == hx.main_text(f"<html><body>{html}</body></html>") == text


def page(rnd):
    """A page made of known parts: its html, and what of it is main text."""
    said = []

    def say(n):
        words = " ".join("".join(rnd.choices("aeioulmnrst", k=rnd.randint(2, 9))) + rnd.choice(["", "", "", ","]) for _ in range(n))
        said.append(words)
        return words

    def block(depth=0):
        kind = rnd.choice(["p", "p", "p", "h2", "h4", "ul", "dl", "quote", "text", "table", "div"] if depth < 2 else ["p", "h4", "ul"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{say(rnd.randint(2, 12))}" for _ in range(rnd.randint(1, 4))) + "</ul>"
        if kind == "dl":
            return f"<dl><dt>{say(2)}<dd>{say(9)}</dl>"
        if kind == "quote":
            return f"<blockquote><p>{say(rnd.randint(5, 40))}</p></blockquote>"
        if kind == "table":
            return f"<table><tr><td>{say(3)}</td><td>{say(4)}</td></tr></table>"
        if kind == "div":
            return f"<div class='{rnd.choice(['row', 'x1', 'related-work', 'disclaimer-text'])}'>{''.join(block(depth + 1) for _ in range(rnd.randint(1, 3)))}</div>"
        if kind == "text":
            return f" {say(rnd.randint(3, 20))}<br>"
        return f"<{kind}>{say(rnd.randint(2, 8) if kind[0] == 'h' else rnd.randint(15, 60))}</{kind}>"

    junk = lambda: rnd.choice([NOISE, "<!-- x --><script>var a = '<p>no</p>';</script>", "<div class='ad-slot'>Buy, now!</div>", "<form><p>Your name, please</p><input></form>", "<div class='cookie-banner'><p>We, and others, use cookies.</p></div>"])
    body = lambda: f"<p>{say(40)}</p>" + "".join(block() for _ in range(rnd.randint(1, 6)))
    shape = rnd.choice(["article", "main", "div", "articles", "sections", "bare"])
    if shape == "articles":
        inner = "".join(f"<article>{body()}</article>" for _ in range(rnd.randint(2, 3)))
    elif shape == "sections":
        inner = "<main>" + "".join(f"<section>{body()}{junk() if rnd.random() < 0.3 else ''}</section>" for _ in range(rnd.randint(2, 4))) + "</main>"
    elif shape == "bare":
        inner = f"<div>{body()}</div>"
    else:
        inner = f"<{shape} class=content><h1>{say(5)}</h1>{body()}</{shape}>"
    talk = "<div id=comments><p>I, for one, like it.</p></div>" if rnd.random() < 0.5 else ""
    return f"<html><head><title>t</title></head><body><header><a href=/>Home</a></header>{junk()}{inner}{talk}{junk()}<footer>&copy; me</footer></body></html>", " ".join(said)


def test_generated_pages():
    rnd = random.Random(11)
    for _ in range(400):
        html, text = page(rnd)
        assert hx.main_text(html) == text, html


def test_page_query_gives_the_articles_of_its_table(spark, sf):
    """Brute force: on the given pages, tags taken from what lies between <article> and its end are the main text."""
    import html as entities

    from lattica.llm.queries import QUERIES

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op2_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1]
        text = " ".join(entities.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0].strip("</>").split()[0] in ("b", "i", "em", "a", "span") else " ", inside)).split())
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], text, len(text))


def test_comments_are_left_out_however_long():
    talk = "".join(f"<p>{PARA}</p>" for _ in range(9))
    assert hx.main_text(f"<body><div class=post><p>{PARA}</p></div><div id=comments>{talk}</div></body>") == PARA
    assert hx.main_text("<body><nav><a href=/>Home</a></nav></body>") == ""


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("  ", ""), ("<p>", ""), ("plain words", "plain words"), ("<div>short</div>", "short"), ("<article><p>x</article>", "x"), ("<p>a<p>b<table><tr><td>c<td>d</table>", "a b c d"), ("<!-- <p>no</p> --><p>yes &lt;b&gt;</p>", "yes <b>"), ("<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000, "deep")])
def test_odd_pages(html, text):
    assert hx.main_text(html) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abpdiv \"'=&;!-\n", max_size=80))
def test_any_markup_parses(html):
    assert isinstance(hx.main_text(html), str)


def test_pages(spark):
    long = "word, " * 50000
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, f"<article><p>{long}</p></article>", None), (2, None, "<p>é𝄞</p>", "y")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in hx.extract_main_text(df).collect())
    assert got == sorted([(1, "", 0), (2, long.strip(), len(long) - 1), (2, "é𝄞", 2)])
    assert hx.extract_main_text(df.limit(0)).count() == 0


def spans(text):
    out = []
    for r in ss.BASE_RULES + ss.MORE_RULES:
        out += [(r.kind, m.start(), m.end()) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return sorted(out)


SECRETS = ["password", "PassWd", "apikey", "api_KEY", "token", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "ghp_" + "a1B2" * 9, "xoxb-1234567890ab", "eyJhbGciOi", ".", "-----BEGIN RSA PRIVATE KEY-----", "http://me:pass@host", "é", "K", "ſecret", "\n", "x" * 12]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(SECRETS), max_size=14).map("".join))
def test_scan_equals_plain_regexes(text):
    scan = ss.scanner(tuple(ss._LONG_HEX if r.kind == "hex" else r for r in ss.BASE_RULES + ss.MORE_RULES))
    assert sorted(scan([text, "", text[::-1]])[0]) == spans(text)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["abc(d|ef)?gh+", "(foo|ba[rz])qux", "x{3}yz", "[a-c]de{2,}f", "(ab)+c", "a.b", "^abc$", "(?i:kEy)_\\d+", "ab*cde", "(a|b|)xyz"]), st.text(alphabet="abcdefghxyzfoqurkKeEyY_19", max_size=30))
def test_queries_never_miss(pattern, text):
    query = ss.required(pattern)
    row, lut = ss.lookup(sorted(ss.named(query)))
    if re.search(pattern, text):
        assert ss.Segment([text.encode()], row, lut).find(query)[0]


def test_mandatory_trigrams():
    assert ss.required("AKIA[A-Z0-9]+") == frozenset([b"aki", b"kia"])
    assert ss.required("[0-9a-f]{16,}") is True and ss.required("ab") is True


def test_long_tokens_and_long_texts_in_linear_time():
    import time

    scan = ss.scanner(tuple(ss._LONG_HEX if r.kind == "hex" else r for r in ss.BASE_RULES + ss.MORE_RULES))
    for text, kind in (("ghp_" + "a1" * 2000, "github"), ("xoxb-" + "a1" * 2000, "slack"), ("sk_live_" + "a1" * 2000, "stripe"), ("ftp://" + "u" * 900 + ":" + "p" * 900 + "@h", "url_login")):
        assert (kind, 0, len(text)) in scan([text])[0]
    n = 10 << 20
    for unit in ("eyJ", "eyJaaaaaaaa.", "a", "password ", "token=", "xoxb-", "ghp_", "AKIA", "http://a:", "http://", "-----BEGIN ", "sk_live_", "AIza", "deadbeef", "api_key  "):
        began = time.thread_time()
        scan([unit * (n // len(unit)) + " .eyJ"])
        assert time.thread_time() - began < 12, unit


def plain_scan(text, rules):
    order = [r.kind for r in rules]
    found = [(m.start(), order.index(r.kind), r.kind, m.end()) for r in rules for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def test_secret_query_equals_brute_force(spark, sf):
    import hashlib

    from lattica.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op5_secret_scan"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = plain_scan(texts[r["doc_id"]], ss.BASE_RULES)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in base) for k in ("assign:", "access:", "hex:")]
        assert r["spans"] == ",".join(plain_scan(texts[r["doc_id"]], ss.BASE_RULES + ss.MORE_RULES))


def test_secret_table(spark):
    rows = [(1, "token = abcdefghijkl", "n"), (2, None, None), (3, "", "n"), (3, "x " * 40000 + "AKIA" + "Q" * 16, "n"), (4, "é password:short deadbeefdeadbeef", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = sorted((r["doc_id"], [tuple(s) for s in r["secrets"]]) for r in ss.find_secrets(df, segment_bytes=50).collect())
    assert got == [(1, [("assign", 0, 20)]), (2, []), (3, []), (3, [("access", 80000, 80020)]), (4, [("hex", 17, 33)])]
    assert ss.find_secrets(df.limit(0)).count() == 0


def edits(p, t):
    """Least edit distance of p to a substring of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=30))
def test_myers(p, t):
    found = dc.myers(dc.masks(p), len(p), t, len(p))
    assert (found[0] if found else len(p)) == edits(p, t)


def test_matches_equal_brute_force(spark):
    rnd = random.Random(3)
    item = lambda n: "".join(rnd.choice("abcd efgh") for _ in range(n))
    items = [(i, item(rnd.randint(40, 120))) for i in range(12)] + [(50, "too short"), (51, None)]
    items.append((60, items[0][1].upper()))

    def altered(s, k):
        s = list(s)
        for _ in range(k):
            at = rnd.randrange(len(s))
            s[at : at + 1] = rnd.choice(["", "z", s[at] + "y"])
        return "".join(s)

    docs = [(i, item(60) + altered(items[i % 12][1], rnd.randint(0, 14)) + item(60)) for i in range(60)] + [(100, None), (101, ""), (102, item(50000) + items[3][1] + item(20))]
    expected = set()
    for d, t in docs:
        for i, x in items:
            p = dc.normal(x or "")
            if t and len(p) >= dc.MIN_CHARS and (k := edits(p, dc.normal(t[-400:] if d == 102 else t))) <= int(dc.ERROR_RATE * len(p)):
                expected.add((d, i, k))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (dc.MAX_ITEM_BYTES, 400):
        found = dc.find_items(df, bench, max_item_bytes=most)
        assert {(r["doc_id"], m["item_id"], m["distance"]) for r in found.collect() for m in r["matches"]} == expected
        assert found.count() == len(docs)
    assert len(expected) > 20
    assert all(not r["matches"] for r in dc.find_items(df, bench.limit(0)).collect())
    assert dc.find_items(df.limit(0), bench).count() == 0


def test_clashing_columns_equal_items_and_chunks(spark):
    text = "the quick brown fox jumps over the lazy dog, and then some"
    items = spark.createDataFrame([(7, text), (7, text), (3, text.upper()), (None, text), (4, "something else that nobody has said at all")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"so {text}.", "x", 9), (2, None, None, None), (2, None, None, None)], "doc_id long, text string, matches string, item_id int")
    for most in (dc.MAX_ITEM_BYTES, 60):  # one chunk, several
        out = dc.find_items(df, items, max_item_bytes=most)
        assert out.columns == ["doc_id", "text", "item_id", "matches"]
        assert sorted((r["doc_id"], [tuple(m) for m in r["matches"]]) for r in out.collect()) == [(1, [(None, 0, 61), (3, 0, 61), (7, 0, 61), (7, 0, 61)]), (2, []), (2, [])]


def test_a_worker_builds_a_matcher_once():
    dc._matchers.clear()
    items = [(1, "x" * 40)]
    a = dc.matcher_of("k", items, 0.08, 32)
    assert dc.matcher_of("k", items, 0.08, 32) is a and dc.matcher_of("k", items, 0.1, 32) is not a
    for i in range(9):
        dc.matcher_of(str(i), items, 0.08, 32)
    assert len(dc._matchers) == dc.MOST_MATCHERS


def test_decontamination_query_equals_brute_force(spark, tmp_path):
    from lattica.llm.queries import QUERIES

    rnd = random.Random(21)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, say(rnd.randint(2, 12))) for i in range(10)]
    docs = []
    for i in range(40):
        t = items[i % 10][1]
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(t))
            t = t[:at] + rnd.choice("xyz ") + t[at + rnd.randint(0, 1) :]
        docs.append((i, f"{say(8)} {t} {say(8)}".title()))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for d, t in docs:
        for i, x in items:
            p, text = dc.normal(x), dc.normal(t)
            if len(p) < dc.MIN_CHARS:
                if f" {p} " in f" {text} ":
                    want.add((d, i, 0))
            elif (k := edits(p, text)) <= int(dc.ERROR_RATE * len(p)):
                want.add((d, i, k))
    got = QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want) > 15


def test_short_items_match_whole(spark):
    items = spark.createDataFrame([(1, "What  is pi?"), (2, "art"), (3, " "), (4, "x" * 40)], "item_id long, text string")
    texts = ["So: what is\nPI? Tell.", "what is pie?", "what iss pi?", "partly smart", "smart Art, it is", "art", "(what is pi?)art"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in dc.find_items(df, items).collect()}
    assert got == {0: [(1, 0, 15)], 1: [], 2: [], 3: [], 4: [(2, 0, 9)], 5: [(2, 0, 3)], 6: [(1, 0, 12), (2, 0, 16)]}


def test_shapes():
    assert ql.shape(b"the&&&") == ql.shape(b"and&&&") != ql.shape(b"the,")
    assert len({ql.shape(w) for w in (b"THE!!", b"The", b"the", b"|", b"42", b"a1b", "été".encode(), "ÉTÉ".encode())}) == 7


def test_quality(spark):
    rnd = random.Random(0)
    words = ["".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(2, 9))) for _ in range(800)]
    good = lambda: " ".join(rnd.choices(words, k=rnd.randint(5, 200))).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rnd.choices(words, k=rnd.randint(5, 200))) if rnd.random() < 0.5 else " ".join(rnd.choice(words) * 1 + "%%%" for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), "x") for i in range(1200)] + [(5000, None, "x"), (5001, "", "x"), (5002, "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(900)] + [(3, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    held_out = F.col("doc_id") % 3 == 0
    out = {r["doc_id"]: r for r in ql.classify(df, labels, held_out).collect()}
    assert len(out) == 1203 and all(0 <= r["score"] <= 1 for r in out.values())
    truth = [(out[i]["score"], i % 4 > 0) for i in range(1200) if i % 3 == 0]
    assert np.mean([(s >= 0.7) == y for s, y in truth]) > 0.98
    assert out[5000]["score"] == out[5001]["score"]
    again = {r["doc_id"]: r["score"] for r in ql.classify(df.repartition(5), labels.repartition(3), held_out).collect()}
    assert all(abs(again[i] - out[i]["score"]) < 1e-9 for i in out)
    one = ql.classify(df, labels.filter("quality = 1"), held_out)
    assert {r["score"] for r in one.collect()} == {1.0}
    assert {r["score"] for r in ql.classify(df, labels.limit(0), held_out).collect()} == {0.5}
    assert ql.classify(df.limit(0), labels, held_out).count() == 0


def test_long_labelled_texts_teach(spark):
    good, bad = "calm words in order, said well. " * 4000, "%%% $$$ !!! ### " * 9000
    rows = [(i, (good if i % 2 else bad)[: 90_000 + 64 * i]) for i in range(60)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = ql.fit(df, labels, part_bytes=1 << 18)
    assert model.network.constant is None  # every text has over 64 KB
    scores = {r["doc_id"]: r["score"] for r in ql.score_quality(df, model).collect()}
    assert all((s > 0.5) == i % 2 for i, s in scores.items())


def test_clashing_columns_and_repeats_of_the_classifier(spark):
    df = spark.createDataFrame([(i // 2, "good words" if i % 4 < 2 else "BAD!!!", 1, "x", "y") for i in range(40)], "doc_id long, text string, predicted int, held_out string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id long, quality int")
    out = ql.classify(df, labels, F.col("doc_id") % 5 == 0)
    assert sorted(out.columns) == sorted(df.columns) and dict(out.dtypes)["held_out"] == "boolean" and dict(out.dtypes)["score"] == "double"
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    assert len(by) == 20 and all(len(x) == 1 for x in by.values())


def test_quality_query_on_held_out_labels(spark, sf):
    import zlib

    from lattica.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 6))
    p = ql.sigmoid(1.5 * x[:, 0])
    y = (rng.random(1500) < p).astype(float)
    got = ql.Network(x, y).probability(x)
    assert abs(got.mean() - y.mean()) < 0.06
    for a, b in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0)):
        at = (got >= a) & (got < b)
        assert abs(got[at].mean() - y[at].mean()) < 0.12
