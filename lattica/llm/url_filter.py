"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a site rule (host and path prefix; the longest that fits decides) or a pattern in the usual filter syntax
(`||host^`, `|` anchors, `*`, `^` separators; blocks unless an allow pattern fits too). From every rule the literal
tokens are taken that each matching URL must hold as whole tokens ([a-z0-9] runs); of these the one rarest in the URLs
at hand becomes the rule's key. A URL's own tokens then fetch the few candidate rules, and only those run their
regular expression.

All of it is DataFrame functions. While the index is at most MAX_INDEX_BYTES it is one constant, an array of hash
buckets, so a lookup is O(1) a token and the filter is a map without any shuffle; larger rule sets are joined by token.

Cases: a null url or one without "://" has empty host and path, no site rule, and verdict allow; long urls are judged
whole; of site rules that fit, the longest decides, of equally long ones the last by their text, then one that blocks;
repeated rows are judged one by one; empty tables give empty results; other columns pass through, but those named host, path,
rule or verdict, which are replaced.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_rows

MAX_INDEX_BYTES = 4 << 20
_ENTRY = "struct<token:string,regex:string,site:boolean,block:boolean,rule:string>"


@dataclass(frozen=True)
class Rule:
    rule: str
    block: bool
    site: bool
    regex: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str = "") -> Rule:
    """Fits host and all its subdomains, if the path starts with path. The regular expression runs on host + path."""
    whole = re.findall(r"[a-z0-9]+", host)
    cut = path.lower().rfind("/")  # a last piece that isn't closed may go on in the URL
    at = [m[0] for m in re.finditer(r"[a-z0-9]+", path.lower()) if m.end() <= cut]
    return Rule(host + path, verdict == "block", True, rf"(?s)^(?:[^/]*\.)?{_quote(host)}{_quote(path) if path.startswith('/') else '(?:/|$)'}", tuple(whole + at))


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", s)


def pattern_rule(text: str) -> Rule:
    """`||` starts at a host label, `|` at either end of the URL, `*` is any text, `^` a separator or the end; `@@` allows."""
    block, body = not text.startswith("@@"), text.removeprefix("@@").lower()
    regex, rest = "(?s)", body
    if rest.startswith("||"):
        regex, rest = regex + r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", rest[2:]
    elif rest.startswith("|"):
        regex, rest = regex + "^", rest[1:]
    end = rest.endswith("|")
    rest = rest.removesuffix("|")
    for piece in re.findall(r"\*|\^|[^*^]+", rest):
        regex += {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(piece) or _quote(piece)
    anchored = body.startswith("|")
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", rest):
        before = rest[m.start() - 1] if m.start() else ("|" if anchored else "*")
        after = rest[m.end()] if m.end() < len(rest) else ("|" if end else "*")
        if "*" not in (before, after):  # else the URL's token may be longer
            tokens.append(m[0])
    return Rule(text, block, False, regex + ("$" if end else ""), tuple(tokens))


def rules_of(table: DataFrame, text_col: str = "rule", limit: int = 1_000_000) -> tuple[Rule, ...]:
    """The rules of a table of texts, one a row: `block host/path` and `allow host/path` are site rules, others patterns;
    empty ones and those that begin with ! are skipped, equal ones count once. More than limit rows are an error, for rules
    are compiled on the driver."""
    texts = sorted({(r[0] or "").strip() for r in bounded_rows(table.select(text_col), limit, "rules")})
    out = []
    for text in texts:
        site = re.fullmatch(r"(block|allow)\s+([^/\s]+)(/\S*)?", text)
        if site:
            out.append(site_rule(site[1], site[2].lower(), site[3] or ""))
        elif text and not text.startswith("!"):
            out.append(pattern_rule(text))
    return tuple(out)


#: The site rules of the query, then patterns against the usual spam and tracking hosts.
SITE_RULES = (
    site_rule("block", "com", "/en/"),
    site_rule("allow", "example.com", "/en/7"),
    site_rule("allow", "net", "/de/"),
    site_rule("block", "example.net", "/de/8"),
    site_rule("block", "org", "/es/"),
)
PATTERN_RULES = tuple(
    map(
        pattern_rule,
        (
            "||cheap-pills.",
            "||free-bets.",
            "||casino-win.",
            "||ads-track.",
            "||spam-farm.",
            "||adult-x.",
            "||doubleclick.",
            "||adserver.",
            "/banner-ads/",
            "/wp-login.php^",
            "/phishing/",
            "?affid=",
            "@@||example.org^*/about/",
        ),
    )
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end; A-Z lower-cased) and path (then up to ? # or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each token of the rules stands. As many rows as the rules have tokens at most."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    t = F.explode(F.array_intersect(_tokens(F.col(url_col)), F.lit(wanted)))
    return {r["t"]: r["n"] for r in urls.select(t.alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def rule_keys(rules: tuple[Rule, ...], counts: dict[str, int]) -> list[tuple[str | None, Rule]]:
    """Each rule with its rarest token (ties: the longer, then the smaller), None if it has no sure token."""
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None), r) for r in rules]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, url_col: str = "url", counts: dict[str, int] | None = None, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """pages with host, path, rule (the site rule that decided, else null) and verdict added.

    counts: how often tokens stand in URLs, by default counted here; they only steer the choice of keys.
    """
    keys = rule_keys(rules, token_counts(pages, rules, url_col) if counts is None else counts)
    entries = [{"token": t, "regex": r.regex, "site": r.site, "block": r.block, "rule": r.rule} for t, r in keys]
    if len(json.dumps(entries)) > max_index_bytes:
        return _by_join(pages, entries, url_col)
    return _judged(pages, _fetched(entries, F.col(url_col)), url_col)


def _fetched(entries: list[dict], url: Column) -> Column:
    """The candidate rules of a URL, from an index in one constant."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    keyed = [e for e in entries if e["token"]]
    size = 1 << max(4, (2 * len(keyed)).bit_length())
    tokens = sorted({e["token"] for e in keyed})
    # Spark's own hash of each token, so that both sides agree
    at = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(size)).alias("h")).collect()} if tokens else {}
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for e in keyed:
        buckets[at[e["token"]]].append(e)
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_ENTRY}>>")
    always = F.from_json(F.lit(json.dumps([e for e in entries if not e["token"]])), f"array<{_ENTRY}>")
    found = F.transform(_tokens(url), lambda t: F.filter(F.element_at(index, (F.pmod(F.xxhash64(t), F.lit(size)) + 1).cast("int")), lambda r: r["token"] == t))
    return F.concat(F.flatten(found), always)


def _fits(r: Column, site: Column, url: Column) -> Column:
    return F.when(r["site"], F.rlike(site, r["regex"])).otherwise(F.rlike(url, r["regex"]))


def _judged(pages: DataFrame, candidates: Column, url_col: str) -> DataFrame:
    host, path = split_url(F.col(url_col))
    site, url = F.concat(host, path), ascii_lower(F.coalesce(F.col(url_col), F.lit("")))
    hits = F.filter(candidates, lambda r: _fits(r, site, url))
    return _decided(pages.withColumns({"__uf_host": host, "__uf_path": path, "__uf_hits": hits}))


def _decided(df: DataFrame) -> DataFrame:
    hits = F.col("__uf_hits")
    best = F.array_max(F.transform(F.filter(hits, lambda r: r["site"]), lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["block"].alias("block"))))
    pattern = F.exists(hits, lambda r: ~r["site"] & r["block"]) & ~F.exists(hits, lambda r: ~r["site"] & ~r["block"])
    # a URL of no form has no host for a pattern to anchor to and fits no site rule
    blocked = F.coalesce(best["block"], pattern, F.lit(False))
    keep = [c for c in df.columns if not c.startswith("__uf_") and c not in ("host", "path", "rule", "verdict")]
    return df.select(*keep, F.col("__uf_host").alias("host"), F.col("__uf_path").alias("path"), best["rule"].alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def _by_join(pages: DataFrame, entries: list[dict], url_col: str) -> DataFrame:
    """The same for rule sets too large for a constant: distinct URLs meet the rule table by token."""
    spark = pages.sparkSession
    rules = spark.createDataFrame([tuple(e.values()) for e in entries], "token string, regex string, site boolean, block boolean, rule string")
    u = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(u.alias("__uf_url")).distinct()
    host, path = split_url(F.col("__uf_url"))
    asked = urls.select("__uf_url", F.concat(host, path).alias("__uf_site"), F.explode(F.concat(_tokens(F.col("__uf_url")), F.array(F.lit("*")))).alias("token"))
    found = asked.join(rules.withColumn("token", F.coalesce("token", F.lit("*"))), "token")
    r = F.struct("token", "regex", "site", "block", "rule")
    hits = found.filter(_fits(r, F.col("__uf_site"), ascii_lower(F.col("__uf_url")))).groupBy("__uf_url").agg(F.collect_set(F.struct("token", "site", "block", "rule")).alias("__uf_hits"))
    joined = pages.withColumn("__uf_url", u).join(hits, "__uf_url", "left")
    host, path = split_url(F.col("__uf_url"))
    empty = F.from_json(F.lit("[]"), "array<struct<token:string,site:boolean,block:boolean,rule:string>>")
    return _decided(joined.withColumns({"__uf_host": host, "__uf_path": path, "__uf_hits": F.coalesce("__uf_hits", empty)}))
