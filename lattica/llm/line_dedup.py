"""Line deduplication by distinct-site spread.

Every line gets a HyperLogLog sketch of the sites (sources) that hold it; the sketches of a line hash merge by partial
and final aggregation, so a hot line moves one sketch a task. Lines whose estimate lies well over min_sites are
boilerplate, well under are not; those within five standard errors get an exact distinct count first. Of a boilerplate
line only its first occurrence in the corpus (smallest document, then position) stays.

All of it is DataFrame functions. Lines are compared trimmed, by 64-bit hash and length; blank lines are left alone, and
those under min_chars if that is more than one. Where all occurrences of a line meet what is known of it, the frequent lines
(HOT at most, for each has that share of the occurrences) are sent to the tasks, so no task gets a hot line's occurrences.

Cases: a null text stays null, an empty one empty; a null site counts as one site named ""; repeated rows (same id, site
and text) count as one document and get the same result; of occurrences the first by id, then by hash of site and text, then
by position stays; a document of boilerplate only gets an empty text; long texts are split whole, their lines to rows; empty
tables give empty results; other columns pass through unread, but one named n_removed, which is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built_on, discard, stored

#: A line on so many sites is boilerplate; log2 of the sketch's registers.
MIN_SITES = 5
LG_K = 12
HOT = 1000
#: Occurrences that need no join are dealt to so many keys.
SPREAD = 1024


def _keyed(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("__ld_id"), F.xxhash64(site, F.coalesce(F.col(text_col), F.lit(""))).alias("__ld_key"), site.alias("__ld_site"), F.col(text_col).alias("__ld_text"))


def _lines(keyed: DataFrame, min_chars: int) -> DataFrame:
    at = keyed.select("__ld_id", "__ld_key", "__ld_site", F.posexplode(F.split("__ld_text", "\n")).alias("__ld_pos", "__ld_line")).withColumn("__ld_line", F.trim("__ld_line"))
    at = at.filter(F.length("__ld_line") >= max(1, min_chars))
    return at.select("__ld_id", "__ld_key", "__ld_site", "__ld_pos", F.xxhash64("__ld_line").alias("__ld_h"), F.length("__ld_line").alias("__ld_len"))


def _known(lines: DataFrame, few: DataFrame, total: int, value: str) -> DataFrame:
    """The lines that few (__ld_h, __ld_len, copies, value) has, with its value, never null. total: copies of all of few."""
    hot = F.col("copies") * HOT >= total
    key = ["__ld_h", "__ld_len"]
    sent = few.filter(hot).select(*key, F.col(value).alias("__ld_hot"))
    rare = few.filter(~hot).select(*key, F.lit(0).alias("__ld_z"), F.col(value).alias("__ld_rare"))
    spread = F.pmod(F.xxhash64("__ld_key", "__ld_pos"), F.lit(SPREAD)).cast("int") + 1
    both = lines.join(F.broadcast(sent), key, "left").withColumn("__ld_z", F.when(F.col("__ld_hot").isNotNull(), spread).otherwise(F.lit(0)))
    found = both.join(rare, [*key, "__ld_z"], "left").withColumn(value, F.coalesce("__ld_hot", "__ld_rare"))
    return found.filter(F.col(value).isNotNull()).drop("__ld_hot", "__ld_rare", "__ld_z")


def line_spread(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The boilerplate lines: __ld_h, __ld_len (hash and length), sites (distinct, exact where near min_sites, else
    estimated), copies, and __ld_first, the occurrence that stays."""
    lines = _lines(_keyed(docs, id_col, text_col, site_col), min_chars)
    width = 5 * 1.04 / math.sqrt(1 << lg_k) * min_sites
    # the sketch skips empty strings, so it gets their hash
    spread = lines.groupBy("__ld_h", "__ld_len").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("__ld_site"), F.lit(lg_k))).alias("est"),
        F.count("*").alias("copies"),
        F.min(F.struct("__ld_id", "__ld_key", "__ld_pos")).alias("__ld_first"),
    )
    # a line needs that many occurrences before its sketch matters; written once, for it is read twice
    likely = stored(spread.filter((F.col("copies") >= min_sites) & (F.col("est") > min_sites - width)), "line-spread")
    near = likely.filter(F.col("est") <= min_sites + width).select("__ld_h", "__ld_len", "copies", F.lit(True).alias("__ld_near"))
    total = near.agg(F.sum("copies")).first()[0] or 0
    exact = _known(lines, near, total, "__ld_near").select("__ld_h", "__ld_len", "__ld_site").distinct().groupBy("__ld_h", "__ld_len").agg(F.count("*").alias("exact"))
    sites = F.coalesce("exact", F.greatest(F.col("est"), F.lit(0)).cast("long"))
    return built_on(likely, likely.join(exact, ["__ld_h", "__ld_len"], "left").withColumn("sites", sites).filter(F.col("sites") >= min_sites).select("__ld_h", "__ld_len", "sites", "copies", "__ld_first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with the text free of cross-site boilerplate, and n_removed, the lines taken from each."""
    spread = line_spread(docs, min_sites, lg_k, min_chars, id_col, text_col, site_col)
    bad = stored(spread.select("__ld_h", "__ld_len", "copies", "__ld_first"), "boilerplate")
    discard(spread)
    total = bad.agg(F.sum("copies")).first()[0] or 0
    keyed = _keyed(docs, id_col, text_col, site_col)
    me = F.struct("__ld_id", "__ld_key", "__ld_pos")
    gone = _known(_lines(keyed, min_chars), bad, total, "__ld_first").filter(~me.eqNullSafe(F.col("__ld_first")))
    gone = gone.groupBy("__ld_id", "__ld_key").agg(F.collect_set("__ld_pos").alias("__ld_gone"))
    gone = gone.select(F.col("__ld_id").alias("__ld_id2"), F.col("__ld_key").alias("__ld_key2"), "__ld_gone")
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    full = docs.withColumn("__ld_key", F.xxhash64(site, F.coalesce(F.col(text_col), F.lit(""))))
    full = full.join(gone, F.col("__ld_key").eqNullSafe(F.col("__ld_key2")) & full[id_col].eqNullSafe(F.col("__ld_id2")), "left")
    at = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.transform(F.filter(at, lambda s: ~F.array_contains("__ld_gone", s["i"])), lambda s: s["x"])
    text = F.when(F.col("__ld_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    names = [c for c in docs.columns if c != "n_removed"]
    return built_on(bad, full.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], F.coalesce(F.size("__ld_gone"), F.lit(0)).alias("n_removed")))
