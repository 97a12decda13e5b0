"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last adds the
mixture's). run() writes what a stage returns as Parquet to the shared folder and reads it again for the next.

It needs lattica.llm and cannot be imported without it.

Every stage takes null ids, texts, languages, sources and sizes, empty and very long texts, repeated rows and empty tables
(which stay empty); columns beside those of documents pass through all stages, unless they are named as what the last one
adds: those are replaced. What happens to odd rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import built_on, crc_mod, discard, stored, table
from lattica.llm.decontaminate import find_items
from lattica.llm.line_dedup import dedup_lines
from lattica.llm.mixing import mix_sources
from lattica.llm.ngram_join import one_of_each
from lattica.llm.quality import classify


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged as texts without words; repeated rows and
    texts get one verdict; a score equal to the threshold keeps; long texts are read whole; an empty table of labels
    teaches a score of 0.5, which rejects all."""
    clash = [c for c in docs.columns if c in ("held_out", "score", "predicted")]
    kept = docs.withColumnsRenamed({c: f"__cp_{c}" for c in clash})
    scored = classify(kept, table(spark, sf_dir, "labels"), held_out=crc_mod(F.col("doc_id"), 4) == 2)
    return scored.filter("predicted = 1").select(*[F.col(f"__cp_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines of any length go, but for their first occurrence (by doc_id, then position); so do
    documents that had no other text. n_chars is counted again. Null and empty texts stay as they are, a null source is a
    site of its own; repeated rows lose the same lines; lines of long texts are counted like others."""
    clash = "n_removed" in docs.columns
    found = dedup_lines(docs.withColumnRenamed("n_removed", "__cp_n_removed"))
    clean = found.filter("n_removed = 0 OR trim(text) <> ''")
    own = lambda c: F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("__cp_n_removed").alias(c) if clash and c == "n_removed" else F.col(c)
    return built_on(found, clean.select(*[own(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays (one of its repeated rows; of two
    texts with that id the first by MD5). Documents without words are in no group and all stay; one with a null doc_id
    stays only if its group has no other id. Long texts are compared whole."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows all of them. Null and empty texts and items match nothing; long
    texts are searched whole; an empty benchmark takes nothing."""
    clash = "matches" in docs.columns
    found = find_items(docs.withColumnRenamed("matches", "__cp_matches"), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("matches") == 0).select(*[F.col("__cp_matches").alias(c) if clash and c == "matches" else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the mixture's weights: the columns of documents with n_tokens, epoch, block and slot. A null
    source is one like others; documents without words have no tokens, and are drawn with those around them; repeated
    rows are drawn like others; a long text is drawn whole, over its source's budget if it is the last; a corpus without
    words gives an empty result."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: The classifier has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        before, found = docs, stage(spark, docs, sf_dir)
        docs = stored(found, f"stage-{number + 1}")
        discard(found, before)
    return docs
