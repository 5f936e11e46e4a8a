"""The corpus pipeline: language, near duplicates, repeated passages, contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. run() writes each result as Parquet in the shared folder and reads it back for the next stage.

Defined results: documents without a letter (null, empty, signs alone) go in the first stage; rows that repeat are one
group of the second, of which one row stays; a row without a doc_id is kept where it is its group's only kind; texts of
any length are worked on whole; an empty table stays empty through all stages; further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontam, langid, packing, simhash, substring
from strandlake.llm.common import cut, release, table
from strandlake.llm.tokens import vocabulary

#: Not SQL: trained models, fingerprints and packing.
ORACLE_SQL = None
#: Bits of 64 by which fingerprints of near duplicates may differ (the query op10_simhash takes 2).
NEAR_BITS = 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; the others (no text, or not a letter in it) go."""
    found = langid.identify(docs, langid.fit(docs, langid.pieces_file()), docs.columns, ("__lang_pred", "__score"))
    return found.where("__lang_pred != 'und'").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest doc_id. Fingerprints are of runs of three words, as
    op10_simhash has them; they link at NEAR_BITS or fewer differing bits, 15/16 of all being equal."""
    return simhash.one_of_each(docs, bits=NEAR_BITS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a document with a smaller doc_id holds, as their kept words
    joined by one space; texts that lose nothing are unchanged, and those that lose all go. n_chars follows the text."""
    found = substring.deduplicate(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text").cast("string")).otherwise(F.col("carried.text"))
    kept = found.where("n_removed = 0 OR n_removed < n_words").select("carried", text.alias("__text"))
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("__text").isNotNull(), F.char_length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried.n_chars"))}
    return kept.select(*(new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    bad = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("uid").alias("__u")).distinct()
    rows = docs.withColumn("__uid", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    return rows.join(bad, (rows["__uid"] == bad["__u"]) & rows["doc_id"].eqNullSafe(bad["__d"]), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
