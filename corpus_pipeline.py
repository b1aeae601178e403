"""A training-corpus pipeline: language, one document of each near-duplicate group, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Of rows
that are equal in every column the second stage keeps one, null ids included; apart from that, rows with a null doc_id pass
the second and third stage as they are, and rows that share an id but differ stay or go together. Texts that are null or
have no letter go in the first stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoregrid.llm.common import discard, small_batches, stash
from scoregrid.llm.language import fit, predict
from scoregrid.llm.mixing import mix_sources
from scoregrid.llm.ngram_join import jaccard_classes
from scoregrid.llm.packing import pack
from scoregrid.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_KNOWN = 0.3  # part of a text's 5-grams that its language must contain
SENT_IDS = 4_000_000  # up to so many ids to remove are sent to every executor; beyond, documents are shuffled to them


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in none of the labelled languages; fills a missing lang."""
    small_batches(spark)
    told = predict(docs.select(*COLUMNS), fit(docs))
    kept = told.where((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def one_of_repeats(docs: DataFrame) -> DataFrame:
    """docs without exact repeats of rows. Only rows whose id stands more than once are compared, so that other texts are not shuffled."""
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    count = several.count()
    if not count:
        return docs
    if count <= SENT_IDS:
        several = F.broadcast(several)
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    return docs.join(several, same, "left_anti").unionByName(docs.join(several, same, "left_semi").dropDuplicates(COLUMNS))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest doc_id stays; of equal rows one."""
    small_batches(spark)
    docs = one_of_repeats(docs.select(*COLUMNS))
    gone = jaccard_classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that repeat one of an earlier document; a document of which nothing is left goes."""
    small_batches(spark)
    out = remove_repeats(docs.select(*COLUMNS))
    changed = F.size("removed") > 0
    out = out.where(~changed | (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) != ""))
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose tokens meet the target shares of sources, languages and topics."""
    small_batches(spark)
    return mix_sources(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens."""
    small_batches(spark)
    return pack(docs)


STAGES = [("language ID", language_stage), ("n-gram Jaccard join", ngram_join_stage), ("substring dedup", substring_stage), ("mixing sources", mixing_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # language ID, IPF and packing are not expressible in SQL; tests compare with brute force
