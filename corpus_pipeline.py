"""A corpus pipeline of five stages, each a whole-corpus decision of one operator.

toxicity: documents with a score of 0.5 or more go. line dedup: lines found in at least 10 documents go
from the others' texts. near duplicates: of each group of documents whose sets of five-word shingles are
linked by a Jaccard similarity of at least 0.8, the one with the smallest doc_id stays (documents without
words are in no group). decontamination: documents that the benchmark contaminates go. packing: what is
left becomes token sequences. n_chars always tells the length of the text as it is.

A null text passes as one without words, and line dedup makes it an empty one; a null doc_id is kept, and of
near duplicates comes last. Rows that are repeated are near duplicates of each other: one stays; without words
they all stay. Columns beyond those of documents aren't returned. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm import op1_decontamination, op5_packing, op6_jaccard, op7_line_dedup, op8_toxicity
from fieldlab.llm.common import checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = op8_toxicity.learn(docs, table(spark, sf_dir, "labels").where(~op8_toxicity.held_out()))
    return op8_toxicity.score_toxicity(docs, lexicon).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = op7_line_dedup.dedup_lines(docs, op7_line_dedup.batches_of(docs))
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_jaccard.drop_near_duplicates(docs, shingle=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_packing.pack(docs, op5_packing.tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Learned weights, components and best fit are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what one returns is written to the shared folder and read by the next.

    A stage's input is removed once its output is written, and everything if a stage fails; the last output stays.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
    except BaseException:
        removed(spark, folder)
        raise
    return docs


def removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
