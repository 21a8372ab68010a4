"""The corpus pipeline: documents without toxic, unidentifiable, near-duplicate and contaminated ones, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm.common import durable, table
from brightloom.llm.decontamination import keep_uncontaminated
from brightloom.llm.language_id import keep_known_language
from brightloom.llm.near_duplicates import one_of_each
from brightloom.llm.packing import pack_documents
from brightloom.llm.queries import vocabulary
from brightloom.llm.toxicity import keep_clean


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the threshold, all columns; null, empty and wordless texts score 0 and stay, as do repeated rows."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter, of which a language can be predicted; null and empty texts go; repeated rows stay."""
    return keep_known_language(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates; null and empty texts are no copies and stay; of repeated rows one stays."""
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null and empty texts hold none and stay, as does everything if the benchmark is empty."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining rows as pieces in sequences; a null or empty text is one piece of the id 0; an empty table packs into nothing."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", in_known_language),
    ("ngram_jaccard_join", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: No SQL expresses trained models, MinHash or byte-pair merging; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
