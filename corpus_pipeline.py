"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, SentencePiece ids.

Every stage but the last returns the columns of the documents that it was given; each is written and read again before the
next one. Documents that a stage rejects are gone for the ones after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablehaul.llm import leaks, pieces, pii, simhash, toxicity
from tablehaul.llm.queries import pseudonym_key, tokenizer_file
from tablehaul.llm.text import stored, table
from tablehaul.session import ship_package


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go; it learns from the labelled documents among the given ones."""
    ship_package(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents whose SimHash fingerprints of three-word shingles link at three bits, the one with the smallest id stays."""
    ship_package(spark)
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    ship_package(spark)
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms; no document goes."""
    ship_package(spark)
    return pii.pseudonymise(docs, pseudonym_key(spark)).select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and the text that they decode to."""
    ship_package(spark)
    return pieces.encode_and_decode(docs, pieces.Vocabulary.load(tokenizer_file(spark)))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("personal_data", with_pseudonyms),
    ("sentencepiece", as_pieces),
]

#: SQL has neither the fingerprints nor the learnt lexicon, the permutations and the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
