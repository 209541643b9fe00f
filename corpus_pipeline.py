"""From raw documents to token ids: the stages of the training corpus, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelftally.llm import exact_dedup, language, mixing, pieces, simhash
from shelftally.llm.common import cut, free_names, read, remainder
from shelftally.llm.queries import model_path

#: Documents whose most likely language is less likely than this are rejected.
LEAST_SURE = 0.5


def in_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is fairly sure; learned outside the held-out fold, as the query is."""
    network = language.train(docs.where(remainder("doc_id", 5) != 0))
    lang, score = free_names(docs.columns, "lang_pred", "score")
    found = language.with_language(docs, network, lang, score)
    sure = (F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SURE)
    return found.where(sure).drop(lang, score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.take(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and a digest of the text that they decode to."""
    return pieces.tokens(docs, model_path()).select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", in_known_languages),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mix_sources", in_mixture),
    ("sentencepiece", as_tokens),
]

#: Hashing, training and random rounding have no counterpart in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is computed once, and read by the next one from the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
