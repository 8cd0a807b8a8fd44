"""The corpus pipeline: stages over documents, each one operator of pointloom.llm.

Every stage takes all rows that its predecessor kept, null and empty texts, null ids and repeated rows included, and works
on an empty table as well; what it does with each is said below. Columns that begin with `_lid`, `_ld_` or `_ng_` are the
stages' own; all others are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import cut, table
from pointloom.llm.language import UNDETERMINED, predict_languages, train_language_model
from pointloom.llm.line_dedup import drop_repeated_lines
from pointloom.llm.ngram_join import one_of_each_component
from pointloom.llm.packing import pack_documents
from pointloom.llm.secrets import default_vocabulary, redact_secrets

#: A document goes if no language of its mixture holds this share of it.
LEAST_SCORE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: rejected are texts without letters (null and empty ones too), and mixtures without a main
    language. Equal texts stay or go together; of equal proportions the first language by name is the main one."""
    found = predict_languages(docs, train_language_model(docs), column="_lid")
    return found.where((F.col("_lid.lang_pred") != UNDETERMINED) & (F.col("_lid.score") >= LEAST_SCORE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, by id (null first) and place; those of which nothing is left go,
    but texts without a word before stay. Rows that share an id and a text are the same lines."""
    return drop_repeated_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of rows that share an id and a text, one. Texts
    without words are nobody's copies."""
    return one_of_each_component(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows. Null texts stay null."""
    return redact_secrets(docs, default_vocabulary())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents stands in the training sequences. A null or empty text is its separator alone."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_languages),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]
#: The mixtures of languages can't be had in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
