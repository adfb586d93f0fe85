"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the one
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import exact_dedup, language_id, packing, queries, simhash
from cloudloom.llm.common import held_out, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the predicted language; documents without one (``und``: null texts and those without a letter) go.

    Texts are read whole, rows that repeat get the same answer each, of equal languages the
    first by name wins. An empty table gives no rows; null ids and sources pass through.
    """
    model = language_id.learn(docs, ~held_out(F.col("doc_id")))
    out = language_id.identify(docs, model, lang_name="predicted__", score_name="score__")
    return out.where(F.col("predicted__") != language_id.UNKNOWN).withColumn("lang", F.col("predicted__")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays: that of the most code points, then of the smallest doc_id.

    Null texts count as empty and null ids come last; of rows that repeat id and text one
    stays. Texts are compared whole, by their bytes. An empty table gives no rows.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are 0.8 alike or more the smallest doc_id stays.

    Texts meet by SimHash and Golay keys, then what those do not join by a prefix filter. Groups are what such pairs reach. Rows that share an id stand for themselves, null ids
    come last, null texts and texts without words are alike. Texts are compared whole. An
    empty table gives no rows.
    """
    return simhash.keep_dissimilar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them, rows of an epoch each.

    Null languages and sources are leaves of their own, a null text has one token; rows
    that share a doc_id stand or fall together, rows that repeat count each. An empty table
    gives no rows.
    """
    return queries.mixed(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its place in a sequence; every row of ``docs`` is packed whole, those that mixing repeats each time.

    A null text is the end id alone, null ids pass through, pieces of one length change
    places freely. An empty table gives no rows.
    """
    return packing.pack_documents(docs, queries.tokenizer_path(), added=True)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # language ID, SimHash and tokens are not SQL's


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
