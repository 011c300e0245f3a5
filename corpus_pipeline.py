"""From documents to token ids: language identification, near duplicates, mixing, encoding.

Each stage takes all that the one before kept and returns the columns of ``documents``; the last
one returns ids. Rows pass between stages as tables in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tactile.llm import bpe, language, mixing, neardup
from tactile.llm.common import free_name, remainder, store, table
from tactile.session import ship


# Texts under this mean are noise to the model. A word without any feature it knows counts as 0.
SURE_ENOUGH = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of known languages stay, in whatever shares, and get their language where ``lang`` is null.

    Rejected: texts without a letter (or null), and texts whose words the model cannot tell (mean of
    each word's best share, by letters, under ``SURE_ENOUGH``). Short texts are judged alike. Without
    any labelled row no language is known, and no row stays. Repeated rows are judged alike; no rows give
    none. Other columns are kept, whatever their names.
    """
    ship(spark)
    model = language.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    found = free_name(docs, "found")
    label = F.col(found)["lang"]
    known = docs.withColumn(found, language.identify(docs, model)).where((label != language.UND) & (F.col(found)["sure"] >= SURE_ENOUGH))
    return known.withColumn("lang", F.coalesce("lang", label)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest ``doc_id`` stays.

    Null, empty and blank texts are like nothing and stay, and so do rows without ``doc_id``. Of a row
    that repeats, or of an id that repeats with one text, one row stays. Texts are compared whole. No
    rows give none. Other columns are kept, whatever their names.
    """
    ship(spark)
    return neardup.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy the mix takes; the document at a source's budget ends there.

    Texts without words (or null) are not taken. A null source is a source. Of rows equal in id, text
    and source one stands for all, and their copies are added up. Long texts are cut at a word only
    where the budget ends. No rows give none. Other columns are kept, whatever their names.
    """
    ship(spark)
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, text, ids, n_tokens``; the text is decoded from the ids.

    A null text becomes the empty one, without ids. Repeated rows are encoded each, texts of any length
    whole. No rows give none. Other columns are left out.
    """
    ship(spark)
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocab)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.col("decoded").cast("string").alias("text"),
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
    )


STAGES = [
    ("language_identification", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# Stages fit models and sketches: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, name)
    return docs
