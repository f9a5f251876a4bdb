"""Corpus preparation over ``documents``: identify, rate, de-duplicate, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscape.llm import bpe, decontaminate, jaccard, langid, quality
from clonoscape.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects.

    Null and empty texts and texts without a letter are rejected; a null lang is
    not learned from; repeated rows go or stay alike; an empty table stays empty.
    """
    return langid.keep_identified(docs, langid.train(docs, F.lit(True)))


def rated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the threshold.

    A null text is scored as an empty one, a very long one whole; repeated rows go
    or stay alike; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near duplicates.

    Null and empty texts are near nothing and stay; very long texts are compared
    whole; rows that repeat an id, or have none, are told apart by their texts; an
    empty table stays empty.
    """
    return jaccard.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark.

    Null and empty texts hold none and stay; repeated rows go or stay alike; an
    empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row a row, those without an id too.

    A null text has no tokens and the digest of the empty string; repeated rows
    are encoded each, very long texts whole; an empty table gives no rows.
    """
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), release=True)  # the workers go on to other stages


STAGES = [("language", language), ("quality", rated), ("near_duplicates", distinct), ("decontamination", decontaminated), ("bpe", tokenised)]

#: The language and quality stages are learned models, which SQL can't express; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
