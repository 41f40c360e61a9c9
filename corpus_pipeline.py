"""From raw documents to a mixed, encoded corpus in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of ``documents``.

Nulls, empty and very long texts, repeated rows, empty tables and columns of
any name have the results that the operators' docstrings state: rows without
doc_id are kept apart from near copies and have places in the mixture like
others, and no rows in give no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattiq.llm import bpe, exact_dedup, mixing, near_dedup, quality
from lattiq.llm.common import Scratch, table
from lattiq.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, one stays."""
    return exact_dedup.drop_copies(docs, Scratch(spark, "pipeline-exact"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 or more, one stays."""
    return near_dedup.drop_near_copies(docs, Scratch(spark, "pipeline-near"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which Pfair scheduling mixes their sources."""
    return mixing.in_mixture_order(docs, Scratch(spark, "pipeline-mix"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and their decoding, as counts and digests, with the place in the mixture.

    Files keep no order that a reader can rely on, so ``position`` says it.
    """
    encoded = bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), carry=("source",))
    return mixing.with_position(encoded, docs, Scratch(spark, "pipeline-place"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixture),
    ("bpe", encoding),
]

#: SQL can express neither the classifier nor the encoder; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
