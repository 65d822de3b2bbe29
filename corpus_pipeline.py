"""The corpus pipeline: documents through five operators of `settlekit.llm`, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

1. language ID: documents without a letter, and those whose text prefers no language clearly
   (`LEAST_LANGUAGE`), go.
2. toxicity: documents that are predicted toxic go.
3. MinHash near-dedup: the document with the smallest id of each group of near-duplicates stays,
   once.
4. mixing: the documents in training order, each as often as the mixture takes it; the one on a
   source's boundary is taken whole or left out, whichever is nearer to the source's target.
5. packing: sequences of tokens, a row per piece.

Nulls, empty and long texts, repeated rows and empty tables: see the operators' modules. A null
doc_id passes stages 1, 2 and 4; in stage 3 such documents are kept unless their text has copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.llm import langid, mixing, neardup, packing, toxicity
from settlekit.llm.common import bounded_batches, crc_of_id
from settlekit.llm.queries import table, word_tokenizer
from settlekit.session import checkpoint_dir

#: Documents whose language scores less than this are rejected.
LEAST_LANGUAGE = 0.2


def in_bounded_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`stage` with batches of at most `common.BATCH_ROWS` texts, from then on in its session: its
    result is read later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_bounded_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, (crc_of_id("doc_id") % 4) != 2)
    found = langid.identify(docs, model, keep=docs.columns)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(docs.columns)


@in_bounded_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), (crc_of_id("doc_id") % 5) != 0)
    return toxicity.assess(docs, model, keep=docs.columns).filter("predicted = 0").select(docs.columns)


@in_bounded_batches
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, whole=True)


@in_bounded_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("MinHash near-dedup", dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages have no counterpart in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what is between them goes to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
