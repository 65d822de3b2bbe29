"""The registered queries of this subpackage (`QUERIES`); `SQL` is that of those which SQL can
express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.llm import (
    ann,
    bestfit,
    htmltext,
    langid,
    mixing,
    neardup,
    packing,
    phrases,
    sharding,
    topk,
    toxicity,
    variants,
    warc,
)
from settlekit.llm.common import crc_of_id
from settlekit.llm.sql import SQL


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> Column:
    """Whether the remainder of the id's crc32 is `fold`; a null id is not."""
    return F.coalesce(crc_of_id("doc_id") % folds == fold, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, (crc_of_id("doc_id") % 4) != 2)
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), (crc_of_id("doc_id") % 5) != 0)
    found = toxicity.assess(docs, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "hits", "quoted")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.inner_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.new_folder(pages)
    found = warc.read(warc.write(pages, folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "node")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents")).withColumn(
        "position", F.round(F.get("takes", F.lit(0))["position"], 9)
    )
    ordered = mixing.in_order(planned, ["position", "doc_id", "size"])
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), byte_tokenizer())


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_warc": op4_warc,
    "op5_neardup": op5_neardup,
    "op6_html": op6_html,
    "op7_ann": op7_ann,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_phrases": op11_phrases,
    "op12_bestfit": op12_bestfit,
    "op13_variants": op13_variants,
}
