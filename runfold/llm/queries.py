"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.llm import audio, minhash, mixing, packing, perplexity, quality_cnn, sample, sharding, toxicity, url_filter, warc
from runfold.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the dealt tokenizer; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def quality_network(docs: DataFrame, labels: DataFrame) -> quality_cnn.Network:
    return quality_cnn.train(docs, labels, sample.crc_bucket(3) != 1)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality_network(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.flag(docs, network, "score").drop("text")
    return scored.select("doc_id", (sample.crc_bucket(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_grammar(docs: DataFrame, labels: DataFrame) -> toxicity.Grammar:
    return toxicity.train(docs, labels, sample.crc_bucket(4) != 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity_grammar(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.flag(docs, grammar, "score").drop("text")
    return scored.select("doc_id", (sample.crc_bucket(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24, 8)


def op3_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_ngram_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_documents(table(spark, sf_dir, "documents"))


def op10_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_minimax_sharding,
        op3_link_graph_url_filter,
        op4_ngram_perplexity_rules,
        op5_quality_classifier,
        op6_toxicity,
        op7_telephony_audio,
        op8_mixing,
        op9_minhash_near_dedup,
        op10_warc_capture_index,
    )
}
#: Oracle SQL for those that DuckDB SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {"op3_link_graph_url_filter": url_filter.oracle(), "op8_mixing": mixing.oracle(), "op10_warc_capture_index": warc.ORACLE}
