"""The corpus pipeline: toxicity, quality, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.llm import common, minhash, mixing, packing, quality_cnn, toxicity
from runfold.llm.queries import quality_network, table, tokenizer_path, toxicity_grammar

#: A name that no column of the input has is made from this.
MARK = "__pipeline"


def free_name(docs: DataFrame, stem: str = MARK) -> str:
    name = stem
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; null and empty texts stay."""
    grammar = toxicity_grammar(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = free_name(docs)
    return toxicity.flag(docs, grammar, score).where(F.col(score) < 0.3).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    network = quality_network(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = free_name(docs)
    return quality_cnn.flag(docs, network, score).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): that with the least doc_id.

    Documents without a word, and rows with a null doc_id and no copy that has one, stay. Of
    rows that share a kept doc_id one stays.
    """
    found = minhash.near_duplicates(docs, k=5, percent=80)
    gone = common.materialize(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(free_name(docs))).distinct(), "gone")
    id_ = F.col(gone.columns[0])
    few = gone.count() <= minhash.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == id_, "left_anti")
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or up to three rows each."""
    copies, key, id_, source = (free_name(docs, f"{MARK}_{x}") for x in ("copies", "key", "id", "source"))
    mixed = mixing.mix_documents(docs.select("doc_id", "text", "source")).where("copies > 0").groupBy("doc_id", "source", "key").agg(F.max("copies").alias(copies))
    mixed = common.materialize(mixed.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("key").alias(key), copies), "copies")
    here = F.md5(common.text_or_empty(docs["text"].cast("string")).cast("binary"))
    joined = docs.join(mixed, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & docs["source"].eqNullSafe(F.col(source)) & (here == F.col(key)))
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[docs[c] for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifiers; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
