"""The pipeline's stages on a small corpus: each decision against brute force over the stage's own input."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from runfold.llm import packing, quality_cnn, toxicity
from runfold.llm.queries import quality_network, tokenizer_path, toxicity_grammar
from tests.llm.test_operators import DOCS, LABELS, brute_components, brute_targets, corpus, labelled_corpus, rows_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = labelled_corpus(80)
    r = random.Random(8)
    for i in range(0, 60, 3):  # near copies
        words = rows[i][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((500 + i, " ".join(words), "en", r.choice(["a", "b"]), 1))
    rows = [(*row[:3], "abc"[n % 3], n) for n, row in enumerate(rows)] + corpus()[-9:]
    at = tmp_path_factory.mktemp("pipe")
    docs = spark.createDataFrame(rows, DOCS).withColumn("__pipeline", F.lit("clash")).withColumn("score", F.lit(1))
    docs.coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return str(at)


def bag(rows):
    return collections.Counter(str(sorted(r.items())) for r in rows)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{n}")
        again = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert again.columns == docs.columns
        stages.append((rows_of(docs), rows_of(again)))
        docs = again
    # toxicity
    before, after = stages[0]
    grammar = toxicity_grammar(spark.read.parquet(f"{folder}/documents.parquet"), labels).compile()
    assert bag(after) == bag(r for r in before if grammar.score(r["text"] or "") < 0.3)
    assert not any("grumblefox" in (r["text"] or "") for r in after) and len(after) > len(before) / 2
    # quality
    before, after = stages[1]
    net = quality_network(spark.read.parquet(f"{tmp_path}/0"), labels)
    table = net.table()
    assert bag(after) == bag(r for r in before if quality_cnn.probability(net, table, r["text"] or "") >= 0.5)
    # near duplicates
    before, after = stages[2]
    head, _ = brute_components([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], 5, 80)
    assert {r["doc_id"] for r in after if r["doc_id"] is not None} == set(head.values())
    assert len([r for r in after if r["doc_id"] is not None]) == len(set(head.values()))
    # mix
    before, after = stages[3]
    size = collections.Counter()
    for r in before:
        size[r["source"]] += len((r["text"] or "").encode().split())
    taken = collections.Counter()
    for r in after:
        taken[r["source"]] += len((r["text"] or "").encode().split())
    largest = {s: max(len((r["text"] or "").encode().split()) for r in before if r["source"] == s) for s in size}
    for source, want in brute_targets(size).items():
        assert abs(taken[source] - want) <= max(2, largest[source] / 2)
    assert all(n <= 3 * bag(before)[k] for k, n in bag(after).items())
    # packing
    before, after = stages[4]
    encoder = packing.WordEncoder(tokenizer_path())
    assert sum(r["length"] for r in after) == sum(len(encoder.encode(r["text"] or "")) // 4 + 1 for r in before)
    used = collections.Counter()
    for r in after:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_free_name(spark):
    assert corpus_pipeline.free_name(spark.createDataFrame([(1,)], "__pipeline int")) == "__pipeline_"
    assert toxicity.FEATURES[0] == "directed"
