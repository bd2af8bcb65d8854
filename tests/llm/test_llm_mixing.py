"""Mixing where sources are of unlike size."""

import random

import pytest
from test_llm_corpus import kept_docs

from refsieve.llm import mixing
from refsieve.session import stored


@pytest.mark.parametrize("tiny", [60, 320])
def test_a_tiny_source_leaves_the_passages_of_others_whole(spark, tiny):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.randint(100, 400))), f"s{i % 3}") for i in range(300)]
    alone = sorted((r.doc_id, r.text) for r in mixing.mixed_documents(kept_docs(spark, rows)).collect())
    docs = kept_docs(spark, [*rows, (1000, " ".join(f"t{j}" for j in range(tiny)), "tiny")])
    found = mixing.mixed_documents(docs).collect()
    stretches = [s for r in found if r.source != "tiny" for s in r.text.split("\n")]
    assert sum(len(s.split()) for s in stretches) / len(stretches) > 48
    assert 0.95 < len(stretches) / sum(len(text.split("\n")) for _, text in alone) < 1.05
    report = mixing.Mix(docs).report().toPandas()
    by = report.groupby(["target", "source_size"])["taken"].sum().reset_index()
    assert len(by) == 4 and (abs(by["taken"] / by["target"] - 1) < 0.02).all()


@pytest.mark.parametrize("doc_id", [None, 7])
def test_documents_of_one_id_are_many_shards(spark, doc_id):
    rng = random.Random(6)
    rows = [(doc_id, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)), "s") for _ in range(400)]
    docs = kept_docs(spark, rows)
    sizes = [r["count"] for r in mixing.Mix(docs)._dealt().groupBy("__shard").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 140
    texts = sorted(r.text for r in mixing.mixed_documents(docs).collect())
    assert texts == sorted(r.text for r in mixing.mixed_documents(stored(docs.repartition(5), "again")).collect())
