from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from tests.llm.fixtures import frame, odd
from tests.llm.test_corpus_operators import components
from tokenizers import Tokenizer

from panelyard.llm import mixing, quality_model, toxicity


@pytest.fixture
def folder(spark, tmp_path):
    import random

    from tests.llm.fixtures import prose

    r = random.Random(2)
    docs = []
    for i in range(90):
        text = prose(r, 80)
        if i % 9 == 0:
            text += " idiot moron idiot moron"
        if i % 7 == 0:
            text = " ".join(w + "###" for w in text.split())
        docs.append((i, text, f"s{i % 4}"))
    docs += [(100 + i, docs[i][1], "s1") for i in range(5, 25)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0 if i % 7 == 0 else 1, 1 if i % 9 == 0 else 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs


def test_stages_one_by_one(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = stage(spark, docs, path)
        rows = out.collect()
        if i < 4:
            assert out.columns == columns
            after = [(r["doc_id"], r["text"], r["source"]) for r in rows]
        if i < 2:
            module, verdict = (toxicity, 0) if i == 0 else (quality_model, 1)
            scores = module.score(docs, module.train(docs, labels)).collect()
            assert sorted(x[0] for x in after) == sorted(r["doc_id"] for r in scores if r["predicted"] == verdict)
            assert len(after) < len(before)
        if i == 2:
            assert sorted(x[0] for x in after) == sorted(c[0] for c in components(before) if c[3])
        if i == 3:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(docs).collect()}
            words = {d: len(t.split()) for d, t, _ in before}
            assert {d: sum(x[0] == d for x in after) * words[d] for d in taken} == taken
        if i == 4:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == sorted((d, len(library.encode(t, add_special_tokens=False).ids)) for d, t, _ in before)
        docs = out


def test_run_equals_its_stages_and_survives_odd_tables(spark, folder, tmp_path):
    path, docs = folder
    assert 0 < corpus_pipeline.run(spark, path).count() < 3 * len(docs)
    other = str(tmp_path / "odd")
    frame(spark, odd()).write.parquet(f"{other}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{other}/labels.parquet")
    assert corpus_pipeline.run(spark, other).count() > 0
    none = str(tmp_path / "none")
    frame(spark, []).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
