"""Every query and stage over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import util  # noqa: E402

import corpus_pipeline  # noqa: E402
from sluice.llm import mixing, registry  # noqa: E402

ONE_ROW = {n for n in registry.QUERIES if not n.startswith(("op5_", "op6_"))}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows(name, spark, tmp_path):
    ids = [*range(len(util.ODD) - 3), None, None, 4]
    rows = registry.QUERIES[name](spark, util.odd_documents(tmp_path, ids=ids)).collect()
    got = collections.Counter(r[0] for r in rows)
    if name in ONE_ROW:
        assert got == collections.Counter(ids)
    elif name == "op6_sentencepiece":
        # Texts of one segmentation have one sample, others two.
        assert all(n <= got[i] <= 2 * n for i, n in collections.Counter(ids).items()) and all(r.round_trip for r in rows)
    else:
        assert set(got) <= set(ids) and all(1 <= r.epoch <= mixing.MAX_EPOCHS for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(name, spark, tmp_path):
    assert registry.QUERIES[name](spark, util.odd_documents(tmp_path, texts=[])).count() == 0


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES)))
def test_odd_texts_equal_sql(name, same, tmp_path):
    """Whole ids, every odd text; SQL and Spark agree."""
    texts = util.ODD if name not in ("op9_ngram_jaccard",) else [t for t in util.ODD if t != util.LONG]
    path = util.odd_documents(tmp_path, texts=texts)
    same(registry.QUERIES[name], registry.ORACLES[name], path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    path = util.odd_documents(tmp_path, texts=[*util.ODD, util.LONG, util.LONG])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    empty = util.odd_documents(tmp_path / "empty", texts=[])
    assert corpus_pipeline.run(spark, empty).count() == 0
