"""The pipeline's stages, one by one and together, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
from synthloom.llm.queries import QUERIES
from tests.llm.cases import documents, empty, rows

SF = "/root/testdata/sf0.001"


def test_stages_take_odd_rows(spark):
    docs = documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        assert stage(spark, empty(spark), SF).count() == 0, name
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    ids = [r["doc_id"] for r in near if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and {9, 60} <= set(ids) and not {21, 33, 63, 66, 69} & set(ids)
    assert sum(r["doc_id"] is None for r in near) == 2
    assert len(rows()) - len(ids) == 5


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
