"""Defined cases of the pipeline's stages, each on its own input."""

import pytest

import corpus_pipeline
from tests.llm.conftest import SF


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_rows(spark, odd, no_docs, name, stage):
    got = stage(spark, odd, SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert got.columns == odd.columns + ["copy"] * last
    ids = {r.doc_id for r in got.collect()}
    assert ids <= {1, 2, 3, 4, 5, 6, 7, None}
    if name in ("decontamination", "pii"):
        assert got.count() == odd.count()
    if name == "near_dedup":
        assert ids == {1, 2, 3, 4, 6, 7, None}
    if name == "language_id":
        assert not ids & {1, 2, 6}
    if last:
        assert not ids & {1, 2}
    assert stage(spark, no_docs, SF).count() == 0
