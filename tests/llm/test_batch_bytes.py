"""Texts and sets go to the workers of the two joins in batches of few bytes, and the session is left as it was."""

import pytest

from rasterecho.llm import near_dup, scratch, set_join

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize(("module", "run"), [(near_dup, near_dup.near_duplicates), (set_join, set_join.similar_sets)])
def test_small_batches(spark, monkeypatch, module, run):
    seen, kept = set(), module.keep
    monkeypatch.setattr(module, "keep", lambda df, name: (seen.add(spark.conf.get(NAME)), kept(df, name))[1])
    before = spark.conf.get(NAME)
    words = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, words), (2, words + " x"), (3, words), (4, "none of it"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in run(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert seen == {str(scratch.BATCH_BYTES)} and spark.conf.get(NAME) == before


def test_session_is_left_as_it_was_after_an_error(spark):
    before = spark.conf.get(NAME)
    with pytest.raises(ZeroDivisionError), scratch.small_batches(spark):
        1 / 0
    assert spark.conf.get(NAME) == before
