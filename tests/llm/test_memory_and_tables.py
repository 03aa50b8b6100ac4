"""What a worker remembers of pieces is each caller's choice, and near duplicates empty their tables before texts are read again."""

import pyarrow as pa
import pytest

from rasterecho.llm import near_dup, scratch, token_file
from rasterecho.llm.tokenizers import word_tokenizer

TEXTS = pa.array([f"alpha{i} beta, gamma{i % 7}. Delta" for i in range(300)] + [None, ""])


@pytest.mark.parametrize("memory", [1, 20_000, token_file.MEMORY_BYTES])
def test_memory_changes_no_ids(memory):
    small, plain = token_file.WordEncoder(word_tokenizer(), memory, 1), token_file.WordEncoder(word_tokenizer())
    for at in range(0, len(TEXTS), 50):
        part = TEXTS.slice(at, 50)
        assert [x.tolist() for x in small(part)] == [x.tolist() for x in plain(part)]
    assert memory > 20_000 or small.bytes < plain.bytes


def test_near_duplicates_leave_few_tables(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " x"), (4, None), (None, "a b c"), (4, "z")], "doc_id long, text string")
    scratch.track(spark)
    try:
        left = near_dup.drop_near_duplicates(docs)
        assert scratch.mark(spark) == 2  # the rows, and the keys of those that go
        assert {(r.doc_id, r.text) for r in left.collect()} == {(1, text), (4, "z"), (4, None), (None, "a b c")}
        assert [r.text for r in left.where("doc_id IS NULL").collect()] == ["a b c"]
    finally:
        scratch.forget(spark)
