"""op9: blocks of texts that end where a task's texts end."""

import pytest

from sylvagraph.llm import classlm


@pytest.mark.parametrize("limit", ["BLOCK_BYTES", "BLOCK_WORDS"])
def test_the_last_chunk_may_end_a_block(spark, limit):
    def small(batches):
        from sylvagraph.llm import classlm as own

        before = getattr(own, limit)
        setattr(own, limit, 1)
        try:
            yield from own.first_pass(batches)
        finally:
            setattr(own, limit, before)

    docs = spark.createDataFrame([(i, f"a b {i}".encode(), i % 2 == 0) for i in range(10)], "doc_id long, text binary, held boolean").coalesce(1)
    found = docs.mapInArrow(small, classlm.SCHEMA).collect()
    words = [bytes(r.payload) for r in found if r.kind == classlm.WORD]
    assert sorted(words) == sorted([classlm.END, b"a", b"b", *(str(i).encode() for i in range(10))])
    assert sum(len(r.numbers) for r in found if r.kind == classlm.KEPT) == 10 and sum(r.kind == classlm.MATRIX for r in found) > 0
