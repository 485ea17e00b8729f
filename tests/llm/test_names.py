"""Columns whose names clash or hold dots, and very long urls."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sylvagraph.llm import bpe, htmltext, quality, simhash, urlfilter

NAMES = ["a.b", "mix_base", "mix_file", "mix_index", "position", "Statistics", "row_key"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i % 3} " * 30, "en", "web", 9, *["x"] * len(NAMES)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_stages_keep_columns_of_any_name(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert quality.accepted(docs, labels, threshold=0.0).columns == docs.columns
    assert quality.accepted(docs, labels, threshold=0.0).count() == 12
    once = simhash.deduplicated(docs)
    assert once.columns == docs.columns and once.count() == 3
    docs.write.parquet(str(tmp_path / "mixed"))
    tokens = corpus_pipeline.token_stage(spark, spark.read.parquet(str(tmp_path / "mixed")), "")
    assert sorted(r.position for r in tokens.collect()) == list(range(12))
    both = bpe.decode(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert both.columns == [*docs.columns, "token_ids", "decoded"] and both.filter(F.col("`a.b`") == "x").count() == 12


def test_pages_keep_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a", "<p>hello</p>", "y", "old")], "page_id long, url string, html string, `a.b` string, Text string")
    found = htmltext.extract(pages)
    assert found.columns == ["page_id", "url", "a.b", "text"] and found.first().text == "hello"
    judged = urlfilter.judge(pages, [0.0] * 64, 0.0, urlfilter.RULES)
    assert judged.first()["a.b"] == "y" and judged.first().host == "x.org"


def test_n_grams_of_long_urls_take_time_in_proportion(spark):
    def seconds(n):
        df = spark.createDataFrame([("ab" * (n // 2),)], "path string")
        began = time.time()
        assert df.select(F.size(urlfilter.buckets(F.col("path"), "p", 8192)).alias("n")).first().n == 3 * n - 9
        return time.time() - began

    seconds(100)
    assert seconds(64_000) < 16 * seconds(4000) + 10
    tiny = spark.createDataFrame([("",), ("a",), ("abc",), ("é漢🙂x",)], "path string").select(F.size(urlfilter.buckets(F.col("path"), "p", 8192)).alias("n"))
    assert [r.n for r in tiny.collect()] == [0, 0, 1, 3]
