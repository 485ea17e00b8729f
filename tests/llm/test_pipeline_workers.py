"""What the pipeline's stages hold in Python: one worker a task, and few texts at a time."""

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest

from sylvagraph.llm import bpe, quality
from sylvagraph.llm.common import arrow_map
from sylvagraph.sources.tables import read_table

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def own_batch(spark):
    before = spark.conf.get(BATCH)
    yield
    spark.conf.set(BATCH, before)


def python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_quality_takes_one_worker_a_task(spark, sf_dir, own_batch):
    docs = read_table(spark, sf_dir, "documents")
    found = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert python_steps(found) == 1 and found.columns == docs.columns
    labels = read_table(spark, sf_dir, "labels").filter(~(quality.crc32_of_id("doc_id") % 4 == 2))
    model = quality.fit(quality.statistics(docs, ["doc_id"]).join(labels.selectExpr("doc_id", "quality as label"), "doc_id"))
    plain = quality.scored(quality.statistics(docs, ["doc_id"]), model, ["doc_id"]).filter("score >= 0.7")
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in plain.collect()) != []


def test_tokens_take_one_worker_a_task(spark, sf_dir, tmp_path, own_batch):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    odd = spark.createDataFrame([(-1, None, None), (-2, "a", ""), (-3, "a", "\u00e9 " * 9000)], docs.schema)
    path = str(tmp_path / "mixed")
    docs.unionByName(odd).write.parquet(path)
    docs = spark.read.parquet(path)
    found = corpus_pipeline.token_stage(spark, docs, sf_dir)
    assert python_steps(found) == 1
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    plain = bpe.decode(bpe.encode(docs, ranks, pattern, keep=["doc_id"]), ranks, pattern).selectExpr("doc_id", "token_ids", "sha2(decoded, 256) as ids")
    assert sorted(map(tuple, found.select("doc_id", "token_ids", "decoded_sha256").collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_stage, corpus_pipeline.near_duplicate_stage])
def test_batches_are_small(spark, sf_dir, own_batch, stage):
    stage(spark, read_table(spark, sf_dir, "documents").limit(40), sf_dir)

    def run(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    assert max(r.n for r in arrow_map(spark.range(12_000).coalesce(1), run, "n bigint").collect()) <= 1000
