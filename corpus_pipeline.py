"""A corpus pipeline of four operators: quality, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvagraph.llm import bpe, mixing, quality, simhash
from sylvagraph.llm.common import free_name, quoted, shared_dir
from sylvagraph.sources.tables import read_table

#: Rows that Python workers get at a time. They are whole texts, or two: Spark's 10,000 of them are held several times over, in each worker and outside the heap.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets ``BATCH_ROWS`` for the session. It stays set, since a stage's result is made when the caller writes it; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    small_batches(spark)
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles, that of the smallest id."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: file by file and row by row, sources interleave at their target weights."""
    return mixing.mixed(docs)


def positioned(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs`` with ``name``: the rows of all files before (``part-NNNNN`` by NNNNN), then the row's index in its file. No column's name is in its way."""
    file, index, base, number = (free_name(docs, f"mix_{c}") for c in ("file", "index", "base", "number"))
    path = F.col("_metadata.file_name")
    part = F.struct(F.regexp_extract(path, r"^part-(\d+)", 1).cast("bigint").alias("part"), path.alias("name"))
    rows = docs.select(*quoted(docs.columns), part.alias(file), F.col("_metadata.row_index").alias(index))
    # One row a file.
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(file).agg(F.count(F.lit(1)).alias(number)).select(file, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(base))
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return rows.join(F.broadcast(files), file).select(*quoted(kept), (F.col(base) + F.col(index)).alias(name))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position, n_tokens, token_ids (packed little-endian unsigned 32-bit integers) and digests of the ids and of the decoded bytes.

    ``position`` (from 0) is the row's place in the mixed order of ``docs``, which must be read from the files of the mixing stage.
    """
    small_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode_and_decode(positioned(docs), ranks, pattern, keep=["doc_id", "source", "position"])
    return both.select(
        "doc_id", "source", "position", (F.length("token_ids") / 4).cast("bigint").alias("n_tokens"), "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can't express the classifier, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
