"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ``[^\x20\x09-\x0D]+`` separates words by; bytes.split() without arguments splits by the same six bytes.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own, but only with a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        own = context._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="sylvagraph-"))
            own = context._jsc.sc().getCheckpointDir()
        found = own.get()
    return found


#: Whether Spark deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, release: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors. ``release``: its shuffle files go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_path = path
    return found


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote and nothing will read again."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which Spark deletes once nothing refers to it. For small tables and loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for columns of any name: it would take a dot in one for a field."""
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(lambda batches: fn(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches), schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return mapped(df, run, schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, whatever dots and quotes these have; repeats once."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in dict.fromkeys(names)]


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))


def shingle_hashes(words: list[bytes], shingle_words: int, seed: int) -> np.ndarray:
    """The XXH64 of each space-joined run of ``shingle_words`` words, repeats included; fewer words are one run."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle_words + 1].tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number with the bits that over half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
