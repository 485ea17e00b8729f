"""Token ids as Parquet list columns, and selective reads of them (operator 10).

Encoding: texts are cut before spaces and newlines after or before something other than white space, where no match of
the byte-level pre-tokenizer can span; the distinct pieces of a batch are encoded by the tokenizers library and put
together by their codes. Texts with a space or newline between white space, or with the name of one of the tokenizer's added tokens (which the
library takes for that token), go to the library whole.

Files: one row a document in ascending id order over all files (``part-NNNNN`` by NNNNN, then row by row): its
id, its number of tokens and its ids as a list column. Ids are dictionary encoded, the id and length columns
delta encoded; row groups and pages are of a set size and have page indexes, so readers of some ids, or of lengths only, fetch
no other pages. Offsets of documents aren't written: they follow from the lengths, which are
cheap to read, file by file.

Null and empty texts have the end id alone. Equal ids stand in the order of their texts, null ids first; ranges are cut between ids and, where one
id has many rows, between the beginnings of their texts. Columns beside
``id_col`` and ``text_col`` are not kept.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvagraph.llm.common import arrow_map, shared_dir

#: White space of any kind, for RE2. A cut before a space or newline that has it on both sides may fall inside a match.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_UNSAFE = _WHITE + r"[ \n](?:" + _WHITE + r"|\z)"
#: Latin or Cyrillic letters, then ASCII punctuation without the apostrophe, which may begin a contraction.
_SIMPLE = r"^(?P<letters>\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{400}-\x{481}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
SLICE_BYTES = 6 << 20
JOINED = 256
MAX_PIECES = 500_000


class PieceEncoder:
    """The tokenizers library behind caches of bounded size, which give packed ids.

    Most chunks between spaces are letters and then ASCII punctuation: two matches of the pre-tokenizer. Arrow takes
    them apart and numbers the distinct ones, so Python sees each once a batch. All other chunks are looked up whole.
    """

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # A token of a byte-level vocabulary has a character for each byte.
        self.lengths = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], dtype=np.int64)
        names = [re.escape(a.content) for a in self.library.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([_UNSAFE, *names])
        self.matches = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}  # letters after a space, or a newline and letters
        self.pieces: dict[str, bytes] = {}  # single matches
        self.chunks: dict[str, bytes] = {}  # any text that is encoded by itself

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Several are encoded as one text, each a match of its own; the bytes of tokens tell where one ends."""
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        texts = ["".join([w if w[0] == "\n" else f" {w}" for w in group]) for group in groups]
        for group, found in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.cumsum([len(w.encode()) + (w[0] != "\n") for w in group])
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            packed, at = ids.tobytes(), 0
            for word, stop in zip(group, stops.tolist(), strict=True):
                self.words[word] = packed[4 * at : 4 * stop]
                at = stop

    def _learn_pieces(self, pieces: list[str]) -> None:
        self.pieces.update(zip(pieces, self._each(pieces), strict=True))

    def _learn_chunks(self, chunks: list[str]) -> None:
        parts = [self.matches(c) for c in chunks]
        pieces = list({p for found in parts for p in found})
        of = dict(zip(pieces, self._found(pieces, self.pieces, self._learn_pieces), strict=True))
        self.chunks.update((c, b"".join([of[p] for p in found])) for c, found in zip(chunks, parts, strict=True))

    def _found(self, keys: list[str], cache: dict[str, bytes], learn) -> list[bytes]:
        got = list(map(cache.get, keys))
        if None not in got:
            return got
        if len(cache) > MAX_PIECES:
            cache.clear()
            got = [None] * len(keys)
        learn(list({k for k, x in zip(keys, got, strict=True) if x is None}))
        return list(map(cache.__getitem__, keys))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        # Cuts stand before spaces and newlines: a chunk has its newline, or had a space before it.
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(whole), "", texts), "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        firsts = offsets[:-1]
        # Letters, punctuation and the chunks that are neither, each with numbers of its own in one list of packed ids.
        found = pc.extract_regex(coded.dictionary, _SIMPLE)
        letters, marks = (pc.struct_field(found, i).dictionary_encode() for i in ("letters", "marks"))
        odd = found.is_null().to_numpy(zero_copy_only=False)
        packed = self._found(letters.dictionary.to_pylist(), self.words, self._learn_words)
        at_marks = len(packed)
        packed += [b"" if not x else self._found([x], self.pieces, self._learn_pieces)[0] for x in marks.dictionary.to_pylist()]
        at_odd = len(packed)
        packed += self._found([x if x[:1] == "\n" else f" {x}" for x in coded.dictionary.filter(pa.array(odd)).to_pylist()], self.chunks, self._learn_chunks)
        at_first = len(packed)
        packed += self._found(coded.dictionary.take(pa.array(codes[firsts])).to_pylist(), self.chunks, self._learn_chunks)
        empty = len(packed)
        packed += [b"", b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()]
        at = np.flatnonzero(whole)
        for i, ids in zip(at.tolist(), self._each(texts.take(pa.array(at)).to_pylist()), strict=True):
            packed[at_first + i] = ids
        number = lambda column, base, rest: np.where(odd, rest, column.indices.fill_null(0).to_numpy() + base).astype(np.int32)
        head = number(letters, 0, at_odd + np.cumsum(odd) - 1)
        tail = number(marks, at_marks, empty)
        pairs = np.empty((len(codes), 2), dtype=np.int32)
        pairs[:, 0], pairs[:, 1] = head[codes], tail[codes]
        pairs[firsts, 0], pairs[firsts, 1] = at_first + np.arange(len(firsts)), empty
        codes, offsets = pairs.ravel(), offsets * 2
        if end_id is not None:
            codes = np.insert(codes, offsets[1:], empty + 1)
            offsets = offsets + np.arange(len(offsets))
        sizes = np.fromiter(map(len, packed), dtype=np.int32, count=len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
        of_code = sizes[codes]
        ends = np.cumsum(of_code, dtype=np.int32)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[codes] - (ends - of_code)
        at = np.repeat(shift, of_code)
        at += np.arange(len(at), dtype=np.int32)
        return np.concatenate(([0], ends))[offsets], flat[at]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    return PieceEncoder(path, pattern)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE_BYTES of text."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def encode(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``token_ids`` ARRAY<INT>, rows as they come."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in _slices(batch, text_col):
            texts = part.column(text_col)
            offsets, ids = encoder(tokenizer_path, pattern).encode(texts.cast(pa.string()), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(offsets)), lists], names=[id_col, "n_tokens", "token_ids"])

    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return arrow_map(df.select(*dict.fromkeys([id_col, text_col])), run, schema)


def write(df: DataFrame, path: str, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, partitions: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> str:
    """Writes the token files of ``df``; returns ``path``. Texts are dealt by id ranges before they are encoded, so ids aren't shuffled."""
    by = [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()]
    ranges = [by[0], F.substring(text_col, 1, 24).asc_nulls_first()]
    docs = df.select(*dict.fromkeys([id_col, text_col]))
    dealt = docs.repartitionByRange(partitions, *ranges) if partitions else docs.repartitionByRange(*ranges)
    (
        encode(dealt.sortWithinPartitions(*by), tokenizer_path, pattern, id_col, text_col, end_id)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#token_ids.list.element", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The token table with ``part`` and ``row``, which give its order."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    return spark.read.parquet(path).select("*", part.alias("part"), F.col("_metadata.row_index").alias("row"))


def with_starts(table: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of all documents before. Sums run inside each file and over the files' totals."""
    files = table.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(bases, "part").withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base")


def read_some(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """The rows of some documents: the filter on the sorted id column reaches row groups and page indexes."""
    return read(spark, path).filter(F.col(id_col).isin(ids))


def checksums(table: DataFrame, keep: list[str], ids_col: str = "token_ids", name: str = "ids_crc32") -> DataFrame:
    """``keep`` and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(ids_col)
        offsets, packed = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        sums = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sums, pa.int64())], names=[*keep, name])

    schema = T.StructType([*(table.schema[c] for c in keep), T.StructField(name, T.LongType())])
    return arrow_map(table.select(*keep, ids_col), run, schema)


def fresh_path(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
