"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 8).

A text is halved until each leaf is short; a leaf is encoded by itself. Two neighbours join by
encoding anew a window around their border. The window grows to both sides until each of its ends
lies where a match of the pre-tokenizer must end whatever stands farther out: after a letter or digit
and before an ASCII space. No alternative of the pattern has white space after anything else, and none
looks behind itself, so tokens beyond such an end can't depend on what is inside; they are kept as they
are. If there is no such place, the window becomes the whole span. Decoding concatenates the tokens'
bytes up the tree.

Nulls and empty texts have no tokens. A text of any length is encoded whole; what is held in memory is
one batch of rows. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows give repeated results. Columns of
the input named like an output column are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvagraph.llm.common import arrow_map, quoted, text_bytes
from sylvagraph.llm.vectors import slices

LEAF_CHARS = 4096
ROWS_OUT = 512


class TreeCodec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.leaf_chars = max(2, leaf_chars)
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token

    def encode(self, text: str) -> list[int]:
        return self._leaf(text) if len(text) <= self.leaf_chars else self._span(text, 0, len(text))

    def _span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._span(text, lo, mid), self._span(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        p = next((i for i in range(mid - 1, lo, -1) if is_cut(text, i)), lo)
        q = next((i for i in range(mid + 1, hi) if is_cut(text, i)), hi)
        kept = len(left) - len(self._leaf(text[p:mid]))
        return left[:kept] + self._leaf(text[p:q]) + right[len(self._leaf(text[mid:q])) :]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self._bytes.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def is_cut(text: str, i: int) -> bool:
    """Whether a match must end before text[i], whatever surrounds the two characters."""
    return text[i] in " \n\t\r" and text[i - 1].isalnum()


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """One codec for each Python worker."""
    return TreeCodec(ranks_path, pattern, leaf_chars)


def _added(batch: pa.RecordBatch, keep: list[str], name: str, values: list[bytes]) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS_OUT):
        part = batch.slice(at, ROWS_OUT)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(values[at : at + ROWS_OUT], pa.binary())], names=[*keep, name])


def _with_binary(df: DataFrame, keep: list[str], name: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.BinaryType())])


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", keep: list[str] | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The columns ``keep`` (default: all) and ``ids_col``: the ids as packed little-endian unsigned 32-bit integers."""
    keep = [c for c in (df.columns if keep is None else keep) if c != ids_col]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = codec(ranks_path, pattern, leaf_chars)
        ids = [np.array(of.encode(x.decode("utf-8", "replace")), dtype="<u4").tobytes() for x in text_bytes(batch.column(text_col))]
        yield from _added(batch, keep, ids_col, ids)

    return arrow_map(df.select(*quoted([*keep, text_col])), run, _with_binary(df, keep, ids_col))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded", keep: list[str] | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The columns ``keep`` (default: all) and ``bytes_col``: the bytes that packed ids stand for."""
    keep = [c for c in (df.columns if keep is None else keep) if c != bytes_col]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = codec(ranks_path, pattern, leaf_chars)
        out = [of.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(ids_col).to_pylist()]
        yield from _added(batch, keep, bytes_col, out)

    return arrow_map(df.select(*quoted([*keep, ids_col])), run, _with_binary(df, keep, bytes_col))


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``encode`` and ``decode`` in one step: a task has one Python worker. ``keep`` must not have the two columns."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of = codec(ranks_path, pattern, leaf_chars)
        for part in slices(batch, ROWS_OUT):
            ids = [np.array(of.encode(x.decode("utf-8", "replace")), dtype="<u4").tobytes() for x in text_bytes(part.column(text_col))]
            out = [of.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=[*keep, ids_col, bytes_col])

    schema = T.StructType([*_with_binary(df, keep, ids_col), T.StructField(bytes_col, T.BinaryType())])
    return arrow_map(df.select(*quoted([*keep, text_col])), run, schema)


def unpacked(ids_col: str = "token_ids") -> Column:
    """Packed ids as ARRAY<BIGINT>."""
    size = (F.length(ids_col) / 4).cast("int")
    byte = lambda i, k: F.conv(F.hex(F.substring(F.col(ids_col), i * 4 + k, 1)), 16, 10).cast("bigint")
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: byte(i, 1) + byte(i, 2) * 256 + byte(i, 3) * 65536 + byte(i, 4) * 16777216)
    )
