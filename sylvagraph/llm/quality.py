"""Quality classifier: regularised quadratic discriminant (operator 4).

Each whole text gives transformed statistics (logs and ratios of counts of bytes, words and lines). Per class, mean and
covariance come from sums over all labelled training rows, which Spark combines before it shuffles; only these sums, of fixed
size, reach the driver. Products are summed about the mean of all rows, found first, and sums are cut to nine digits, so the order of additions
doesn't show. Covariances are those of standardised statistics, shrunk towards a multiple of the
identity; their Cholesky factors are inverted once. The score is the probability of class 1 from the
difference of the two Mahalanobis log densities with the classes' shares as priors.

Null and empty texts have zero statistics and a score like any other. Labels other than 0 and 1, null labels and
labels of ids that aren't there are left out; a document with several label rows counts once for each.
With rows of one class only, the score is that class; with none, it is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvagraph.llm.common import arrow_map, crc32_of_id, free_name, mapped, quoted, stored, text_bytes

STATISTICS = ("log bytes", "log words", "bytes a word", "log upper", "log digits", "log punctuation", "log symbols", "distinct words", "log bytes a line", "bars a word", "short words")
SHRINKAGE = 0.2

_UPPER, _LOWER, _DIGITS, _HIGH = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256))
_PUNCTUATION, _SPACE = b".,;:!?'\"()-", b" \t\n\x0b\x0c\r"


def counts_of(text: bytes) -> list[int]:
    """Bytes, words, upper, lower or non-ASCII, digits, punctuation, symbols, distinct words, lines, bars, short words."""
    n = len(text)
    words = text.split()
    upper, digits, punctuation = (n - len(text.translate(None, x)) for x in (_UPPER, _DIGITS, _PUNCTUATION))
    letters = n - len(text.translate(None, _LOWER + _HIGH))
    space = n - len(text.translate(None, _SPACE))
    lines = sum(1 for line in text.split(b"\n") if line.strip())
    short = sum(1 for w in words if len(w) <= 3)
    return [n, len(words), upper, letters, digits, punctuation, n - upper - letters - digits - punctuation - space, len(set(words)), lines, text.count(b"|"), short]


def transformed(counts: np.ndarray) -> np.ndarray:
    """One row of statistics for each row of counts."""
    n, words, upper, letters, digits, punctuation, symbols, distinct, lines, bars, short = counts.astype(np.float64).T
    some, some_words = np.maximum(n, 1), np.maximum(words, 1)
    percent = lambda x, of: np.log1p(100 * x / of)
    return np.column_stack([
        np.log1p(n), np.log1p(words), n / some_words, percent(upper, np.maximum(upper + letters, 1)), percent(digits, some), percent(punctuation, some),
        percent(symbols, some), distinct / some_words, np.log1p(n / np.maximum(lines, 1)), bars / some_words, short / some_words,
    ])


def statistics(df: DataFrame, keep: list[str], text_col: str = "text", name: str = "statistics") -> DataFrame:
    """``keep`` and the statistics of each whole text, ARRAY<DOUBLE>."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = transformed(np.array([counts_of(x) for x in text_bytes(batch.column(text_col))], dtype=np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, name])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.DoubleType()))])
    return arrow_map(df.select(*quoted([*keep, text_col])), run, schema)


@dataclass
class Discriminant:
    mean: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        logs = []
        for mean, inverse, constant in zip(self.means, self.inverses, self.constants, strict=True):
            u = inverse @ (z - mean).T
            logs.append(constant - 0.5 * (u * u).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(rows: DataFrame, label_col: str = "label", name: str = "statistics", shrinkage: float = SHRINKAGE) -> Discriminant | float:
    """A discriminant from all rows with label 0 or 1; a constant score where a class is missing."""
    d = len(STATISTICS)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    marked = rows.filter(F.col(label_col).isin(0, 1))
    x = lambda i: F.col(name)[i]
    of_class = marked.groupBy(F.col(label_col).cast("int").alias("label"))
    sums = of_class.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(x(i)) for i in range(d))).alias("mean")).collect()
    if len(sums) < 2:
        return float(sums[0].label if sums else 0.5)
    n, centre = {r.label: r.n for r in sums}, {r.label: _cut(r.mean) for r in sums}
    total = n[0] + n[1]
    mean = _cut((n[0] * centre[0] + n[1] * centre[1]) / total)
    y = lambda i: x(i) - float(mean[i])
    about = {}
    for row in of_class.agg(F.array(*(F.avg(y(i) * y(j)) for i, j in upper)).alias("second")).collect():
        about[row.label] = square = np.zeros((d, d))
        for (i, j), v in zip(upper, _cut(row.second), strict=True):
            square[i, j] = square[j, i] = v
    spread = np.sqrt(np.maximum(np.diag(n[0] * about[0] + n[1] * about[1]) / total, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, inverses, constants = [], [], []
    for k in (0, 1):
        off = centre[k] - mean
        covariance = (about[k] - np.outer(off, off)) / np.outer(scale, scale)
        covariance = (1 - shrinkage) * covariance + (shrinkage * max(np.trace(covariance) / d, 1e-6)) * np.eye(d)
        factor = np.linalg.cholesky(covariance)
        means.append(off / scale)
        inverses.append(np.linalg.inv(factor))
        constants.append(float(np.log(n[k] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(mean, scale, means, inverses, constants)


def _cut(x: np.ndarray | list[float]) -> np.ndarray:
    return np.array([float(f"{v:.9g}") for v in x])


def scored(stats: DataFrame, model: Discriminant | float, keep: list[str], name: str = "statistics", score: str = "score") -> DataFrame:
    """``keep`` and the score."""
    schema = T.StructType([*(stats.schema[c] for c in keep), T.StructField(score, T.DoubleType())])
    return mapped(stats.select(*quoted([*keep, name])), partial(_scored, model=model, keep=keep, name=name, score=score), schema)


def _scored(batches: Iterator[pa.RecordBatch], model: Discriminant | float, keep: list[str], name: str, score: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)
        found = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names=[*keep, score])


def graded(docs: DataFrame, model: Discriminant, text_col: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, from texts in one step: a task has one Python worker, and texts go to it once."""
    names = [*docs.columns, score]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = model.scores(transformed(np.array([counts_of(x) for x in text_bytes(batch.column(text_col))], dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=names)

    return arrow_map(docs, run, T.StructType([*docs.schema, T.StructField(score, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, shrinkage: float = SHRINKAGE) -> DataFrame:
    """``id_col``, held_out, score and predicted for every document. Rows whose crc32 of the id mod 4 is 2 are held out of training."""
    held = F.coalesce(crc32_of_id(id_col) % 4 == 2, F.lit(False))
    stats = stored(statistics(docs.select(id_col, text_col), [id_col], text_col))
    marked = labels.select(F.col(id_col), F.col(label_col).alias("label")).filter(~held)
    model = fit(stats.join(marked, id_col), "label", shrinkage=shrinkage)
    return scored(stats, model, [id_col]).select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, shrinkage: float = SHRINKAGE) -> DataFrame:
    """The documents scored at ``threshold`` or more, with all their columns. Without labelled rows of both classes nothing is rejected."""
    score = free_name(docs, "score")
    held = F.coalesce(crc32_of_id(id_col) % 4 == 2, F.lit(False))
    stats = stored(statistics(docs.select(id_col, text_col).filter(~held), [id_col], text_col))
    model = fit(stats.join(labels.select(F.col(id_col), F.col(label_col).alias("label")), id_col), "label", shrinkage=shrinkage)
    if isinstance(model, float):
        return docs
    return graded(docs, model, text_col, score).filter(F.col(score) >= threshold).select(*quoted(docs.columns))
