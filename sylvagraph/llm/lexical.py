"""Ranked lexical search over a tiered index (operator 12).

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A posting's impact is
``(10^9 * tf) div (1000 * tf + 8 * m)`` with ``m = 10 + (90 * n * N) div L``, a score the sum of ``w * impact`` over an item's distinct terms: 64-bit integers, exact in doubles
below 2^53.

The index is sharded by documents and tiered by impact: for each term, the postings of highest impact are in tier 0, up to ``TIER_SHARES`` of all documents, the
next ones in tier 1, the rest in the last tier; rare terms are whole in tier 0. A tier's residual is, for each term, the highest impact that lies below it. Search reads tier 0 first: partial
sums give every document a lower bound, residuals of the terms not seen yet an upper one. An item is proven when no unseen document can reach its k-th lower bound. Then only the documents
whose upper bound reaches it are completed from lower tiers. All other items fall through to the next tier; in the last one residuals are zero and sums are exact.

A shard is a row with one column a tier, so a tier that isn't asked for isn't read. Each shard scores its own documents against the items, so there are no rows for pairs: a task
gives k rows an item. Items, a stated query set, go in blocks whose terms have a
bounded number (a single longer item is a block), so what is broadcast is bounded however many items there are. Thresholds, weights and residuals have one number a term of a block.

Null and empty texts have no terms: such documents are never found, such items have no rows. Repeated rows count as documents of their own, with equal scores ordered by id, null ids last; every row of items is ranked by
itself. Without documents there are no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvagraph.llm.common import discarded, stored, text_bytes

#: Every byte that isn't part of a term becomes a space; UTF-8 bytes beyond ASCII always are.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Postings of a term in tier 0 and in tiers 0 and 1, as shares of all documents, and at least so many.
TIER_SHARES, TIER_LEAST = (0.02, 0.15), 1000
#: Terms of a block of items, items of a block, documents and postings after which a shard ends.
BLOCK_TERMS, BLOCK_ITEMS, SHARD_DOCS, SHARD_POSTINGS = 50_000, 4096, 4096, 1 << 20
#: Impacts are below 10^6; a bucket holds 2^15 of them.
BUCKET_BITS = 15
#: Cells of a shard's score matrix that are made at once.
CELLS = 1 << 22


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


# A row is a shard: ids, terms and term frequencies of its documents (those that hold terms of the items), and sums over all its documents.
FORWARD = "ids array<bigint>, lengths binary, starts binary, terms binary, tfs binary, n_docs bigint, n_terms bigint"


def forward(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) -> shards of SHARD_DOCS documents at most, with the terms of ``number``."""
    ids, lengths, starts, found, tfs, n_docs, n_terms = [], [], [0], [], [], 0, 0

    def row() -> pa.RecordBatch:
        cells = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([np.array(x, dtype=t).tobytes()], pa.binary()) for x, t in ((lengths, "<i8"), (starts, "<i8"), (found, "<i4"), (tfs, "<i4")))]
        return pa.RecordBatch.from_arrays([*cells, pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["ids", "lengths", "starts", "terms", "tfs", "n_docs", "n_terms"])

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            words = terms(text)
            if not words:
                continue
            n_docs, n_terms = n_docs + 1, n_terms + len(words)
            held = [(number[w], n) for w, n in Counter(words).items() if w in number]
            if held:
                ids.append(doc_id)
                lengths.append(len(words))
                found += [t for t, _ in held]
                tfs += [n for _, n in held]
                starts.append(len(found))
                if len(ids) == SHARD_DOCS or len(found) >= SHARD_POSTINGS:
                    yield row()
                    ids, lengths, starts, found, tfs, n_docs, n_terms = [], [], [0], [], [], 0, 0
    if n_docs:
        yield row()


class Shard:
    """The postings of one row of FORWARD, with impacts."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = row["ids"]
        self.terms, tf = np.frombuffer(row["terms"], dtype="<i4"), np.frombuffer(row["tfs"], dtype="<i4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(np.frombuffer(row["starts"], dtype="<i8")))
        # Python's integers: 90 * n * N may pass 64 bits for very long documents of a very large corpus.
        m = np.array([10 + (90 * int(x) * n) // total for x in np.frombuffer(row["lengths"], dtype="<i8")], dtype=np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])


def impact_counts(batches: Iterator[pa.RecordBatch], n: int, total: int) -> Iterator[pa.RecordBatch]:
    """Shards -> a row a term and bucket of impacts: how many postings, and the highest impact."""
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row, n, total)
            keys, place, counts = np.unique(shard.terms.astype(np.int64) << 5 | shard.impact >> BUCKET_BITS, return_inverse=True, return_counts=True)
            highest = np.zeros(len(keys), dtype=np.int64)
            np.maximum.at(highest, place, shard.impact)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 5), pa.array(keys & 31), pa.array(counts.astype(np.int64)), pa.array(highest)], names=["term", "bucket", "postings", "highest"])


TIERS = [f"tier{t}" for t in range(len(TIER_SHARES) + 1)]


def tiered(batches: Iterator[pa.RecordBatch], n: int, total: int, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Shards -> ids and one column a tier. ``floors`` (tier, term): the lowest bucket of the tier and those above."""
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row, n, total)
            tier = (shard.impact >> BUCKET_BITS < floors[:, shard.terms]).sum(axis=0)
            cells = [np.vstack([x[tier == t] for x in (shard.doc, shard.terms, shard.impact)]).astype("<i4").tobytes() for t in range(len(TIERS))]
            yield pa.RecordBatch.from_arrays([pa.array([shard.ids], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cells)], names=["ids", *TIERS])


def _postings(row: dict, tiers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, terms and impacts of some tiers of a shard."""
    return tuple(np.hstack([np.frombuffer(row[t], dtype="<i4").reshape(3, -1) for t in tiers]).astype(np.int64))


class Items:
    """The items of a block: which terms they have, and the terms' weights."""

    def __init__(self, n_items: int, term: np.ndarray, item: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.n, self.term, self.item, self.weight = n_items, term[order], item[order], weight
        self.first = np.searchsorted(self.term, np.arange(len(weight) + 1))

    def bounds(self, residual: np.ndarray) -> np.ndarray:
        """The most that a document which no tier so far has shown can score."""
        return np.bincount(self.item, weights=(self.weight * residual)[self.term], minlength=self.n)

    def scores(self, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, n_docs: int, wanted: np.ndarray) -> np.ndarray:
        """Sums of weight * value over the terms that a document and a wanted item share: a dense product for each run of terms."""
        column = np.full(self.n, -1)
        column[wanted] = np.arange(len(wanted))
        out = np.zeros((n_docs, len(wanted)))
        present, local = np.unique(terms, return_inverse=True)
        step = max(1, CELLS // max(1, n_docs + len(wanted)))
        for a in range(0, len(present), step):
            part = present[a : a + step]
            left, right = np.zeros((n_docs, len(part))), np.zeros((len(part), len(wanted)))
            here = (local >= a) & (local < a + step)
            left[docs[here], local[here] - a] = values[here]
            sizes = self.first[part + 1] - self.first[part]
            cells = np.arange(sizes.sum()) + np.repeat(self.first[part] - np.cumsum(sizes) + sizes, sizes)
            rows, to = np.repeat(np.arange(len(part)), sizes), column[self.item[cells]]
            right[rows[to >= 0], to[to >= 0]] = self.weight[part[rows[to >= 0]]]
            out += left @ right
        return out


class Best:
    """The k best documents of each item so far; scores below an item's edge aren't looked at."""

    def __init__(self, edges: np.ndarray, k: int):
        self.k, self.edges = k, np.maximum(edges, 1).astype(np.float64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, dtype=t) for t in (np.int64, np.float64, np.int64, bool))

    def add(self, items: np.ndarray, scores: np.ndarray, ids: list) -> None:
        """``scores`` (documents, items) of documents ``ids``."""
        docs, columns = np.nonzero(scores >= self.edges[items])
        if not len(docs):
            return
        null = np.array([x is None for x in ids])
        number = np.array([x or 0 for x in ids], dtype=np.int64)
        item = np.concatenate((self.item, items[columns]))
        score, doc, null = np.concatenate((self.score, scores[docs, columns])), np.concatenate((self.doc, number[docs])), np.concatenate((self.null, null[docs]))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        starts = np.flatnonzero(np.append(True, np.diff(item) != 0))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
        full = rank == self.k - 1
        self.edges[item[full]] = score[full]
        top = rank < self.k
        self.item, self.score, self.doc, self.null = item[top], score[top], doc[top], null[top]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.item), pa.array(self.doc, mask=self.null), pa.array(self.score.astype(np.int64))], names=["item", "doc_id", "score"])


BEST = "item bigint, doc_id bigint, score bigint"


def _parts(wanted: np.ndarray, n_docs: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, n_docs))
    return (wanted[a : a + step] for a in range(0, len(wanted), step))


def lower_bounds(batches: Iterator[pa.RecordBatch], items: Items, wanted: np.ndarray, edges: np.ndarray, tiers: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """Shards -> for each wanted item the k highest sums over ``tiers``."""
    best = Best(edges, k)
    for batch in batches:
        for row in batch.to_pylist():
            docs, terms, impacts = _postings(row, tiers)
            for part in _parts(wanted, len(row["ids"])):
                best.add(part, items.scores(docs, terms, impacts, len(row["ids"]), part), row["ids"])
    yield best.rows()


def completed(batches: Iterator[pa.RecordBatch], items: Items, proven: list[tuple[np.ndarray, np.ndarray]], edges: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Shards with all tiers -> the k best of each item. ``proven``: for each tier but the last the items proven there and the residuals below it; all others are open.

    A proven item's documents are added up only where their upper bound reaches the item's edge.
    """
    best = Best(edges, k)
    done = np.concatenate([i for i, _ in proven])
    for batch in batches:
        for row in batch.to_pylist():
            ids = row["ids"]
            for t, (wanted, residual) in enumerate(proven):
                bounds = items.bounds(residual)
                docs, terms, impacts = _postings(row, TIERS[: t + 1])
                more_docs, more_terms, more_impacts = _postings(row, TIERS[t + 1 :])
                for part in _parts(wanted, len(ids)):
                    low = items.scores(docs, terms, impacts, len(ids), part)
                    known = items.scores(docs, terms, residual[terms], len(ids), part)
                    reach = (low > 0) & (low + bounds[part] - known >= best.edges[part])
                    rows = np.flatnonzero(reach.any(axis=1))
                    at = np.full(len(ids), -1)
                    at[rows] = np.arange(len(rows))
                    here = at[more_docs] >= 0
                    exact = low[rows] + items.scores(at[more_docs[here]], more_terms[here], more_impacts[here], len(rows), part)
                    best.add(part, np.where(reach[rows], exact, 0), [ids[r] for r in rows.tolist()])
            docs, terms, impacts = _postings(row, TIERS)
            for part in _parts(np.setdiff1d(np.arange(items.n), done), len(ids)):
                best.add(part, items.scores(docs, terms, impacts, len(ids), part), ids)
    yield best.rows()


def _edges(found: DataFrame, n_items: int, k: int) -> np.ndarray:
    """The k-th highest score of each item, 0 where there are fewer: one number an item of a block."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    rows = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).filter(F.col("rank") == k).select("item", "score").collect()
    edges = np.zeros(n_items, dtype=np.int64)
    for row in rows:
        edges[row.item] = row.score
    return edges


class Index:
    """The tiered index of documents for the terms of one block of items."""

    def __init__(self, docs: DataFrame, number: dict[bytes, int]):
        context = docs.sparkSession.sparkContext
        shared = context.broadcast(number)
        first = stored(docs.mapInArrow(lambda batches: forward(batches, shared.value), FORWARD))
        sums = first.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
        self.n, self.total = int(sums.n or 0), int(sums.total or 0)
        filled = first.select("ids", "lengths", "starts", "terms", "tfs").filter(F.size("ids") > 0)
        counts = filled.mapInArrow(partial(impact_counts, n=self.n, total=self.total), "term bigint, bucket bigint, postings bigint, highest bigint")
        summed = counts.groupBy("term", "bucket").agg(F.sum("postings").alias("postings"), F.max("highest").alias("highest"))
        down = Window.partitionBy("term").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        caps = [max(TIER_LEAST, int(share * self.n)) for share in TIER_SHARES]
        ranked = summed.withColumn("upto", F.sum("postings").over(down))
        floors = [F.coalesce(F.min(F.when(F.col("upto") <= cap, F.col("bucket"))), F.lit(32)).alias(f"floor{t}") for t, cap in enumerate(caps)]
        below = [F.coalesce(F.max(F.when(F.col("upto") > cap, F.col("highest"))), F.lit(0)).alias(f"below{t}") for t, cap in enumerate(caps)]
        self.df = np.zeros(len(number), dtype=np.int64)
        self.floors, self.residuals = (np.zeros((len(caps), len(number)), dtype=np.int64) for _ in range(2))
        for row in ranked.groupBy("term").agg(F.sum("postings").alias("df"), *floors, *below).collect():  # one row a term of the block
            self.df[row.term] = row.df
            for t in range(len(caps)):
                self.floors[t, row.term], self.residuals[t, row.term] = row[f"floor{t}"], row[f"below{t}"]
        table = context.broadcast(self.floors)
        n, total = self.n, self.total
        schema = "ids array<bigint>, " + ", ".join(f"{t} binary" for t in TIERS)
        self.shards = stored(filled.mapInArrow(lambda batches: tiered(batches, n, total, table.value), schema))
        discarded(first)

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1))) if df else 0 for df in self.df.tolist()], dtype=np.int64)

    def search(self, n_items: int, term: np.ndarray, item: np.ndarray, k: int) -> tuple[DataFrame, list[int]]:
        """(item, doc_id, score), some rows more than k an item, and how many items each tier proves."""
        items = Items(n_items, term, item, self.weights())
        shared = self.shards.sparkSession.sparkContext.broadcast(items)
        edges, wanted, proven = np.zeros(n_items, dtype=np.int64), np.arange(n_items), []
        for t, residual in enumerate(self.residuals):
            tiers, edge, now = TIERS[: t + 1], edges.copy(), wanted
            run = lambda batches, tiers=tiers, edge=edge, now=now: lower_bounds(batches, shared.value, now, edge, tiers, k)
            found = _edges(self.shards.select("ids", *tiers).mapInArrow(run, BEST), n_items, k)
            edges = np.maximum(edges, found)
            # No document beyond these tiers can reach the k-th best of them.
            good = items.bounds(residual)[wanted] < edges[wanted]
            proven.append((wanted[good], residual))
            wanted = wanted[~good]
        last = lambda batches: completed(batches, shared.value, proven, edges, k)
        return self.shards.mapInArrow(last, BEST), [*(len(i) for i, _ in proven), len(wanted)]


def _blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, dict[bytes, int], np.ndarray, np.ndarray]]:
    """Items in blocks: their ids, numbers of the block's terms, and (term, item) pairs. Items come to the driver partition by partition."""
    ids, number, term, item = [], {}, [], []
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).toLocalIterator():
        own = dict.fromkeys(terms(bytes(row.text or b"")))
        if ids and (len(ids) == BLOCK_ITEMS or len(number) + len(own) > BLOCK_TERMS):
            yield ids, number, np.array(term, dtype=np.int64), np.array(item, dtype=np.int64)
            ids, number, term, item = [], {}, [], []
        for w in own:
            term.append(number.setdefault(w, len(number)))
            item.append(len(ids))
        ids.append(row.id)
    if ids:
        yield ids, number, np.array(term, dtype=np.int64), np.array(item, dtype=np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` documents of the highest scores above 0 of each item."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for ids, number, term, item in _blocks(spark, items, item_col, text_col):
        found, _ = Index(corpus, number).search(len(ids), term, item, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {kind}")  # a block's
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
