"""Brown class-based bigram language model (operator 9).

Tokens: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end. Classes come from exchange clustering in two steps. First, word groups, which are a pure
function of a word's bytes (a hash of the whole word for short words, which are the frequent ones, of its first and last two bytes for longer
ones), move between classes as long as the class bigram likelihood of the training text grows: their bigrams are a matrix of fixed size. Then every word that some block has
``OWN_COUNT`` times moves on its own, to the class where the likelihood gains most from all words that stand before and after it in training, given the
table of the first step. These counts grow with the vocabulary and stay in Spark. Rarer words have their group's class.
With ``rounds`` (operator 9 has them), rounds of exchange over single words take the place of that one move. In each, every word that training has
``OWN_COUNT`` times, in all blocks together, goes to the class where the class bigram likelihood of the training text is largest, all other words in their places: by its
neighbours' present classes and the table that these give, counted anew over the texts. Words move side by side, as in distributed exchange
(Uszkoreit and Brants, 2008), so a round that lowers the likelihood is taken back and is the last.
P(w | v) = P(class w | class v) * P(w | class w); transitions are counted anew with all words' classes and
smoothed towards the classes' shares, emissions by half a count for every word of the class and one unseen one.

The texts are tokenised once and filed, as numbers of their words, in blocks of bounded size with the words that each block has, their training counts and neighbours. These are summed over all
blocks, and counts and classes handed back to the blocks that have the word, so no task holds the vocabulary. A word has one row a block at most, so the most frequent one has as
many rows as there are blocks. Each block is then coded: sums of emissions, and one byte a token for its class. Last, transitions are added from the codes. What comes to the
driver has a fixed size: the matrix of groups, and sums by class and by pairs of classes.

Null and empty texts have the end token alone. Rows whose id is null count as training rows. Repeated rows count as often as they
occur. Without training texts every probability is that of an unseen word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.llm.common import crc32_of_id, discarded, stored, text_bytes

#: Word groups: the end, then those of short words, then those of longer words.
SHORT_BYTES, SHORT_GROUPS, LONG_GROUPS = 5, 768, 255
GROUPS = 1 + SHORT_GROUPS + LONG_GROUPS
#: At most 256, for a class is a byte.
CLASSES = 64
BLOCK_BYTES = 16 << 20
BLOCK_WORDS = 200_000
#: No word has white space, so a space can stand for the end.
END = b" "
WORD, MATRIX, SUMS, KNOWN, KEPT, MOVED = range(6)
#: A block gives the neighbours of words that it has so many times.
OWN_COUNT = 4
#: A neighbour: its group (one that follows has GROUPS more) and how often.
NEIGHBOUR = np.dtype([("group", "<u2"), ("n", "<u4")])
#: Rounds of operator 9 over single words.
ROUNDS = 2


def group_of(word: bytes) -> int:
    if word == END:
        return 0
    if len(word) <= SHORT_BYTES:
        return 1 + zlib.crc32(word) % SHORT_GROUPS
    return 1 + SHORT_GROUPS + zlib.crc32(word[:2] + word[-2:]) % LONG_GROUPS


class Numbered(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Texts go on in chunks of at most so many documents, words in chunks of at most so many.
CHUNK_DOCS, CHUNK_WORDS = 250, 1 << 18

# One schema holds words, rows of the matrix and chunks, so one pass can yield all of them.
# A word's number is its place among its block's words; word is its number among all words, which the sums give.
# WORD: payload, n, number, other (its neighbours). MATRIX: n, payload. KEPT: payload (numbers of all words and ends), n (how many), numbers (ids), held.
# MOVED: payload (words' numbers), n (how many), other (their classes). In rounds, a WORD has word for payload, n is its class and its neighbours are classes.
# KNOWN: payload (words' numbers, words, counts), n (how many), other (their classes, a byte each). SUMS: block (the class), n (tokens), numbers (words).
SCHEMA = "kind int, block bigint, payload binary, n bigint, numbers array<bigint>, held array<boolean>, other binary, word bigint, number bigint"


def _rows(kind: int, blocks: list | np.ndarray, payload: list[bytes] | None, n: list | np.ndarray, numbers: list | None = None, held: list | None = None, other: list | pa.Array | None = None, word: np.ndarray | None = None, number: np.ndarray | None = None) -> pa.RecordBatch:
    size = len(n)
    column = lambda x, kind: pa.nulls(size, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(size, kind, dtype=np.int32)),
            column(blocks, pa.int64()),
            column(payload, pa.binary()),
            column(n, pa.int64()),
            column(numbers, pa.list_(pa.int64())),
            column(held, pa.list_(pa.bool_())),
            column(other, pa.binary()),
            column(word, pa.int64()),
            column(number, pa.int64()),
        ],
        names=["kind", "block", "payload", "n", "numbers", "held", "other", "word", "number"],
    )


def _packed(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpacked(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _packed_ints(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed: of each, the lowest byte of all integers, then the next one."""
    return _packed(b"".join(x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in columns))


def _unpacked_ints(x: bytes, size: int, *kinds: str) -> list[np.ndarray]:
    data, out, at = np.frombuffer(_unpacked(x), dtype=np.uint8), [], 0
    for kind in map(np.dtype, kinds):
        part = data[at : at + size * kind.itemsize].reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(size))
        at += part.size
    return out


def _joined(near: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The neighbours between each two of ``edges`` as a value."""
    mine = near[edges[0] : edges[-1]]
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(((edges - edges[0]) * NEIGHBOUR.itemsize).astype(np.int32).tobytes()), pa.py_buffer(mine.tobytes())])


def _split(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours each value has, and the neighbours of all."""
    sizes, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=NEIGHBOUR)]
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, dtype=np.int32)
        sizes.append(np.diff(offsets) // NEIGHBOUR.itemsize)
        if offsets[-1] > offsets[0]:
            found.append(np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(NEIGHBOUR))
    return np.concatenate(sizes), np.concatenate(found)


def first_pass(batches: Iterator[pa.RecordBatch], near: bool = True) -> Iterator[pa.RecordBatch]:
    """doc_id, text, held -> chunks of the texts by blocks, each block's words with their training counts and (if ``near``) neighbours, and rows of the matrix."""
    block = TaskContext.get().partitionId() << 24
    matrix = np.zeros(GROUPS * GROUPS, dtype=np.int64)
    numbers, counts, groups, used = Numbered({END: 0}), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0
    trained: list[np.ndarray] = []

    def words() -> Iterator[pa.RecordBatch]:
        names, n = list(numbers), counts.tolist()
        if not near:
            for at in range(0, len(names), 1 << 16):
                part = names[at : at + (1 << 16)]
                yield _rows(WORD, [block] * len(part), part, n[at : at + (1 << 16)], number=np.arange(at, at + len(part)))
            return
        ends, found = neighbours(np.concatenate(trained), counts, groups)
        for at in range(0, len(names), 1 << 16):
            part = names[at : at + (1 << 16)]
            other = _joined(found, ends[at : at + len(part) + 1])
            yield _rows(WORD, [block] * len(part), part, n[at : at + (1 << 16)], other=other, number=np.arange(at, at + len(part)))

    some = False
    for batch in batches:
        for part in (batch.slice(at, CHUNK_DOCS) for at in range(0, batch.num_rows, CHUNK_DOCS)):
            some = True
            held = part.column("held").to_pylist()
            ids, ends = [], [0]
            for text in text_bytes(part.column("text")):
                used += len(text)
                ids += map(numbers.__getitem__, text.lower().split())
                ids.append(0)
                ends.append(len(ids))
            if len(numbers) > len(counts):
                new = list(numbers)[len(counts) :]
                groups = np.concatenate((groups, np.fromiter(map(group_of, new), dtype=np.int64, count=len(new))))
                counts = np.concatenate((counts, np.zeros(len(new), dtype=np.int64)))
            tokens = np.array(ids, dtype=np.int32)
            seen = np.concatenate(([0], tokens[np.repeat(~np.array(held, dtype=bool), np.diff(ends))]))
            trained.append(seen.astype(np.int32) if near else seen[:0])
            counts += np.bincount(seen[1:], minlength=len(counts))
            of = groups[seen]
            matrix += np.bincount(of[:-1] * GROUPS + of[1:], minlength=len(matrix))
            yield _rows(KEPT, [block], [_packed_ints(tokens)], [len(tokens)], [part.column("doc_id").to_pylist()], [held])
            if used >= BLOCK_BYTES or len(numbers) >= BLOCK_WORDS:
                yield from words()
                block += 1
                trained.clear()
                numbers, counts, groups, used = Numbered({END: 0}), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0
    if trained:  # the last chunk may have ended a block
        yield from words()
    if some:
        rows = matrix.reshape(GROUPS, GROUPS).astype("<i8")
        at = np.flatnonzero(rows.any(axis=1)).tolist()
        yield _rows(MATRIX, [0] * len(at), [_packed(rows[g].tobytes()) for g in at], at)


def neighbours(seen: np.ndarray, counts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of training tokens (numbers of words; 0, the end, first and after each text): the neighbours of the words that occur OWN_COUNT times, by
    words, and where each word's begin."""
    own = counts >= OWN_COUNT
    own[0] = False
    at = np.flatnonzero(own[seen])
    word = seen[at].astype(np.int64) * (2 * GROUPS)
    keys, n = np.unique(np.concatenate((word + groups[seen[at - 1]], word + GROUPS + groups[seen[np.minimum(at + 1, len(seen) - 1)]])), return_counts=True)
    near = np.empty(len(keys), dtype=NEIGHBOUR)
    near["group"], near["n"] = keys % (2 * GROUPS), n
    return np.searchsorted(keys, np.arange(len(counts) + 1) * (2 * GROUPS)), near


def _whole_words(batches: Iterator[pa.RecordBatch], word: str) -> Iterator[pa.Table]:
    """Rows in the order of words as tables that have all rows of their words."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        words = table.column(word)
        # The last word may go on in the next batch.
        last = pc.equal(words, words[-1]).to_numpy()
        at = len(last) - int(last[::-1].cumprod().sum())
        left = table.slice(at)
        if at:
            yield table.slice(0, at)
    if left is not None:
        yield left


def _by_blocks(kept: dict[int, tuple[list[np.ndarray], ...]], blocks: np.ndarray, *columns: np.ndarray) -> None:
    """Adds the rows of each block to its lists in ``kept``, in the order that they have."""
    order = np.argsort(blocks, kind="stable")
    blocks, columns = blocks[order], [x[order] for x in columns]
    edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for a, b in zip(edges, edges[1:], strict=False):
        for part, x in zip(kept.setdefault(int(blocks[a]), tuple([] for _ in columns)), columns, strict=True):
            part.append(x[a:b])


def sum_words(batches: Iterator[pa.RecordBatch], shape: Broadcast) -> Iterator[pa.RecordBatch]:
    """block, number, payload, n, other in the order of words, all rows of a word together -> chunks of each block's words with their sums and classes, and sums by classes."""
    shape, following = shape.value, TaskContext.get().partitionId() << 40
    tokens, kinds = np.zeros(shape.classes, dtype=np.int64), np.zeros(shape.classes, dtype=np.int64)
    kept: dict[int, tuple[list[np.ndarray], ...]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block, parts in kept.items():
            numbers, ids, sums, classes = map(np.concatenate, parts)
            # Words ascend, so their differences are small.
            yield _rows(KNOWN, [block], [_packed_ints(numbers, np.diff(ids, prepend=0), sums)], [len(numbers)], other=[classes.tobytes()])
        kept.clear()

    def add(table: pa.Table) -> int:
        words = table.column("payload").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        fresh = np.concatenate(([True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(fresh)
        sums = np.add.reduceat(table.column("n").to_numpy(), at)
        of = np.fromiter((group_of(w) for w in words.take(pa.array(at)).to_pylist()), dtype=np.int64, count=len(at))
        rows_of = np.diff(np.append(at, len(fresh)))
        of = shape.class_of(of, np.repeat(np.arange(len(at)), rows_of), table.column("other"))
        np.add.at(tokens, of, sums)
        np.add.at(kinds, of, sums > 0)
        ids = np.repeat(following + np.arange(len(at)), rows_of)
        _by_blocks(kept, table.column("block").to_numpy(), table.column("number").to_numpy().astype(np.int32), ids, np.repeat(sums, rows_of), np.repeat(of.astype(np.uint8), rows_of))
        return len(at)

    some = False
    for table in _whole_words(batches, "payload"):
        some = True
        following += add(table)
        size += table.num_rows
        if size >= CHUNK_WORDS:
            yield from flush()
            size = 0
    if some:
        yield from flush()
        at = np.flatnonzero(kinds)
        yield _rows(SUMS, at.tolist(), [b""] * len(at), tokens[at].tolist(), [[k] for k in kinds[at].tolist()])


def _summed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrix rows (n: the group) summed within a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for group, row in zip(batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            found = np.frombuffer(_unpacked(row), dtype="<i8")
            total[group] = total[group] + found if group in total else found
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([_packed(x.tobytes()) for x in total.values()], pa.binary())], names=["n", "payload"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """The class of each group. Group 0, the end, keeps class 0 for itself; groups without training tokens go to class 1.

    Each round visits the groups by falling frequency and moves one to the class where
    sum N(a,b) log N(a,b) - sum N(a) log N(a) (left) - sum N(b) log N(b) (right) is largest.
    """
    counts = bigrams.astype(np.float64)
    right, left = counts.sum(axis=1), counts.sum(axis=0)
    weight = left
    order = [g for g in np.argsort(-weight, kind="stable").tolist() if g and weight[g] + right[g] > 0]
    of = np.ones(len(counts), dtype=np.int64)
    of[0] = 0
    for i, g in enumerate(order):
        of[g] = 1 + i % (classes - 1)
    member = np.zeros((len(counts), classes))
    member[np.arange(len(counts)), of] = 1
    idle = np.ones(len(counts), dtype=bool)
    idle[[0, *order]] = False
    member[idle] = 0
    out_to, in_from = counts @ member, counts.T @ member  # group -> class after it, class before it
    table = member.T @ out_to
    n_left, n_right = table.sum(axis=1), table.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for g in order:
            a = of[g]
            own, o, i = counts[g, g], out_to[g].copy(), in_from[g].copy()
            o[a] -= own
            i[a] -= own
            # Take g out of its class.
            table[a] -= o
            table[:, a] -= i
            table[a, a] -= own
            n_left[a] -= right[g]
            n_right[a] -= left[g]
            # The gain of putting it into each class b: row b gains o, column b gains i, cell (b, b) also own.
            gain = (_xlogx(table + o) - _xlogx(table)).sum(axis=1) + (_xlogx(table + i[:, None]) - _xlogx(table)).sum(axis=0)
            d = np.diagonal(table)
            gain += _xlogx(d + o + i + own) - _xlogx(d + o) - _xlogx(d + i) + _xlogx(d)
            gain -= _xlogx(n_left + right[g]) - _xlogx(n_left) + _xlogx(n_right + left[g]) - _xlogx(n_right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b] += o
            table[:, b] += i
            table[b, b] += own
            n_left[b] += right[g]
            n_right[b] += left[g]
            if b != a:
                moved += 1
                of[g] = b
                for to, by in ((out_to, counts[:, g]), (in_from, counts[g])):
                    to[:, a] -= by
                    to[:, b] += by
        if not moved:
            break
    return of


class Shape:
    """Classes of groups, and the gain of putting a word into a class for each token of another class before or after it."""

    def __init__(self, bigrams: np.ndarray, classes: int = CLASSES, near: bool = True):
        self.classes, self.near = classes, near
        self.of = exchange(bigrams, classes)
        member = np.zeros((GROUPS, classes))
        member[np.arange(GROUPS), self.of] = 1
        table = member.T @ bigrams @ member
        expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / max(table.sum(), 1)
        self.gain = np.log((table + 1) / (expected + 1))

    def class_of(self, groups: np.ndarray, word: np.ndarray, other: pa.ChunkedArray) -> np.ndarray:
        """The class of each word: of its group, or by its neighbours. ``other`` has a row for each of ``word``, which numbers the words."""
        out = self.of[groups]
        if not self.near:
            return out
        near = np.zeros((len(groups), 2 * self.classes))
        sizes, found = _split(other)
        after = found["group"] >= GROUPS
        np.add.at(near, (np.repeat(word, sizes), self.of[found["group"] % GROUPS] + self.classes * after), found["n"])
        own = np.flatnonzero(near.any(axis=1))
        total = near[own, : self.classes] @ self.gain + near[own, self.classes :] @ self.gain.T
        total[:, 0] = -np.inf  # the end's
        out[own] = np.argmax(total, axis=1)
        return out


class Model:
    """Emissions, and log10 transitions once they are counted."""

    def __init__(self, tokens: np.ndarray, kinds: np.ndarray):
        self.tokens, self.kinds = tokens, kinds
        self.n_total, self.n_kinds = int(tokens.sum()), int(kinds.sum())

    def emission(self, of_word: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.log10((c + 0.5) / (self.tokens[of_word] + 0.5 * (self.kinds[of_word] + 1)))
        return np.where(of_word == 0, 0.0, out)  # the end's class has nothing else

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n_total + 0.5 * (self.n_kinds + 1)))

    def transitions(self, table: np.ndarray) -> np.ndarray:
        share = (self.tokens + 0.5) / (self.tokens.sum() + 0.5 * len(self.tokens))
        return np.log10((table + 2.0 * share) / (table.sum(axis=1, keepdims=True) + 2.0))


# A row is a chunk of documents with one class byte a token, or a task's training bigrams of classes.
CODED = "doc_ids array<bigint>, held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, emission array<double>, classes binary, bigrams array<bigint>"


def _coded_row(*values: object) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64())]
    names = ["doc_ids", "held", "n_tokens", "n_known", "base", "emission", "classes", "bigrams"]
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=names)


def _before(classes: np.ndarray) -> np.ndarray:
    """The class (or number) before each token; each text begins after an end, which has class and number 0."""
    return np.concatenate((np.zeros(1, dtype=classes.dtype), classes[:-1]))


class Words:
    """The words of a block by their numbers: words, training counts in all blocks, classes."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.moves: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, part: pa.RecordBatch) -> None:
        for data, n, of in zip(*(part.column(c).to_pylist() for c in ("payload", "n", "other")), strict=True):
            numbers, steps, sums = _unpacked_ints(data, n, "<i4", "<i8", "<i8")
            self.parts.append((numbers, np.cumsum(steps), sums, np.frombuffer(of, dtype=np.uint8)))

    def move(self, part: pa.RecordBatch) -> None:
        for data, n, of in zip(*(part.column(c).to_pylist() for c in ("payload", "n", "other")), strict=True):
            self.moves.append((_unpacked_ints(data, n, "<i4")[0], np.frombuffer(of, dtype=np.uint8)))

    def close(self) -> None:
        numbers, *columns = map(np.concatenate, zip(*self.parts, strict=True))
        order = np.argsort(numbers)
        self.ids, self.counts, self.classes = (x[order] for x in columns)
        for at, of in self.moves:
            self.classes[at] = of
        self.parts, self.moves = [], []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows by block, the words of a block before its texts -> (Words, the block's number) and then, for each of its chunks, (ids of texts, (numbers of all words and ends, held))."""
    block, words, closed = None, None, False
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            if blocks[a] != block:
                block, words, closed = blocks[a], Words(), False
            if kinds[a] == KNOWN:
                words.add(part)
                continue
            if kinds[a] == MOVED:
                words.move(part)
                continue
            if not closed:
                words.close()
                closed = True
                yield words, int(block)
            for tokens, n, doc_ids, held in zip(*(part.column(c).to_pylist() for c in ("payload", "n", "numbers", "held")), strict=True):
                yield doc_ids, (_unpacked_ints(tokens, n, "<i4")[0].astype(np.int64), held)


def recounted(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Rows as of ``_blocks`` -> each block's words of OWN_COUNT or more with their classes and neighbours (classes before, after, and how often itself), and rows of the table."""
    codes = 2 * classes + 1
    table = np.zeros(classes * classes, dtype=np.int64)
    words, block, keys = None, 0, []

    def flush() -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        near = np.empty(len(found), dtype=NEIGHBOUR)
        near["group"], near["n"] = found % codes, n
        mine, starts = np.unique(found // codes, return_index=True)
        edges = np.append(starts, len(found))
        for at in range(0, len(mine), 1 << 16):
            part = mine[at : at + (1 << 16)]
            yield _rows(WORD, np.full(len(part), block), None, words.classes[part], other=_joined(near, edges[at : at + len(part) + 1]), word=words.ids[part], number=part)

    for at, chunk in _blocks(batches):
        if isinstance(at, Words):
            if words is not None:
                yield from flush()
            words, block, keys = at, chunk, []
            own = words.counts >= OWN_COUNT
            own[0] = False
            continue
        seen, held = chunk
        last = _before(seen)
        starts = np.flatnonzero(last == 0)
        # An empty text begins and ends at once, so each text has one end, and one start after an end.
        train = np.repeat(~np.array(held, dtype=bool), np.diff(np.append(starts, len(seen))))
        v, w = last[train], seen[train]
        of_v, of_w = words.classes[v].astype(np.int64), words.classes[w].astype(np.int64)
        table += np.bincount(of_v * classes + of_w, minlength=len(table))
        same, here, there = v == w, own[w], own[v] & (v != w)
        keys += [w[here] * codes + np.where(same, 2 * classes, of_v)[here], v[there] * codes + classes + of_w[there]]
    if words is not None:
        yield from flush()
        yield _rows(MATRIX, [0] * classes, [_packed(row.tobytes()) for row in table.reshape(classes, classes).astype("<i8")], list(range(classes)))


def likelihood(table: np.ndarray) -> float:
    """Of a text's classes, but for what doesn't depend on them: its table of class bigrams."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def best_classes(table: np.ndarray, of: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of each word where the likelihood is largest, from ``of``: by how often which class stands before and after it, itself (``own``) apart. As in ``exchange``."""
    out, known, rows = of.copy(), _xlogx(table), 256
    for at in range(0, len(of), rows):
        a, i, o, x = of[at : at + rows], before[at : at + rows], after[at : at + rows], own[at : at + rows]
        r = np.arange(len(a))
        left, right, d = (np.repeat(y[None], len(a), axis=0) for y in (table.sum(axis=1), table.sum(axis=0), np.diagonal(table)))
        # Take each word out of its class.
        n_o, n_i = o.sum(axis=1) + x, i.sum(axis=1) + x
        left[r, a] -= n_o
        right[r, a] -= n_i
        d[r, a] -= o[r, a] + i[r, a] + x
        gain = _row_gain(table, known, a, o, i, x) + _row_gain(table.T, known.T, a, i, o, x)
        gain += _xlogx(d + o + i + x[:, None]) - _xlogx(d + o) - _xlogx(d + i) + _xlogx(d)
        gain -= _xlogx(left + n_o[:, None]) - _xlogx(left) + _xlogx(right + n_i[:, None]) - _xlogx(right)
        gain[:, 0] = -np.inf  # the end's
        b = np.argmax(gain, axis=1)
        out[at : at + rows] = np.where(gain[r, b] > gain[r, a] + 1e-6, b, a)
    return out


def _row_gain(table: np.ndarray, known: np.ndarray, a: np.ndarray, o: np.ndarray, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each word and class, what the class's row gains by the word's ``o``, once the word is out of its class ``a``; only cells that have something are looked at. ``known``: xlogx of the table."""
    w, c = np.nonzero(o)
    n, mine, e = o[w, c], a[w], np.arange(len(w))
    now, was = table.T[c], known.T[c]
    now[e, mine] -= n
    column = np.flatnonzero(c == mine)
    now[column] -= i[w[column]]
    now[column, mine[column]] -= x[w[column]]
    was[e, mine] = _xlogx(now[e, mine])
    was[column] = _xlogx(now[column])
    gain = np.zeros(o.shape)
    if len(w):
        rows, starts = np.unique(w, return_index=True)
        gain[rows] = np.add.reduceat(_xlogx(now + n[:, None]) - was, starts)
    return gain


def moved_words(batches: Iterator[pa.RecordBatch], table: Broadcast) -> Iterator[pa.RecordBatch]:
    """block, word, number, n, other of ``recounted`` in the order of words -> the words' classes by blocks, and how sums by classes change."""
    table = table.value
    classes = len(table)
    tokens, kinds = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
    kept: dict[int, tuple[list[np.ndarray], ...]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block, parts in kept.items():
            numbers, of = map(np.concatenate, parts)
            yield _rows(MOVED, [block], [_packed_ints(numbers)], [len(numbers)], other=[of.tobytes()])
        kept.clear()

    for rows in _whole_words(batches, "word"):
        words = rows.column("word").to_numpy()
        fresh = np.concatenate(([True], words[1:] != words[:-1]))
        of_row, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        sizes, found = _split(rows.column("other"))
        cell = np.repeat(of_row, sizes) * (2 * classes + 1) + found["group"]
        near = np.bincount(cell, weights=found["n"], minlength=len(at) * (2 * classes + 1)).reshape(len(at), -1)
        old = rows.column("n").to_numpy()[at]
        before, after, own = near[:, :classes], near[:, classes:-1], near[:, -1]
        new = best_classes(table, old, before, after, own)
        n = (before.sum(axis=1) + own).astype(np.int64)
        for of, sign in ((old, -1), (new, 1)):
            np.add.at(tokens, of, sign * n)
            np.add.at(kinds, of, sign * (n > 0))
        _by_blocks(kept, rows.column("block").to_numpy(), rows.column("number").to_numpy().astype(np.int32), new[of_row].astype(np.uint8))
        size += len(words)
        if size >= CHUNK_WORDS:
            yield from flush()
            size = 0
    yield from flush()
    at = np.flatnonzero((tokens != 0) | (kinds != 0))
    if len(at):
        yield _rows(SUMS, at.tolist(), [b""] * len(at), tokens[at].tolist(), [[k] for k in kinds[at].tolist()])


def coded(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows by block, the words of a block before its texts -> CODED."""
    model = model.value
    size = len(model.tokens)
    table = np.zeros(size * size, dtype=np.int64)
    ready = None
    for at, chunk in _blocks(batches):
        if isinstance(at, Words):
            c = at.counts
            ready = at.classes, model.emission(at.classes, c), model.base(c), (c > 0).astype(np.int64)
            continue
        of, emit, base, known = ready
        seen, held = chunk
        k, starts = of[seen], np.flatnonzero(_before(seen) == 0)
        n = np.diff(np.append(starts, len(seen)))
        train = np.repeat(~np.array(held, dtype=bool), n)
        table += np.bincount((_before(k).astype(np.int64) * size + k)[train], minlength=len(table))
        total = lambda x: np.add.reduceat(x[seen], starts)  # noqa: B023, E731
        yield _coded_row(at, held, n, total(known), total(base), total(emit), _packed(k.tobytes()), None)
    if ready is not None:
        yield _coded_row(None, None, None, None, None, None, None, table)


SCORED_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def scored(batches: Iterator[pa.RecordBatch], transition: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in ("doc_ids", "held", "n_tokens", "n_known", "base", "emission")}
            n, k = row["n_tokens"].values.to_numpy(), np.frombuffer(_unpacked(batch.column("classes")[i].as_py()), dtype=np.uint8)
            moves = np.add.reduceat(transition[_before(k), k], np.cumsum(n) - n)
            score = pa.array(row["emission"].values.to_numpy() + moves)
            yield pa.RecordBatch.from_arrays([*(row[c].values for c in ("doc_ids", "held", "n_tokens", "n_known", "base")), score], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _matrix(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of MATRIX rows."""
    out = np.zeros((size, size))
    summed = rows.filter(F.col("kind") == MATRIX).select("n", "payload").repartition(F.col("n")).mapInArrow(_summed_rows, "n bigint, payload binary")
    for row in summed.collect():  # ``size`` rows, whatever the corpus
        out[row.n] += np.frombuffer(_unpacked(row.payload), dtype="<i8")
    return out


def _sums(rows: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words by classes, of SUMS rows."""
    tokens, kinds = np.zeros(classes), np.zeros(classes)
    sums = rows.filter(F.col("kind") == SUMS).groupBy("block").agg(F.sum("n").alias("tokens"), F.sum(F.col("numbers")[0]).alias("kinds"))
    for row in sums.collect():  # one row a class
        tokens[row.block], kinds[row.block] = row.tokens, row.kinds
    return tokens, kinds


def fit_and_score(df: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rounds: int = 0) -> DataFrame:
    """Learns from the rows where ``held_out`` is false (default: crc32 of the id mod 5 is not 1) and scores all. ``rounds``: of exchange over single words, at most.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score: log10 probabilities of whole texts.
    """
    context = df.sparkSession.sparkContext
    out = crc32_of_id(id_col) % 5 == 1 if held_out is None else held_out
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(out, F.lit(False)).alias("held"))
    first = stored(docs.mapInArrow(partial(first_pass, near=not rounds), SCHEMA), release=True)
    bigrams = _matrix(first, GROUPS)

    words = first.filter(F.col("kind") == WORD).select("block", "number", "payload", "n", "other")
    shape = context.broadcast(Shape(bigrams, classes, near=not rounds))
    second = stored(words.repartition(F.col("payload")).sortWithinPartitions("payload").mapInArrow(partial(sum_words, shape=shape), SCHEMA), release=True)
    tokens, kinds = _sums(second, classes)
    chunks = second.filter(F.col("kind") == KNOWN).unionByName(first.filter(F.col("kind") == KEPT))

    def by_block(moved: DataFrame | None) -> DataFrame:
        rows = chunks if moved is None else chunks.unionByName(moved.filter(F.col("kind") == MOVED))
        # The words' classes, then those of the last round, then texts.
        return rows.repartition(F.col("block")).sortWithinPartitions("block", F.when(F.col("kind") == KEPT, MOVED + 1).otherwise(F.col("kind")))

    moved, reached, back, spent = None, -np.inf, None, [first, second]
    for _ in range(rounds):
        counted = stored(by_block(moved).mapInArrow(partial(recounted, classes=classes), SCHEMA), release=True)
        now = _matrix(counted, classes)
        if likelihood(now) <= reached:
            discarded(counted)
            break
        reached, back = likelihood(now), (moved, tokens, kinds)
        words = counted.filter(F.col("kind") == WORD).select("block", "word", "number", "n", "other").repartition(F.col("word")).sortWithinPartitions("word")
        moved = stored(words.mapInArrow(partial(moved_words, table=context.broadcast(now)), SCHEMA), release=True)
        discarded(counted)
        spent.append(moved)
        more = _sums(moved, classes)
        tokens, kinds = tokens + more[0], kinds + more[1]

    while True:
        model = Model(tokens, kinds)
        third = stored(by_block(moved).mapInArrow(partial(coded, model=context.broadcast(model)), CODED), release=True)
        table = np.zeros(classes * classes)
        pairs = third.filter("bigrams is not null").select(F.posexplode("bigrams").alias("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n"))
        for row in pairs.collect():  # one row a pair of classes
            table[row.pair] = row.n
        if back is None or likelihood(table.reshape(classes, classes)) >= reached:
            break
        (moved, tokens, kinds), back = back, None
        discarded(third)
    # Only the coded texts are read from now on.
    for part in spent:
        discarded(part)
    found = third.filter("doc_ids is not null").drop("bigrams").mapInArrow(partial(scored, transition=model.transitions(table.reshape(classes, classes))), SCORED_SCHEMA)
    return found.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.n_total).cast("bigint").alias("train_tokens"), "base_score", "score")
