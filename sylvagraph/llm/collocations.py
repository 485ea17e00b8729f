"""Phrase collocation mining (operator 13).

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``. They are filed once in blocks of one language, each with
its own numbers of words. Word counts are summed over all blocks; words of at least ``least`` occurrences get dense 32-bit numbers, which go back to the blocks that have the word by a join,
so no task holds the dictionary. A phrase of ``least`` occurrences has such words only, so pieces break at all others. Runs of two to four numbers are packed into 16-byte keys (high and low
64 bits; a number of 0 fills up). Each block sorts its keys, counts runs and cuts the result at the bounds of key ranges; a range brings its cells
together, sorts and counts again. A key has one row a block at most, so the commonest phrase is no hot key. Bounds come from a bounded sample of blocks' keys: they steer sizes only.

Scores and domination are joins of the counted phrases by key. Ranks are taken by a window with a limit a language, words put back for what is within the limit (with ties).

Null and empty texts have no words, a null language is ``und``. Repeated rows count as often as they occur. Without a phrase that is frequent enough there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvagraph.llm.common import discarded, stored, text_bytes

LEAST, MOST_WORDS, TOP, COVER_PERCENT = 30, 4, 2000, 80
#: A-Z to a-z, every break to a full stop, a tab to a space: what is left of white space stands between words.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x2E if c in b",;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
#: A block ends after so many words; texts of more bytes than a slice are cut at breaks.
BLOCK_WORDS, SLICE_BYTES = 1 << 20, 4 << 20
#: Keys of a range, roughly; blocks and keys of the sample that steers the bounds; keys of a range that are held before they are counted.
RANGE_KEYS, SAMPLE_BLOCKS, SAMPLE_KEYS, HELD_KEYS = 2_000_000, 4096, 64, 4_000_000


def _slices(text: bytes) -> Iterator[bytes]:
    while len(text) > SLICE_BYTES:
        at = text.rfind(b".", 0, SLICE_BYTES)
        at = text.find(b".", SLICE_BYTES) if at < 0 else at
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1 :]
    yield text


class Numbered(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True) if size else b"", dtype=kind)


# words: the block's words in order of their numbers, from 1; counts: how often each occurs. places: a number a word, 0 at breaks, packed.
BLOCKS = "block bigint, lang string, n_words bigint, words array<binary>, counts array<bigint>, n_places bigint, places binary"


def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) -> BLOCKS."""
    held: dict[str, tuple[Numbered, list[np.ndarray]]] = {}
    size: dict[str, int] = {}
    base, made = TaskContext.get().partitionId() << 32, 0

    def block(lang: str) -> pa.RecordBatch:
        nonlocal made
        numbers, parts = held.pop(lang)
        size.pop(lang)
        places = np.concatenate(parts)
        counts = np.bincount(places, minlength=len(numbers))[1:]
        cells = [pa.array([base + made]), pa.array([lang]), pa.array([int(counts.sum())]), pa.array([list(numbers)[1:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))]
        made += 1
        return pa.RecordBatch.from_arrays([*cells, pa.array([len(places)]), pa.array([_pack(places)], pa.binary())], names=["block", "lang", "n_words", "words", "counts", "n_places", "places"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
            for part in _slices(text.translate(FOLD)):
                words = part.replace(b".", b" . ").split()
                if not words:
                    continue
                numbers, parts = held.setdefault(lang, (Numbered({b".": 0}), []))
                parts.append(np.array([*map(numbers.__getitem__, words), 0], dtype="<i4"))
                size[lang] = size.get(lang, 0) + len(words)
                if sum(size.values()) >= BLOCK_WORDS:
                    yield block(max(size, key=size.__getitem__))
    for lang in list(held):
        yield block(lang)


def _sorted_runs(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs: a stable pass over the low halves, one over the high ones, then runs."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else np.zeros(0, dtype=np.int64)
    if counts is None:
        return high[starts], low[starts], np.diff(np.append(starts, len(high)))
    return high[starts], low[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def keys_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all runs of 2 to MOST_WORDS numbers without a 0."""
    highs, lows = [], []
    words = numbers.astype(np.uint64)
    alive = numbers > 0
    for n in range(2, MOST_WORDS + 1):
        alive = alive[:-1] & (numbers[n - 1 :] > 0)
        at = np.flatnonzero(alive)
        highs.append(words[at] << np.uint64(32) | words[at + 1])
        lows.append((words[at + 2] << np.uint64(32) if n > 2 else np.zeros(len(at), dtype=np.uint64)) | (words[at + 3] if n > 3 else np.uint64(0)))
    return _sorted_runs(np.concatenate(highs), np.concatenate(lows), None)


def _bytes_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes, which compare as the pairs do."""
    return np.ascontiguousarray(np.stack((high, low), axis=1).astype(">u8")).view("S16").ravel()


CODED = "block bigint, lang string, n_places bigint, numbers binary"


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their frequent words' numbers in the dictionary -> places by these, 0 elsewhere."""
    for batch in batches:
        for block, lang, n, places, local, number, n_own in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "n_places", "places", "local", "number", "n_own")), strict=True):
            table = np.zeros(n_own + 1, dtype="<u4")
            table[local] = number
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang]), pa.array([n]), pa.array([_pack(table[_unpack(places, n, "<i4")])], pa.binary())], names=["block", "lang", "n_places", "numbers"])


def sampled_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, data in zip(batch.column("n_places").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
            high, low, _ = keys_of(_unpack(data, n, "<u4"))
            at = np.linspace(0, len(high) - 1, SAMPLE_KEYS).astype(np.int64) if len(high) else np.zeros(0, dtype=np.int64)
            keys = np.stack((high[at], low[at]), axis=1).astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([len(high)]), pa.array([keys], pa.binary())], names=["n", "keys"])


# n keys of a range: their high halves, low halves and counts, packed.
CELLS = "range int, lang string, n bigint, high binary, low binary, counts binary"


def _cell(r: int, lang: str, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([_pack(x)], pa.binary()) for x in (high.astype("<u8"), low.astype("<u8"), counts.astype("<i8"))]
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([lang]), pa.array([len(high)]), *packed], names=["range", "lang", "n", "high", "low", "counts"])


def ranged(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Coded blocks -> counted keys, a cell for each range."""
    for batch in batches:
        for lang, n, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "n_places", "numbers")), strict=True):
            high, low, counts = keys_of(_unpack(data, n, "<u4"))
            edges = [0, *np.searchsorted(_bytes_of(high, low), bounds).tolist(), len(high)]
            for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    yield _cell(r, lang, high[a:b], low[a:b], counts[a:b])


COUNTED = "lang string, key binary, words int, a bigint"


def counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Cells by range and language -> keys of at least ``least`` occurrences."""
    at, held, size = None, [], 0

    def merged() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [_sorted_runs(*(np.concatenate(x) for x in zip(*held, strict=True)))]

    def rows() -> Iterator[pa.RecordBatch]:
        high, low, counts = merged()[0]
        some = counts >= least
        if some.any():
            high, low = high[some], low[some]
            words = 2 + (low > 0).astype(np.int32) + (low & np.uint64(0xFFFFFFFF) > 0)
            data = np.stack((high, low), axis=1).astype(">u8").tobytes()
            keys = pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([at[1]] * len(high)), keys, pa.array(words.astype(np.int32)), pa.array(counts[some])], names=["lang", "key", "words", "a"])

    for batch in batches:
        for r, lang, n, *cells in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "n", "high", "low", "counts")), strict=True):
            if at != (r, lang):
                if held:
                    yield from rows()
                at, held, size = (r, lang), [], 0
            held.append(tuple(_unpack(c, n, k) for c, k in zip(cells, ("<u8", "<u8", "<i8"), strict=True)))
            size += n
            if size > HELD_KEYS:
                held = merged()
                # Distinct keys stay; the next merge waits until as many again have come.
                size = min(len(held[0][0]), HELD_KEYS // 2)
    if held:
        yield from rows()


def dictionary(blocks: DataFrame, least: int) -> DataFrame:
    """Frequent words of each language: lang, word, f and number, dense from 1."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    kept = stored(each.filter(F.col("f") >= least))
    rows = kept.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("index"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row a file
    number = F.col("start") + F.col("index") + 1
    # 2^32 words of 30 occurrences would be a corpus of more than 10^11 words.
    checked = F.when(number < 1 << 32, number).otherwise(F.raise_error(F.lit("more than 2^32 frequent words")).cast("bigint"))
    return rows.join(F.broadcast(starts), "file").select("lang", "word", "f", checked.alias("number"))


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, number), phrases of 2 to MOST_WORDS words (lang, key, words, a) of at least ``least`` occurrences, and all words of a language (lang, n)."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    blocks = stored(texts.mapInArrow(filed, BLOCKS))
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = dictionary(blocks, least)
    own = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    known = own.join(words.select("lang", "word", "number"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct((F.col("at") + 1).alias("local"), "number")).alias("known"))
    joined = blocks.select("block", "lang", "n_places", "places", F.size("words").alias("n_own")).join(known, "block")
    code = stored(joined.select("block", "lang", "n_places", "places", "n_own", F.col("known.local").alias("local"), F.col("known.number").alias("number")).mapInArrow(coded, CODED))

    n_blocks = code.count()
    sample = code if n_blocks <= SAMPLE_BLOCKS else code.filter(F.pmod(F.xxhash64("block"), F.lit(n_blocks // SAMPLE_BLOCKS + 1)) == 0)
    seen = sample.select("n_places", "numbers").mapInArrow(sampled_keys, "n bigint, keys binary").collect()  # some SAMPLE_BLOCKS rows
    keys = np.sort(np.concatenate([np.frombuffer(r["keys"], dtype="S16") for r in seen] or [np.zeros(0, dtype="S16")]))
    total = sum(r.n for r in seen) * max(1, n_blocks) // max(1, len(seen))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_KEYS + 1)
    at = np.linspace(0, len(keys) - 1, ranges + 1)[1:-1].astype(np.int64) if len(keys) else np.zeros(0, dtype=np.int64)
    bounds = np.unique(keys[at]) if len(keys) else keys
    cells = code.select("lang", "n_places", "numbers").mapInArrow(partial(ranged, bounds=bounds), CELLS)
    near = cells.repartition(ranges, "range").sortWithinPartitions("range", "lang")
    return words, stored(near.mapInArrow(partial(counted, least=least), COUNTED)), totals


ZEROS = "X'00000000000000000000000000000000'"


def _part(key: Column, first: Column, words: Column) -> Column:
    """The key of the ``words`` words of a key from word ``first`` (from 0) on, filled up with zeros."""
    return F.substr(F.concat(F.substr(key, 4 * first + 1, 4 * words), F.expr(ZEROS)), F.lit(1), F.lit(16))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, cover_percent: int = COVER_PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, phrases, totals = phrase_counts(docs, least, lang_col, text_col)
    key_of_word = F.to_binary(F.rpad(F.lpad(F.hex("number"), 8, "0"), 32, "0"), F.lit("hex"))
    counts = phrases.select("key", F.col("a").alias("f")).unionByName(words.select(key_of_word.alias("key"), "f"))

    # One row a cut; a cut's two parts are looked up one after the other.
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), _part(F.col("key"), F.lit(0), k).alias("left"), _part(F.col("key"), k, F.lit(MOST_WORDS)).alias("right"))))
    cuts = phrases.select("key", "a", cut.alias("c")).select("key", "a", "c.k", "c.left", "c.right")
    parts = cuts.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    scored = parts.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst"))

    inner = F.explode(F.array(*(_part(F.col("key"), F.lit(i), F.lit(n)) for n in range(2, MOST_WORDS) for i in range(MOST_WORDS - n + 1))))
    # Runs past the end of a phrase of three words are its own last word or words, or itself.
    covers = phrases.filter(F.col("words") > 2).select("key", "a", inner.alias("sub")).filter(F.col("sub") != F.col("key")).groupBy("sub").agg(F.max("a").alias("wider"))
    held = phrases.join(covers.withColumnRenamed("sub", "key"), "key", "left")
    wide = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(wider AS DECIMAL(19, 0)) >= CAST({int(cover_percent)} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))")
    free = held.filter(F.coalesce(~wide, F.lit(True))).join(scored, "key").select("lang", "key", "words", "a", "worst.score", "worst.l", "worst.r")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = stored(free.withColumn("rank", F.rank().over(best)).filter(F.col("rank") <= top).drop("rank"))
    place = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words")), lambda i: F.conv(F.hex(F.substr(F.col("key"), 4 * i - 3, F.lit(4))), 16, 10).cast("bigint")))
    spelled = near.select("key", place.alias("at", "number")).join(words.select("number", "word"), "number").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("w")))).alias("ws"))
    phrase = near.join(spelled, "key").withColumn("phrase", F.array_join(F.col("ws.w"), " "))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrase.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

